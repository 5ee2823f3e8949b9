"""Exact duplicates of texts by content-defined chunk recipes.

Each text becomes a recipe: the ordered list of its chunks' identifiers. Chunk
ends depend on the bytes around them only, so equal texts have equal recipes
wherever they lie, and a document moves as 16 bytes per chunk of about 2 KB.
Chunks of documents that share a recipe are compared byte by byte, each distinct
chunk of a task once, so that an identifier stands for one content; a text that
holds a chunk whose identifier failed that test is compared as a whole instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, grouped, power_table
from .workspace import discard, materialise, pick, salted_join

#: Bytes that decide a chunk's end; mean, least and largest chunk in bytes.
WINDOW, MEAN, LEAST, LARGEST = 32, 2048, 512, 16384
#: Bytes of text that a task holds at once.
BUDGET = 4 << 20


def chunk_ends(data: np.ndarray, mean: int = MEAN, least: int = LEAST, largest: int = LARGEST) -> np.ndarray:
    """Ends of the content-defined chunks of one text; the last is its length.

    A position is a candidate where a polynomial hash of the ``WINDOW`` bytes
    before it is 0 modulo ``mean``. Ends are taken from the candidates left to
    right, at least ``least`` and at most ``largest`` bytes apart.
    """
    n = len(data)
    if n <= least:
        return np.array([n] if n else [], np.int64)
    found, step = [], 1 << 19
    weights = power_table(0xB5297A4D3F84D5B5, WINDOW)[::-1]
    for a in range(0, n - WINDOW + 1, step):
        part = data[a : a + step + WINDOW - 1].astype(np.uint32) + np.uint32(1)
        count = len(part) - WINDOW + 1
        h = np.zeros(count, np.uint32)
        for k in range(WINDOW):
            h += part[k : k + count] * np.uint32(int(weights[k]) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        found.append(np.flatnonzero((h >> np.uint32(8)) % np.uint32(mean) == 0) + a + WINDOW)
    ends, last = [], 0
    for c in np.concatenate(found).tolist():
        while c - last > largest:
            last += largest
            ends.append(last)
        if c - last >= least:
            ends.append(c)
            last = c
    while n - last > largest:
        last += largest
        ends.append(last)
    if last < n:
        ends.append(n)
    return np.array(ends, np.int64)


def chunks(text: bytes) -> list[bytes]:
    """The chunks of a normalised text, in order."""
    ends = chunk_ends(np.frombuffer(text, np.uint8)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes, width: int = 16) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def _recipes(width: int):
    def run(batches):
        import pyarrow as pa

        table = bytes(LOWER)
        for texts, rest in grouped(batches, BUDGET, ["doc_id", "t"]):
            normal = [t.translate(table) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rest["doc_id"], pa.int64()),
                    pa.array(rest["t"], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in normal], pa.string()),
                    pa.array([b"".join([digest(c, width) for c in chunks(t)]) for t in normal], pa.binary()),
                ],
                ["doc_id", "t", "text_sha256", "recipe"],
            )

    return run


def _distinct_chunks(width: int):
    """(identifier, chunk) pairs of a task; a pair it sent lately isn't sent again."""

    def run(batches):
        import pyarrow as pa

        table = bytes(LOWER)
        held: dict[bytes, bytes] = {}
        size = 0
        for texts, _ in grouped(batches, BUDGET, []):
            rows = []
            for t in texts:
                for c in chunks(t.translate(table)):
                    d = digest(c, width)
                    if held.get(d) != c:
                        rows.append((d, c))
                        held[d] = c
                        size += len(c)
            if size > 4 * BUDGET:
                held, size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["id", "chunk"])

    return run


def _clashing(batches):
    """Identifiers with two contents, from pairs sorted by identifier."""
    import pyarrow as pa

    last, content = None, None
    for batch in batches:
        out = []
        for d, c in zip(batch.column("id").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            if d != last:
                last, content = d, c
            elif c != content:
                out.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["id"])


def exact_groups(docs: DataFrame, width: int = 16) -> DataFrame:
    """Groups of equal texts (A-Z lower-cased), one row for each row of ``docs``.

    Returns doc_id, keep_id, group_size, kept, text_sha256. The row with the
    largest doc_id of a group stays. ``width`` is the bytes of an identifier.
    Null text counts as empty, and empty texts form one group. Rows that repeat a
    doc_id count each in group_size, and one row of a group is kept. A null
    doc_id is smaller than any other. Rows of a large group stay spread over tasks:
    what is joined back to them is one row a group. Other columns of ``docs`` are ignored; an
    empty table gives no rows.
    """
    docs = pick(docs, "doc_id", "text").withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    recipes = docs.mapInArrow(_recipes(width), "doc_id long, t long, text_sha256 string, recipe binary")
    recipes = materialise(recipes.withColumn("tag", F.monotonically_increasing_id()), "recipes")

    def groups(rows: DataFrame, *keys: str) -> DataFrame:
        """The keys of several rows, with their number and the row that stays, written."""
        stays = F.max(F.struct("doc_id", "tag")).alias("stays")
        return materialise(rows.groupBy(*keys).agg(F.count("*").alias("group_size"), stays).filter("group_size > 1"), "shared")

    shared = groups(recipes, "recipe")
    grouped_rows = salted_join(recipes, shared, ["recipe"])
    # documents move only if their recipe is shared, and then as chunks that differ in a task
    ids = materialise(grouped_rows.filter("group_size IS NOT NULL").select("doc_id", "t").distinct(), "shared-documents")
    sent = salted_join(docs, ids, ["doc_id", "t"], "left_semi").mapInArrow(_distinct_chunks(width), "id binary, chunk binary")
    clashes = materialise(sent.repartition("id").sortWithinPartitions("id").mapInArrow(_clashing, "id binary").distinct(), "clashes")
    discard(ids)
    if not clashes.isEmpty():
        parts = F.expr(f"transform(sequence(1, length(recipe), {width}), i -> substring(recipe, i, {width}))")
        hit = recipes.filter("length(recipe) > 0").select("recipe", F.explode(parts).alias("id")).join(clashes, "id", "left_semi").select("recipe").distinct()
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        texts = docs.select(F.translate("text", upper, lower).cast("binary").alias("whole")).distinct()
        texts = texts.select(F.sha2("whole", 256).alias("text_sha256"), "whole")
        hit = recipes.join(hit, "recipe", "left_semi").select("text_sha256").distinct()
        rows = recipes.join(texts.join(hit, "text_sha256", "left_semi"), "text_sha256", "left")
        grouped_rows = salted_join(rows, groups(rows, "recipe", "whole"), ["recipe", "whole"])
    alone = F.col("group_size").isNull()
    return grouped_rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("stays.tag") == F.col("tag"))).alias("kept"),
        "text_sha256",
    )
