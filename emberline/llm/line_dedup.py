"""Near-duplicate lines by a deletion-neighbourhood join.

Lines equal to a line that starts earlier in the corpus are removed, unless blank,
and so are lines within one edit of such a line if both have at least ``MIN_CHARS``
code points; lines are judged on the input. The order is (doc_id, line number).

All variants of a line with one code point deleted are emitted as hashed keys.
Lines that share a variant made at the same place differ by a substitution; a line
that is a variant of another differs by a deletion. Every key thus needs only its
earliest line, never its pairs, and each match is verified on the texts. Only
lines that share a half with another distinct line can be within one edit of it,
so all others are screened out before variants are made.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BASE, BYTE_VALUE, U64, give_back, grouped, mix, power_table
from .workspace import discard, materialise, pick, salted_join, small_side, written_bytes

MIN_CHARS = 20
BUDGET = 2 << 20
#: Bytes of lines whose variants are made at once, which take some fifty times as much, and most lines.
AT_ONCE, LINES_AT_ONCE = 512 << 10, 2000
#: Bytes of written lines for each bucket of their variants, which take some hundred times as much.
BUCKET_BYTES = 4 << 10
LINES = "d long, t long, line_no int, h binary, keys array<long>"


def code_points(line: np.ndarray) -> np.ndarray:
    """Where the code points of UTF-8 bytes start, and the length."""
    return np.append(np.flatnonzero((line & 0xC0) != 0x80), len(line))


def _sums(line: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of a line."""
    acc = np.zeros(len(line) + 1, U64)
    np.cumsum(BYTE_VALUE[line] * power_table(BASE, len(line))[: len(line)], out=acc[1:])
    return acc


def line_hash(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(total + size.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def line_id(line: bytes) -> bytes:
    """128 bits that stand for a line's text."""
    return hashlib.blake2b(line, digest_size=16).digest()


def digest64(part: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)


def half_keys(line: bytes) -> list[int]:
    """Keys that any two lines within one edit share one of: halves by code points."""
    at = code_points(np.frombuffer(line, np.uint8)).tolist()
    n = len(at) - 1
    heads = {n // 2, (n + 1) // 2}
    tails = {-(-n // 2), -(-(n + 1) // 2)}
    return [digest64(b"h" + line[: at[k]]) for k in heads] + [digest64(b"t" + line[at[max(n - k, 0)] :]) for k in tails]


def variants(line: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the line with each code point deleted: alone, with the place, and the line's own."""
    data = np.frombuffer(line, np.uint8)
    at, acc = code_points(data), _sums(data)
    a, b = at[:-1], at[1:]
    back = power_table(pow(BASE, -1, 2**64), 5)[b - a]
    plain = line_hash(acc[a] + (acc[-1] - acc[b]) * back, len(data) - (b - a))
    placed = mix(plain ^ (np.arange(1, len(a) + 1).astype(U64) * U64(0x9E3779B97F4A7C15)))
    own = line_hash(acc[-1:], np.array([len(data)]))
    return plain, placed, int(own[0])


def within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def _lines(least: int):
    def run(batches):
        import pyarrow as pa

        for texts, rest in grouped(batches, BUDGET, ["d", "t"]):
            out: list[tuple] = []
            for text, d, t in zip(texts, rest["d"], rest["t"], strict=True):
                for k, line in enumerate(text.split(b"\n")):
                    if line.strip():
                        long = len(line) >= least and len(line.decode("utf-8", "replace")) >= least
                        out.append((d, t, k, line_id(line), half_keys(line) if long else []))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], ty) for i, ty in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], ["d", "t", "line_no", "h", "keys"])

    return run


def _texts(batches):
    """The named lines of documents: h, d, t, line_no, line."""
    import pyarrow as pa

    for texts, rest in grouped(batches, BUDGET, ["d", "t", "named"]):
        out: list[tuple] = []
        for text, d, t, named in zip(texts, rest["d"], rest["t"], rest["named"], strict=True):
            lines = text.split(b"\n")
            out += [(x["h"], d, t, x["line_no"], lines[x["line_no"]]) for x in named]
        names = ["h", "d", "t", "line_no", "line"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], ty) for i, ty in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)


#: One line's order: (d, t, line_no); kinds of keys: the line's own, a deletion, a deletion with its place.
ORDER = np.dtype([("d", "<i8"), ("t", "<i8"), ("n", "<i4")])
ENTRY = np.dtype([("key", "<u8"), ("kind", "u1"), ("line", "<u4")])


def _portions(batch):
    """Slices of an Arrow batch of lines, of at most ``LINES_AT_ONCE`` rows and, beyond one row, ``AT_ONCE`` bytes."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        done = size[a - 1] if a else 0
        b = min(max(int(np.searchsorted(size, done + AT_ONCE, "right")), a + 1), a + LINES_AT_ONCE)
        yield batch.slice(a, b - a)
        a = b


def _variants(buckets: int):
    """Variants of lines by bucket of keys: entries, and the lines they name."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in _portions(batch):
                table = np.zeros(rows.num_rows, ORDER)
                for name, column in (("d", "d"), ("t", "t"), ("n", "line_no")):
                    table[name] = rows.column(column).to_numpy()
                parts = []
                for i, line in enumerate(rows.column("line").to_pylist()):
                    plain, placed, own = variants(line)
                    e = np.empty(2 * len(plain) + 1, ENTRY)
                    e["key"][: len(plain)], e["kind"][: len(plain)] = plain, 1
                    e["key"][len(plain) : -1], e["kind"][len(plain) : -1] = placed, 2
                    e["key"][-1], e["kind"][-1], e["line"] = own, 0, i
                    parts.append(e)
                entries = np.concatenate(parts) if parts else np.empty(0, ENTRY)
                to = (entries["key"] % U64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                entries, to = entries[order], to[order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                out = []
                for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=True):
                    some = entries[x:y].copy()
                    used, some["line"] = np.unique(some["line"], return_inverse=True)
                    out.append((int(to[x]), some.tobytes(), table[used].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], ty) for i, ty in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "entries", "lines"])
        give_back()

    return run


def _earliest(table):
    """Of a bucket: every line with an earlier line under a key of its, and that line."""
    import pyarrow as pa

    entries, lines, n = [], [], 0
    for e, rows in zip(table.column("entries").to_pylist(), table.column("lines").to_pylist(), strict=True):
        e, rows = np.frombuffer(e, ENTRY).copy(), np.frombuffer(rows, ORDER)
        e["line"] += n
        n += len(rows)
        entries.append(e)
        lines.append(rows)
    e, rows = np.concatenate(entries), np.concatenate(lines)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((rows["n"], rows["t"], rows["d"]))] = np.arange(n)
    order = np.lexsort((rank[e["line"]], e["kind"], e["key"]))
    e = e[order]
    first = np.flatnonzero(np.diff(e["key"], prepend=~e["key"][:1]) != 0)
    group = np.cumsum(np.bincount(first, minlength=len(e))) - 1
    kind, line, r = e["kind"], e["line"].astype(np.int64), rank[e["line"]]
    big = np.iinfo(np.int64).max
    found = []
    for own, other in ((0, 1), (1, 0), (2, 2)):  # kind of the line that goes, and of the one it is close to
        low = np.full(len(first), big)
        np.minimum.at(low, group[kind == other], r[kind == other])
        goes = np.flatnonzero((kind == own) & (low[group] < r))
        found.append(np.stack((line[goes], low[group[goes]]), 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    back = np.empty(n, np.int64)
    back[rank] = np.arange(n)
    a, b = rows[pairs[:, 0]], rows[back[pairs[:, 1]]]
    columns = [x[f] for x in (a, b) for f in ("d", "t", "n")]
    del e, entries, order, kind, line, r, group
    give_back()
    return pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], ["d", "t", "line_no", "d2", "t2", "line_no2"])


def _verified(batches):
    import pyarrow as pa

    for b in batches:
        rows = zip(b.column("h").to_pylist(), b.column("line").to_pylist(), b.column("line2").to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, x, y in rows if within_one_edit(x.decode("utf-8", "replace"), y.decode("utf-8", "replace"))], pa.binary())], ["h"])


def _without(batches):
    import pyarrow as pa

    kinds = []

    def noted():
        for batch in batches:
            kinds[:] = [batch.schema.field("row_id").type]
            yield batch

    for texts, rest in grouped(noted(), BUDGET, ["row_id", "gone"]):
        new, total, removed = [], [], []
        for text, gone in zip(texts, rest["gone"], strict=True):
            lines, out = text.split(b"\n"), set(gone or ())
            new.append(b"\n".join([x for k, x in enumerate(lines) if k not in out]) if out else text)
            total.append(len(lines))
            removed.append(len(out))
        yield pa.RecordBatch.from_arrays([pa.array(rest["row_id"], kinds[0]), pa.array(new, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["row_id", "text", "n_lines", "n_removed"])


def removed_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """d, t, gone: the numbers of the lines to remove of each document with any.

    ``docs`` has d (id), t (hash of the text) and text.
    """
    lines = materialise(docs.mapInArrow(_lines(least), LINES), "lines")
    place = F.struct("d", "t", "line_no")
    distinct = materialise(lines.groupBy("h").agg(F.min(place).alias("first"), F.any_value("keys").alias("keys"), F.count("*").alias("n")), "distinct-lines")
    keys = distinct.select("h", "first", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")
    close = keys.join(shared, "key", "left_semi").groupBy("h").agg(F.any_value("first").alias("first"))
    named = close.groupBy("first.d", "first.t").agg(F.collect_list(F.struct("h", F.col("first.line_no").alias("line_no"))).alias("named"))
    named_table = materialise(named, "named-lines")
    texts = materialise(docs.join(small_side(named_table), ["d", "t"]).select("d", "t", "named", "text").mapInArrow(_texts, "h binary, d long, t long, line_no int, line binary"), "close-lines")
    buckets = int(min(max(written_bytes(texts) // BUCKET_BYTES, 32), 1 << 20))
    dealt = texts.select("d", "t", "line_no", "line").mapInArrow(_variants(buckets), "bucket int, entries binary, lines binary")
    pairs = dealt.groupBy("bucket").applyInArrow(_earliest, "d long, t long, line_no int, d2 long, t2 long, line_no2 int").distinct()
    other = texts.select(F.col("d").alias("d2"), F.col("t").alias("t2"), F.col("line_no").alias("line_no2"), F.col("line").alias("line2"))
    checked = pairs.join(texts, ["d", "t", "line_no"]).join(other, ["d2", "t2", "line_no2"]).select("h", "line", "line2").mapInArrow(_verified, "h binary")
    goes = materialise(checked.distinct().withColumn("near", F.lit(True)), "near-lines")
    first = distinct.select("h", "first", "n").join(goes, "h", "left").filter("n > 1 OR near").select("h", "first", "near")
    first = materialise(first, "repeated-lines")
    again = salted_join(lines.select("h", place.alias("place")), first, ["h"], "inner").filter(F.col("near").isNotNull() | (F.col("place") != F.col("first")))
    again = materialise(again.select("place"), "repeats")
    discard(lines, distinct, named_table, texts, goes, first)
    return again.groupBy("place.d", "place.t").agg(F.array_sort(F.collect_set("place.line_no")).alias("gone"))


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` as struct ``row`` with its text's remaining lines: row, text, n_lines, n_removed.

    A line goes if it isn't blank and an earlier line of the corpus is equal to it,
    or within one edit of it where both have at least ``least`` code points. Lines
    end at a line feed. Null text counts as empty and gives an empty text of one line. Rows that
    repeat a doc_id and its text are one document and keep the same lines; rows
    that share only a doc_id are told apart by a hash of the text. A null doc_id
    comes before all others. Extra columns live inside ``row``.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"])
    text = F.coalesce(docs["text"], F.lit(""))
    d = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    rows = docs.select(whole.alias("row_id"), d.alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    gone = materialise(removed_lines(rows.select("d", "t", "text"), least), "removed-lines")
    joined = salted_join(rows, gone, ["d", "t"]).select("row_id", "gone", "text")
    schema = joined.select("row_id", "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema
    return joined.mapInArrow(_without, schema)


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining text)."""
    out = dedup_lines(pick(docs, "doc_id", "text"))
    return out.select("row_id.doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their remaining text, all columns in order."""
    out = dedup_lines(docs)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row_id.`{c}`").alias(c) for c in docs.columns])
