"""Scores of texts by a bigram model in log-frequency Bloom filters.

A pair of tokens with count c is put in a filter once for each level 1 .. 1 +
floor(log2 c); a count is read back by probing levels until one misses, and stands
for the least count of its level, q. Pairs are dealt to buckets by their hash and
every bucket's filter is sized to its pairs, so the model grows with the corpus.

p(w | v) = LAMBDA q(v, w) / Q(v) + (1 - LAMBDA) p(w), p(w) = (c(w) + 1) / (N + V + 1);
after a context never seen, p(w). Q(v) is the sum of q over the distinct training
pairs of v as the filters give them, so that a context's probabilities of the words
seen after it add up to LAMBDA; only false positives of words never seen after it
come on top. A bucket tells the first block that holds a pair its level, and blocks
send these sums and their tokens' training counts to the tokens' buckets, which reply
with the corpus' sums. Counts of single tokens are exact.

Filters are broadcast in rounds of at most ``ROUND_BYTES``. Before that, every block
deals its distinct pairs to the rounds, so a pair is read and probed in one round
alone. Tokens are told apart by 64-bit hashes. A token that is in every text costs
its bucket one entry a block, not one a text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import packed, packed_keys, unpacked, unpacked_keys
from .labelled import remainder
from .text import U64, Words, give_back, mix
from .workspace import discard, materialise, pick

BLOCK = 8 << 20
BUCKET_BYTES = 16 << 20
#: Bits of a filter for each level of a pair, and its probes.
BITS, PROBES = 10, 5
LAMBDA = 0.4
ROUND_BYTES = 96 << 20
END = U64(0x0123456789ABCDEF)
PAIRS = "block long, bucket int, keys binary, counts binary"
FILTERS = "block long, bucket int, filter binary, levels binary"
TOKENS = "block long, bucket int, keys binary, counts binary, sums binary"
TOLD = "block long, part int, kind string, a binary, b binary, total long, distinct long"


def pair_keys(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of (previous token, token); a text starts after an end."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.concatenate(([0], ends[:-1] + 1))] = END
    return mix(before * U64(0x9E3779B97F4A7C15) + hashes * U64(0xC2B2AE3D27D4EB4F))


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the place of each text's end."""
    ends = words.first[1:] + np.arange(len(words.first) - 1)
    return np.insert(words.hashes(), words.first[1:], END), ends


class Block:
    """A stored block's tokens and pairs."""

    def __init__(self, table, row: int = 0):
        self.number, words = blocks.words(table, row, lower=True)
        self.hashes, self.ends = tokens(words)
        self.size = np.diff(self.ends, prepend=-1)
        self.pairs = pair_keys(self.hashes, self.ends)
        self.train = np.repeat(~np.array(table.column("held_out")[row].as_py(), bool), self.size)


def each_block(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)
    give_back()


def rows_of(schema: str, rows: list[tuple]):
    """An Arrow table of tuples."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _pairs(bits: int):
    """Counts of each block's training pairs by bucket."""

    def run(batches):
        for b in each_block(batches):
            unique, n = np.unique(b.pairs[b.train], return_counts=True)
            yield from rows_of(PAIRS, [(b.number, to, packed_keys(unique[x:y]), packed(n[x:y], "<u4")) for to, x, y in blocks.runs(unique, bits)]).to_batches()

    return run


def probe_bits(keys: np.ndarray, level: int, size: np.ndarray):
    """The places of a level of pairs in filters of ``size`` bits, probe by probe."""
    h = mix(keys + U64(level * 0x9E3779B97F4A7C15 % 2**64))
    step = (h >> U64(32)) | U64(1)
    for _ in range(PROBES):
        yield h % size
        h = h + step


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits (packed in bytes) of a filter that holds each key once for every level of its count."""
    levels = np.floor(np.log2(counts)).astype(np.int64) + 1
    size = max(64, int(-(-int(levels.sum()) * BITS // 8) * 8))
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in probe_bits(keys[levels >= level], level, U64(size)):
            bits[place] = True
    return np.packbits(bits, bitorder="little")


class Filters:
    """The filters of some buckets, end to end."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.bits = bits
        self.data = np.frombuffer(b"".join(parts.values()), np.uint8)
        self.offset, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        at = 0
        for bucket, part in parts.items():
            self.offset[bucket], self.size[bucket] = at, len(part) * 8
            at += len(part) * 8

    @classmethod
    def of(cls, state: dict) -> Filters:
        """From another's ``__dict__``, which holds numbers and arrays only and so can be broadcast."""
        new = cls.__new__(cls)
        new.__dict__ = state
        return new

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key's count; 0 if it isn't there."""
        bucket = (keys >> U64(64 - self.bits)).astype(np.int64)
        offset, size = self.offset[bucket], self.size[bucket]
        out, alive, level = np.zeros(len(keys), np.uint8), np.flatnonzero(size > 0), 1
        while len(alive):
            ok = np.ones(len(alive), bool)
            for place in probe_bits(keys[alive], level, size[alive]):
                place = place + offset[alive]
                ok &= ((self.data[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1).astype(bool)
            alive = alive[ok]
            out[alive] = level
            level += 1
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The least count of each key's level; 0 if it isn't there."""
        return quantised(self.levels(keys))


def quantised(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, 2.0 ** (levels.astype(np.float64) - 1), 0.0)


def _filter(bits: int):
    """A bucket's filter (block -1), and for each block the levels of the pairs that it is the first to hold, else 0."""

    def run(table):
        numbers, bucket = table.column("block").to_numpy(), table.column("bucket")[0].as_py()
        keys = [unpacked_keys(k) for k in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([unpacked(c, n, "<u4") for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        unique, back = np.unique(np.concatenate(keys), return_inverse=True)
        data = build_filter(unique, np.bincount(back, counts, len(unique))).tobytes()
        levels = Filters(bits, {bucket: data}).levels(unique)
        owner, block = np.full(len(unique), np.iinfo(np.int64).max), np.repeat(numbers, sizes)
        np.minimum.at(owner, back, block)
        told = np.where(owner[back] == block, levels[back], 0).astype(np.uint8)
        ends = np.cumsum(sizes).tolist()
        rows = [(int(n), bucket, None, packed(told[a:b], "u1")) for n, a, b in zip(numbers, [0, *ends], ends, strict=False)]
        return rows_of(FILTERS, [(-1, bucket, data, None), *rows])

    return run


def _tokens(bits: int, token_bits: int):
    """Distinct tokens of a block by bucket, with training counts and sums of the levels told to this block."""

    def run(docs, told):
        if not docs.num_rows:
            return rows_of(TOKENS, [])
        b = Block(docs)
        unique, local = np.unique(b.hashes, return_inverse=True)
        counts = np.bincount(local[b.train], minlength=len(unique))
        pairs, at = np.unique(b.pairs[b.train], return_index=True)
        place = np.flatnonzero(b.train)[at]
        before = np.where(np.isin(place, b.ends + 1) | (place == 0), np.searchsorted(unique, END), local[place - 1])
        levels = np.zeros(len(pairs), np.uint8)
        runs = {to: (x, y) for to, x, y in blocks.runs(pairs, bits)}
        for bucket, data in zip(told.column("bucket").to_pylist(), told.column("levels").to_pylist(), strict=True):
            x, y = runs[bucket]
            levels[x:y] = unpacked(data, y - x, "u1")
        sums = np.bincount(before, quantised(levels), len(unique)).astype(np.int64)
        return rows_of(TOKENS, [(b.number, to, packed_keys(unique[x:y]), packed(counts[x:y], "<u4"), packed(sums[x:y])) for to, x, y in blocks.runs(unique, token_bits)])

    return run


def _counted(table):
    """To each block its tokens' counts and sums in the corpus, in order; and the bucket's own sums (block -1)."""
    numbers, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    keys = [unpacked_keys(k) for k in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = []
    for name, kind in (("counts", "<u4"), ("sums", "<i8")):
        own = np.concatenate([unpacked(c, n, kind) for c, n in zip(table.column(name).to_pylist(), sizes, strict=True)]).astype(np.int64)
        total.append(np.zeros(len(unique), np.int64))
        np.add.at(total[-1], back, own)
    ends = np.cumsum(sizes).tolist()
    rows = [(n, bucket, "tokens", packed(total[0][back[a:b]]), packed(total[1][back[a:b]]), 0, 0) for n, a, b in zip(numbers, [0, *ends], ends, strict=False)]
    return rows_of(TOLD, [(-1, bucket, "tokens", None, None, int(total[0].sum()), int((total[0] > 0).sum())), *rows])


def _dealt(bits: int, starts: list[int]):
    """The distinct pairs of each block by round; round k has the buckets from starts[k] on."""

    def run(batches):
        for b in each_block(batches):
            unique = np.unique(b.pairs)
            cuts = np.searchsorted(unique >> U64(64 - bits), np.array([*starts, 1 << bits], U64)).tolist()
            rows = [(b.number, packed_keys(unique[x:y]), k) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            yield from rows_of("block long, keys binary, part int", rows).to_batches()

    return run


def _probed(filters, part: int):
    """Levels of the pairs that blocks dealt to a round."""

    def run(batches):
        model = Filters.of(filters.value)
        for batch in batches:
            for number, keys in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                yield from rows_of(TOLD, [(number, part, "pairs", packed(model.levels(unpacked_keys(keys)), "u1"), None, 0, 0)]).to_batches()
        give_back()

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(bits: int, token_bits: int, starts: list[int], total: int, distinct: int, mixture: float):
    floor = float(total + distinct + 1)

    def run(docs, told):
        import pyarrow as pa

        if not docs.num_rows:
            return rows_of(SCORED, [])
        b = Block(docs)
        unique, local = np.unique(b.hashes, return_inverse=True)
        pairs, of = np.unique(b.pairs, return_inverse=True)
        counts, sums, levels = np.zeros(len(unique)), np.zeros(len(unique)), np.zeros(len(pairs), np.uint8)
        spans = {("tokens", to): (x, y) for to, x, y in blocks.runs(unique, token_bits)}
        cuts = np.searchsorted(pairs >> U64(64 - bits), np.array([*starts, 1 << bits], U64)).tolist()
        spans |= {("pairs", k): (x, y) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))}
        for kind, part, one, two in zip(*(told.column(c).to_pylist() for c in ("kind", "part", "a", "b")), strict=True):
            x, y = spans[kind, part]
            if kind == "tokens":
                counts[x:y], sums[x:y] = unpacked(one, y - x), unpacked(two, y - x)
            else:
                levels[x:y] = unpacked(one, y - x, "u1")
        starts_at = b.ends + 1 - b.size
        p = (counts + 1) / floor
        before = np.concatenate(([0.0], sums[local[:-1]]))
        before[starts_at] = sums[np.searchsorted(unique, END)]
        p_token = p[local]
        q = quantised(levels)[of]
        # a false positive can't be more than all that was seen after a context
        mixed = np.where(before > 0, mixture * np.minimum(q, before) / np.maximum(before, 1) + (1 - mixture) * p_token, p_token)
        held = docs.column("held_out")[0].as_py()
        known = np.add.reduceat(counts[local] > 0, starts_at, dtype=np.int64)
        columns = [pa.array(docs.column("doc_id")[0].as_py(), pa.int64()), pa.array(held, pa.bool_()), pa.array(b.size, pa.int64()), pa.array(known), pa.array(np.add.reduceat(np.log10(p_token), starts_at)), pa.array(np.add.reduceat(np.log10(mixed), starts_at))]
        return pa.table(columns, [f.split()[0] for f in SCORED.split(", ")])

    return run


def score(docs: DataFrame, folds: int = 7, held: int = 2, mixture: float = LAMBDA, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    The model learns from rows whose crc32 modulo ``folds`` isn't ``held``. Null and
    empty texts are an end alone. A null doc_id is in training. Repeated rows count
    and are scored each. Without training rows every probability is 1 / (0 + 0 + 1).
    Other columns are ignored; an empty table gives no rows. A text is never cut, so
    a task holds the longest text's tokens.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    docs = pick(docs, "doc_id", "text").withColumn("held_out", held_out)
    store = blocks.store(docs, BLOCK, "lm-store")
    bits = blocks.bucket_bits(store, BUCKET_BYTES)
    token_bits = max(bits - 3, 4)
    by_block = store.groupBy("block")
    built = materialise(store.mapInArrow(_pairs(bits), PAIRS).groupBy("bucket").applyInArrow(_filter(bits), FILTERS), "lm-filters")
    owners = built.filter("block >= 0").select("block", "bucket", "levels").groupBy("block")
    asked = by_block.cogroup(owners).applyInArrow(_tokens(bits, token_bits), TOKENS)
    replies = materialise(asked.groupBy("bucket").applyInArrow(_counted, TOLD), "lm-counts")
    sums = replies.filter("block = -1").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"] or 0
    filters = built.filter("block = -1")
    sizes = filters.select("bucket", F.length("filter").alias("n")).orderBy("bucket").collect()  # at most 2 ** bits rows
    starts, size = [0], 0
    for row in sizes:
        if size and size + row["n"] > round_bytes:
            starts.append(row["bucket"])
            size = 0
        size += row["n"]
    dealt = materialise(store.mapInArrow(_dealt(bits, starts), "block long, keys binary, part int"), "lm-pairs", by="part")
    told, written = replies.filter("block >= 0"), []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], 1 << bits], strict=True)):
        chosen = filters.filter(F.col("bucket").between(a, b - 1)).select("bucket", "filter")
        model = spark.sparkContext.broadcast(Filters(bits, {r["bucket"]: bytes(r["filter"]) for r in chosen.toLocalIterator()}).__dict__)
        levels = dealt.filter(F.col("part") == k).select("block", "keys").mapInArrow(_probed(model, k), TOLD)
        written.append(materialise(levels, f"lm-round-{k}"))
        model.unpersist()
        told = told.unionByName(written[-1])
    discard(dealt, built)
    run = _scored(bits, token_bits, starts, total, distinct, mixture)
    out = by_block.cogroup(told.groupBy("block")).applyInArrow(run, SCORED)
    return out.withColumn("train_tokens", F.lit(total).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
