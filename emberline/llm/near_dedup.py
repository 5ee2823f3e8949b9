"""Near-duplicate documents by SimHash and BK-trees: Jaccard similarity of five-word shingles of at least 0.8.

Every content (sequence of shingles) gets a SimHash fingerprint of 256 bits over its
distinct shingles. Fingerprints are dealt into shards, each shard builds a BK-tree of
its own and looks up in it what is at most ``RADIUS`` bits away; only such pairs are
candidates. A pair of similarity 0.8 differs by 38 bits on average (48 at most, for 4
and 5 shingles), with a standard deviation of 6. Candidates are verified: a pair is a
link if the shingle sets are as similar as asked. Groups are components of links.

Parts of the bits can't deal shards here, as they do within 2 bits: at 38 of 256 bits
a pair agrees on 16 given ones with probability 0.07. Shards are dealt by minima of
shingles: ``BANDS`` keys a content, each the hash of ``ROWS`` minima under different
permutations. Two contents of similarity s share a key with probability
1 - (1 - s ** ROWS) ** BANDS, 0.9998 at 0.8. A shard of up to ``ALL_PAIRS`` contents
gives all pairs within the radius. A larger one is cut into trees of about ``TREE``
fingerprints, each with the least, the greatest and the content whose keys are shared
most; every content gives its pairs with these three and its nearest neighbour.

A key whose contents these links leave in one component needs no more. Under any
other large key, every content outside its largest component is compared with every
content of another component, block by block, so no link between components is
lost. A task holds two blocks and gives only links that join components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash_dedup import components, first_rows, row_key, tree_pairs, wide_fingerprints
from .text import U64, Words, grouped, mix, sequence_hashes
from .workspace import discard, materialise, pick, salted_join, small_side

#: Words in a shingle, least similarity of a link, keys of a content, minima in a key.
SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 16, 4
#: Bits of 256 by which the fingerprints of candidates differ at most.
RADIUS = 80
#: Contents under a key up to which all of them within the radius are paired, and in a BK-tree of more, on average.
ALL_PAIRS, TREE = 16, 256
#: Contents and bytes of shingle sets in a block, on average.
BLOCK, BLOCK_BYTES = 256, 4 << 20
BUDGET = 2 << 20
FACTORS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
KEY = "z int, d long, t long"


def shingles(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, and where each text's begin; a shorter text is one shingle of all its words."""
    words = Words(texts, lower=True)
    hashes, n = words.hashes(), np.diff(words.first)
    runs = sequence_hashes(hashes, shingle)
    count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(first[-1], U64)
    long = n >= shingle
    at = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    of_long = np.repeat(long, count)
    out[of_long] = runs[at[of_long]]
    for i in np.flatnonzero((n > 0) & ~long).tolist():
        out[first[i]] = sequence_hashes(hashes[words.first[i] : words.first[i + 1]], int(n[i]))[0] ^ U64(n[i])
    return out, first


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` keys for each text that has shingles."""
    starts = first[:-1][np.diff(first) > 0]
    keys = np.zeros((len(starts), BANDS), U64)
    if len(starts):
        for k, factor in enumerate(FACTORS):
            band = k // ROWS
            keys[:, band] = mix(keys[:, band] + U64(k) + np.minimum.reduceat(hashes * factor, starts))
    return keys


def contents(hashes: np.ndarray, first: np.ndarray) -> list[int]:
    """A hash of each text's sequence of shingles; zero for none."""
    spans = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    return [int(sequence_hashes(hashes[a:b], b - a)[0]) if b > a else 0 for a, b in spans]


def _signed(values) -> list[int]:
    return np.array(values, U64).view(np.int64).tolist()


def _keys(batches):
    """z, d, t, content, keys and fingerprint of every row."""
    import pyarrow as pa

    for texts, rest in grouped(batches, BUDGET, ["z", "d", "t"]):
        hashes, first = shingles(texts)
        keys, has = band_keys(hashes, first).view(np.int64), np.diff(first) > 0
        bounds = np.concatenate(([0], np.cumsum(np.where(has, BANDS, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel()))
        columns = [pa.array(rest["z"], pa.int32()), pa.array(rest["d"], pa.int64()), pa.array(rest["t"], pa.int64()), pa.array(_signed(contents(hashes, first)), pa.int64()), lists]
        columns.append(pa.array([x.tobytes() for x in wide_fingerprints(hashes, first)], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["z", "d", "t", "content", "keys", "print"])


def _sets(batches):
    """content and its set of shingles, as ascending bytes of eight each."""
    import pyarrow as pa

    for texts, rest in grouped(batches, BUDGET, ["content"]):
        hashes, first = shingles(texts)
        sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rest["content"], pa.int64()), pa.array(sets, pa.binary())], ["content", "shingles"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _linked(least: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500)
                u, v, x, y = (rows.column(c).to_pylist() for c in ("u", "v", "x", "y"))
                is_link = [similarity(np.frombuffer(p, U64), np.frombuffer(q, U64)) >= least for p, q in zip(x, y, strict=True)]
                some = [[k for k, yes in zip(side, is_link, strict=True) if yes] for side in (u, v)]
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()) for s in some], ["u", "v"])

    return run


def joining(sets: list[np.ndarray], roots: list[int], left: list[int], right: list[int], least: float) -> list[tuple[int, int]]:
    """Pairs (i of ``left``, j of ``right``) of sets similar enough that join the components in ``roots``, none twice."""
    sizes = np.array([len(sets[j]) for j in right], np.int64)
    values, owner = np.concatenate([sets[j] for j in right]), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parent, out = {r: r for r in roots}, []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i in left:
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(right))
        for k in np.flatnonzero(both / (len(sets[i]) + sizes - both) >= least).tolist():
            a, b = root(roots[i]), root(roots[right[k]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, right[k]))
    return out


def _joining(least: float):
    def run(table):
        import pyarrow as pa

        table = table.sort_by("content")
        content, roots, block = (table.column(c).to_pylist() for c in ("content", "root", "block"))
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        left, right = ([k for k, x in enumerate(block) if x == table.column(side)[0].as_py()] for side in ("a", "b"))
        found = joining(sets, roots, left, right, least) if left and right else []
        return pa.table([pa.array([content[x[i]] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return run


def remaining(many: DataFrame, roots: DataFrame, sets: DataFrame, least: float, write) -> DataFrame | None:
    """u, v: links between components of ``roots`` under the keys of ``many`` (key, content), joining all that links join.

    None if every key's contents are in one component.
    """
    rooted = many.select("key", "content").join(roots, F.col("content") == F.col("node"), "left").select("key", "content", F.coalesce("root", "content").alias("root"))
    split = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("n", "root")).alias("most")).filter("k > 1")
    split = write(split.select("key", F.col("most.root").alias("main")), "split-keys")
    if split.isEmpty():
        return None
    sizes = sets.select("content", F.length("shingles").alias("bytes"))
    held = salted_join(rooted, split, ["key"], "inner").join(sizes, "content")
    held = write(held.select("key", "content", "root", (F.col("root") == F.col("main")).alias("main"), "bytes"), "split-contents")

    def blocks(of):
        n, size = F.sum(of.cast("long")), F.sum(F.when(of, F.col("bytes")).otherwise(0))
        return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")

    counts = write(held.groupBy("key").agg(blocks(~F.col("main")).alias("others"), blocks(F.col("main")).alias("mains")), "split-blocks")
    spread = F.xxhash64("content", F.lit("block"))
    block = F.when(F.col("main"), F.col("others") + F.pmod(spread, "mains")).otherwise(F.pmod(spread, "others")).cast("int")
    held = salted_join(held, counts, ["key"], "inner").withColumn("block", block)
    own = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    dealt = held.select("key", "content", "root", "block", F.explode(F.sequence(F.lit(0), own - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "content", "root", "block")
    return dealt.join(sets, "content").groupBy("key", "a", "b").applyInArrow(_joining(least), "u long, v long")


def links(rows: DataFrame, distinct: DataFrame, least: float, made: list) -> DataFrame:
    """u, v: links that join all contents that are similar enough. ``rows`` has z, d, t, text; tables written on the way go to ``made``."""

    def write(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    keys = distinct.select("content", F.explode("keys").alias("key"))
    ends = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).filter("n > 1")
    ends = small_side(write(ends, "band-ends"))
    shared = write(keys.join(ends, "key"), "shared-keys")
    few = shared.filter(F.col("n") <= ALL_PAIRS).select("key", F.lit(0).alias("block"), "content", F.lit(False).alias("hub"))
    large = shared.filter(F.col("n") > ALL_PAIRS)
    central = large.groupBy("content").agg(F.sum("n").alias("weight"))
    middle = large.join(central, "content").groupBy("key", "n", "low", "high").agg(F.max_by("content", F.struct("weight", "content")).alias("middle"))
    middle = write(middle, "band-middles")
    trees = F.ceil(F.col("n") / TREE)
    many = large.select("key", F.pmod(F.xxhash64("content", F.lit("tree")), trees).cast("int").alias("block"), "content", F.lit(False))
    hubs = middle.select("key", "n", F.explode(F.array("low", "high", "middle")).alias("content"))
    hubs = hubs.select("key", F.explode(F.sequence(F.lit(0), trees.cast("int") - 1)).alias("block"), "content", F.lit(True))
    dealt = few.union(many).union(hubs).join(distinct.select("content", "print"), "content")
    dealt = dealt.select("key", "block", "content", "hub", "print").repartition("key", "block").sortWithinPartitions("key", "block", "content")
    pairs = write(dealt.mapInArrow(tree_pairs(RADIUS), "u long, v long").distinct(), "candidates")
    named = pairs.select(F.explode(F.array("u", "v")).alias("content")).distinct().join(distinct, "content").select("content", "first.*")
    named = small_side(write(named, "candidate-documents"))
    sets = rows.join(named, ["z", "d", "t"]).select("content", "text").mapInArrow(_sets, "content long, shingles binary")
    sets = write(sets.dropDuplicates(["content"]), "shingle-sets")
    left, right = sets.toDF("u", "x"), sets.toDF("v", "y")
    found = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(_linked(least), "u long, v long")
    made.append(components(found))
    known = made[-1].toDF("u", "v")
    rest = remaining(large, made[-1], sets, least, write)
    return known if rest is None else known.union(rest)


def members(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """z, d, t, root: the group of each row of ``docs``. Texts without words are one group."""
    rows = pick(docs, "doc_id", "text").select(*row_key(F.col("doc_id"), F.col("text")), "text")
    found = materialise(rows.mapInArrow(_keys, f"{KEY}, content long, keys array<long>, print binary"), "band-keys")
    distinct = found.groupBy("content").agg(F.min(F.struct("z", "d", "t")).alias("first"), F.any_value("keys").alias("keys"), F.any_value("print").alias("print"))
    distinct = materialise(distinct, "contents")
    made = [found, distinct]
    made.append(components(links(rows, distinct, least, made)))
    roots = made[-1].withColumnRenamed("node", "content")
    out = found.select("z", "d", "t", "content").join(roots, "content", "left").select("z", "d", "t", F.coalesce("root", "content").alias("root"))
    out = materialise(out, "group-members")
    for table in made:
        discard(table)
    return out


def kept(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with all columns: the first by (doc_id, hash of the text), null ids last."""
    found = members(docs, least)
    out = first_rows(docs, found)
    discard(found)
    return out
