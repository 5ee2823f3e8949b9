"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

Every text gets a 64-bit fingerprint; distinct fingerprints that differ in at most
``radius`` bits are linked, and components of links are near-duplicate groups.
Fingerprints are dealt into shards by parts of their bits: cut into radius + 2
parts, any two within the radius agree on at least two parts, so each pair meets
in the shard of those two. A shard builds a BK-tree (children keyed by their
Hamming distance to the parent) and looks up each fingerprint along the edges
within the radius only. A shard passes on the links that join its local
components, never all pairs; copies share a fingerprint and never multiply links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ROWS_AT_ONCE, U64, Words, grouped, mix
from .workspace import discard, materialise, pick, salted_join, small_side

#: Fixed values of the task: words in a shingle, seed of its hash, bits of a link.
SHINGLE, SEED, RADIUS = 3, 42, 2
BUDGET = 2 << 20
BITS_AT_ONCE = 100_000
#: 64-bit words of a wide fingerprint, hashes counted at once, most of them in one sum of byte lanes.
WIDE, WIDE_AT_ONCE, LANE = 4, 8160, 255
#: A byte's bits, the highest first, in eight lanes of a byte each.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U64).ravel()


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of texts: a bit is set if over half of the shingles' hashes have it."""
    import xxhash

    words = Words(texts, lower=True)
    length = words.end - words.start
    at = np.concatenate(([0], np.cumsum(length + 1)))  # words with one space after each
    is_word = np.zeros(len(words.data) + 1, np.int8)
    is_word[words.start] += 1
    is_word[words.end] -= 1
    inside = np.cumsum(is_word[:-1]).astype(bool)
    follows = np.zeros(len(words.data), bool)
    follows[words.end] = True
    joined = np.where(inside, words.data, 32)[inside | follows].astype(np.uint8).tobytes()
    per_text = np.diff(words.first)
    count = np.where(per_text == 0, 0, np.maximum(per_text - shingle + 1, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    begin = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    last = np.minimum(begin + shingle, np.repeat(words.first[1:], count)) - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    spans = zip(at[begin].tolist(), (at[last] + length[last]).tolist(), strict=True)
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in spans), U64, first[-1])
    ones = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    for a in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[a : a + BITS_AT_ONCE]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.flatnonzero(np.diff(owner[a : a + BITS_AT_ONCE], prepend=-1))
        ones[owner[a + cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > count[:, None], axis=1).view(">u8").astype(U64).ravel()


def wide_fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of 64 * ``WIDE`` bits, one row of bytes for each text; text i has hashes first[i] up to first[i + 1], each counted once."""
    hashes = hashes.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[a:b].sort()
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    ones = np.zeros((len(first) - 1, 64 * WIDE), np.int64)
    for a in range(0, len(hashes), WIDE_AT_ONCE):
        part, own = hashes[a : a + WIDE_AT_ONCE], owner[a : a + WIDE_AT_ONCE]
        drawn = np.stack([mix(part + U64(k)) for k in range(1, WIDE + 1)], axis=1).view(np.uint8)
        cut = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.arange(len(own)) % LANE == 0))
        sums = np.add.reduceat(LANES[drawn], cut, axis=0).view(np.uint8)
        begin = np.flatnonzero(np.diff(own[cut], prepend=-1))
        ones[own[cut][begin]] += np.add.reduceat(sums, begin, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > np.bincount(owner, minlength=len(ones))[:, None], axis=1)


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for texts, rest in grouped(batches, BUDGET, ["doc_id", "z", "d", "t"]):
            found = fingerprints(texts, shingle, seed).view(np.int64)
            ids = [pa.array(rest[c], ty) for c, ty in (("doc_id", pa.int64()), ("z", pa.int32()), ("d", pa.int64()), ("t", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(found)], ["doc_id", "z", "d", "t", "print"])

    return run


class BKTree:
    """A tree of integers under the Hamming distance."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes at most ``radius`` bits from ``value``."""
        found, stack = [], [0] if self.nodes else []
        while stack:
            k = stack.pop()
            own, children = self.nodes[k]
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(k)
            for edge in range(max(1, d - radius), d + radius + 1):
                if edge in children:
                    stack.append(children[edge])
        return found

    def nearest(self, value: int, radius: int) -> int | None:
        """Number of a node at most ``radius`` bits from ``value`` that none is nearer to."""
        found, stack = None, [(0, 0)] if self.nodes else []
        while stack:
            bound, k = stack.pop()
            if bound > radius:
                continue
            own, children = self.nodes[k]
            d = (own ^ value).bit_count()
            if d <= radius:
                found, radius = k, d - 1
            stack.extend((abs(edge - d), child) for edge, child in children.items() if abs(edge - d) <= radius)
        return found

    def add(self, value: int) -> int:
        number = len(self.nodes)
        if number:
            k = 0
            while True:
                own, children = self.nodes[k]
                d = (own ^ value).bit_count()
                if d not in children:
                    children[d] = number
                    break
                k = children[d]
        self.nodes.append((value, {}))
        return number


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the values' components, found by a BK-tree of them."""
    tree, parent, out = BKTree(), [], []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for value in values:
        near = tree.within(value, radius)
        own = tree.add(value)
        parent.append(own)
        for k in near:
            a, b = root(k), root(own)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((value, tree.nodes[k][0]))
    return out


def shard_pairs(prints: dict[int, int], hubs: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs of keys of ``prints`` with fingerprints at most ``radius`` bits apart, found by a BK-tree of these.

    All of them without ``hubs``. With some: every key's pairs with hubs, and one with the nearest key before it.
    """
    tree, alike, out = BKTree(), [], []
    middle, at_middle = BKTree(), []

    def insert(into: BKTree, keys: list, key: int, value: int, equal: int | None) -> None:
        if equal is not None and into.nodes[equal][0] == value:
            keys[equal].append(key)
        else:
            into.add(value)
            keys.append([key])

    for key in [*hubs, *(k for k in prints if k not in hubs)]:
        value = prints[key]
        nearest = tree.nearest(value, radius)
        if not hubs:
            out.extend((key, other) for k in (tree.within(value, radius) if nearest is not None else ()) for other in alike[k])
        else:
            out.extend((key, other) for k in middle.within(value, radius) for other in at_middle[k])
            if nearest is not None:
                out.append((key, alike[nearest][-1]))
            if key in hubs:
                insert(middle, at_middle, key, value, middle.nearest(value, 0))
        insert(tree, alike, key, value, nearest)
    return out


def tree_pairs(radius: int):
    """u, v: ``shard_pairs`` of each run of rows with equal (key, block); the runs come sorted. Rows have content, hub and print."""

    def run(batches):
        import pyarrow as pa

        key, prints, hubs, u, v = None, {}, [], [], []

        def search():
            if len(prints) > 1:
                for a, b in shard_pairs(prints, hubs, radius):
                    u.append(min(a, b))
                    v.append(max(a, b))

        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE)):
            columns = (batch.column(c).to_pylist() for c in ("key", "block", "content", "hub", "print"))
            for k, block, content, hub, value in zip(*columns, strict=True):
                if (k, block) != key:
                    search()
                    key, prints, hubs = (k, block), {}, []
                prints[content] = int.from_bytes(value, "big")
                if hub and content not in hubs:
                    hubs.append(content)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v)], ["u", "v"])
            u, v = [], []
        search()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v)], ["u", "v"])

    return run


def _shards(radius: int):
    """Links of each run of rows with equal (part, value); the runs come sorted."""

    def run(batches):
        import pyarrow as pa

        key, values = None, []

        def links():
            found = shard_links(values, radius) if len(values) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.uint64()).view(pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            part, value = batch.column("part").to_numpy(), batch.column("value").to_numpy()
            prints = batch.column("print").to_numpy().view(U64)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(part)] if len(part) else []
            for a, b in zip(bounds, bounds[1:], strict=False):
                now = (part[a], value[a])
                if now != key:
                    if len(values) > 1:
                        yield links()
                    key, values = now, []
                values.extend(prints[a:b].tolist() if b - a > 1 or values else [int(prints[a])])
        yield links()

    return run


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root) of every linked node; the root is the least node.

    Alternates two star steps, each a group minimum and a join by node, until a
    round changes nothing: until the number of links and a sum and an exclusive or of
    their hashes stay the same. Every round is written to the shared folder.
    """

    def state(table: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(table.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())

    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = materialise(links.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "links")
    was = state(now)
    while True:
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), "m").filter("a <> m").toDF("u", "v").union(least.toDF("u", "v")).distinct()
        new = materialise(small, "links")
        discard(now)
        now, before = new, was
        was = state(now)
        if was == before:
            named = now.toDF("node", "root")
            named._emberline_path = now._emberline_path
            return named


def row_key(doc_id, text) -> list:
    """z, d, t of a row: whether its id is null, its id, a hash of its text."""
    return [doc_id.isNull().cast("int").alias("z"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")]


def first_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``members``, with all columns.

    ``members`` has z, d, t (see ``row_key``) and root of every row. The least
    (z, d, t) of a root stays; rows that share it are copies, and any one stays.
    """
    n = materialise(members.groupBy("z", "d", "t").agg(F.any_value("root").alias("root"), F.count("*").alias("n")), "members")
    least = n.groupBy("root").agg(F.min(F.struct("z", "d", "t")).alias("least"), F.count("*").alias("k")).filter("k > 1")
    least = materialise(least, "least-rows")
    marked = n.join(small_side(least), "root", "left").select("z", "d", "t", "n", (F.col("k").isNotNull() & (F.struct("z", "d", "t") != F.col("least"))).alias("gone"))
    marked = small_side(materialise(marked.filter("gone OR n > 1"), "marked-rows"))
    discard(n)
    discard(least)
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(whole.alias("row"), *row_key(docs["doc_id"], docs["text"]))
    out = rows.join(marked, ["z", "d", "t"], "left_anti").select("row")
    copies = marked.filter("NOT gone")
    if not copies.isEmpty():
        out = out.unionAll(rows.join(copies, ["z", "d", "t"]).groupBy("z", "d", "t").agg(F.any_value("row").alias("row")).select("row"))
    return out.select("row.*")


def _rooted(docs: DataFrame, shingle: int, seed: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, z, d, t, print) of every row, and (print, low, n, root) of every fingerprint."""
    rows = pick(docs, "doc_id", "text").select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    prints = materialise(rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, z int, d long, t long, print long"), "prints")
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    distinct = materialise(distinct, "distinct")
    parts = radius + 2
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    masks = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(parts)]
    pairs = [masks[a] | masks[b] for a, b in combinations(range(parts), 2)]
    signed = [m - 2**64 if m >= 2**63 else m for m in pairs]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])
    dealt = distinct.select("print", F.explode(keys).alias("k")).select("k.part", "k.value", "print")
    dealt = dealt.repartition("part", "value").sortWithinPartitions("part", "value")
    roots = components(dealt.mapInArrow(_shards(radius), "u long, v long"))
    named = distinct.join(roots, distinct["print"] == roots["node"], "left").withColumn("root", F.coalesce("root", "print"))
    return prints, named.select("print", "low", "n", "root")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    component_id is the least doc_id that links reach. Null, empty and blank texts
    have fingerprint zero and are linked like any other. A null doc_id is never a
    component_id unless its component has no other. Rows that repeat a doc_id each
    give a row. Other columns are ignored; an empty table gives no rows.
    """
    prints, named = _rooted(docs, shingle, seed, radius)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("size")).filter("size > 1")
    lows = materialise(named.select("print", "root").join(lows, "root").select("print", "component_id"), "component-ids")
    out = salted_join(prints, lows, ["print"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with all columns: the first by (doc_id, hash of the text), null ids last."""
    prints, named = _rooted(docs, shingle, seed, radius)
    roots = materialise(named.select("print", "root"), "print-roots")
    return first_rows(docs, salted_join(prints, roots, ["print"]).select("z", "d", "t", "root"))
