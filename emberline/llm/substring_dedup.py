"""Removal of word sequences that repeat anywhere in the corpus, by suffix automata.

A window is ``length`` consecutive words of a text. All words covered by a window
whose sequence also starts elsewhere are removed, wherever it stands first.

1. Every window is named by the least hash of the shorter runs of words in it; equal
   windows have equal names, so only windows whose name occurs at two places can be
   repeated. Blocks of texts send each name once.
2. The remaining windows' hashes are counted in the same way. The first block with a
   repeated window holds its reference; a block's references, joined to passages,
   are a reference shard, bounded by the block's size.
3. Each shard's passages become a suffix automaton, and the runs of repeated windows
   that refer to it are streamed through it for matching statistics: where the
   longest match that ends at a word has ``length`` words or more, they are removed.

A block is stored as one row of compressed texts. Replies to a block hold no keys: it
hashes its texts again and finds the same keys in the same order.

Passages grow with the corpus, so automata are not broadcast to all workers but go to
the tasks that hold a shard's runs. Runs of equal words are one run there; a shard with
many different runs is given to several tasks, and a long passage is cut into parts that
share all but one word of a window, so that no automaton outgrows ``PART`` words by much.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import packed, unpacked
from .text import U64, Words, mix, sequence_hashes
from .workspace import discard, materialise, pick, salted_join

#: Fixed value of the task: words in a window.
LENGTH = 35
#: Words of the runs that name a window.
RUN = 20
BLOCK = 2 << 20
BUCKET_BYTES = 32 << 20
#: Least words streamed by one task through a part of a shard, words of such a part, and most windows of a run.
STREAM, PART, PIECE = 20_000, 300_000, 50_000


class Automaton:
    """A suffix automaton of several sequences; matches never span two of them."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def add(self, sequence: list[int]) -> None:
        following, link, size = self.next, self.link, self.size
        last = 0
        for c in sequence:
            q = following[last].get(c)
            if q is not None:  # known from an earlier sequence
                last = q if size[q] == size[last] + 1 else self._clone(last, q, c)
                continue
            new, p = len(following), last
            following.append({})
            size.append(size[last] + 1)
            link.append(0)
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, c)
            last = new

    def matches(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Spans [start, stop) covered by matches of at least ``least`` words, joined."""
        following, link, size = self.next, self.link, self.size
        out: list[tuple[int, int]] = []
        state = matched = 0
        for i, c in enumerate(sequence):
            while state and c not in following[state]:
                state = link[state]
                matched = size[state]
            to = following[state].get(c)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= least:
                start = i - matched + 1
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, i + 1))
        return out


def _valid(words: Words, length: int) -> np.ndarray:
    """For each word, whether a window starts there and stays in its text."""
    n = len(words.start)
    last = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(n) + length <= last


def window_names(hashes: np.ndarray, valid: np.ndarray, length: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows that start at each word (where valid), and the runs that name one."""
    n, width = len(hashes), length - run + 1
    runs = np.full(n + width, U64(2**64 - 1))
    found = sequence_hashes(hashes, run)
    runs[: len(found)] = found
    low, step = runs.copy(), 1
    while step < width:
        by = min(step, width - step)
        low[:-by] = np.minimum(low[:-by], low[by:])
        step += by
    names = low[:n]
    # a run names a window if it equals the greatest name among the windows that contain it
    high = np.concatenate((np.zeros(width - 1, U64), np.where(valid, names, U64(0))))
    step = 1
    while step < width:
        by = min(step, width - step)
        high[by:] = np.maximum(high[by:], high[:-by])
        step += by
    return names, np.flatnonzero(high[width - 1 : width - 1 + n] == runs[:n])


def _by_bucket(block: int, keys: np.ndarray, bits: int):
    """Rows (block, bucket, keys, twice) of keys that may repeat; twice marks those that do here."""
    import pyarrow as pa

    unique, count = np.unique(keys, return_counts=True)
    to = (unique >> U64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
    bounds = [*cuts, len(to)]
    twice = (count > 1).astype(np.uint8)
    pairs = list(zip(bounds, bounds[1:], strict=False))
    return pa.table({"block": pa.array([block] * len(pairs), pa.int64()), "bucket": pa.array(to[cuts], pa.int32()), "keys": pa.array([unique[a:b].tobytes() for a, b in pairs], pa.binary()), "twice": pa.array([twice[a:b].tobytes() for a, b in pairs], pa.binary())})


ASK = "block long, bucket int, keys binary, twice binary"
TELL = "block long, bucket int, windows boolean, first binary"


def _repeated(windows: bool):
    """To each block, for its keys in order, the first block that has each; -1 for keys that occur once in all."""

    def run_(table):
        import pyarrow as pa

        blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
        keys = [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
        twice = np.concatenate([np.frombuffer(t, np.uint8) for t in table.column("twice").to_pylist()])
        sizes = np.array([len(k) for k in keys])
        unique, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, weights=1.0 + twice, minlength=len(unique))
        first = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(first, back, np.repeat(np.array(blocks), sizes))
        first[count < 2] = -1
        out, at = [], 0
        for block, bucket, n in zip(blocks, buckets, sizes.tolist(), strict=True):
            own = first[back[at : at + n]]
            at += n
            if (own >= 0).any():
                out.append((block, bucket, windows, packed(own)))
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["block", "bucket", "windows", "first"])

    return run_


def _answers(keys: np.ndarray, told, windows: bool, bits: int) -> np.ndarray:
    """For each of a block's sorted keys, the first block that has it, -1 if it occurs once in all."""
    first = np.full(len(keys), -1)
    to = (keys >> U64(64 - bits)).astype(np.int64)
    buckets = told.column("bucket").to_numpy()
    starts, stops = np.searchsorted(to, buckets), np.searchsorted(to, buckets, "right")
    for kind, a, b, data in zip(told.column("windows").to_pylist(), starts.tolist(), stops.tolist(), told.column("first").to_pylist(), strict=True):
        if kind == windows:
            first[a:b] = unpacked(data, b - a)
    return first


def _places(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in sorted keys, -1 where it isn't among them."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _name_keys(h: np.ndarray, valid: np.ndarray, length: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows that start at each word, and a block's names as it asks for them.

    Names are least hashes, so they are mixed anew to spread evenly over buckets.
    """
    names, chosen = window_names(h, valid, length, run)
    runs = sequence_hashes(h, run)
    return mix(names), mix(runs[chosen[chosen < len(runs)]])


def _candidates(words: Words, told, bits: int, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes, windows' hashes, and for each window whether its name occurs twice or more in all."""
    h, valid = words.hashes(), _valid(words, length)
    names, keys = _name_keys(h, valid, length, run)
    keys = np.unique(keys)
    windows = sequence_hashes(h, length)
    n = len(windows)
    return h, windows, valid[:n] & (_places(keys[_answers(keys, told, False, bits) >= 0], names[:n]) >= 0)


def _names(bits: int, length: int, run: int):
    def run_(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block, words = blocks.words(batch, row)
                _, keys = _name_keys(words.hashes(), _valid(words, length), length, run)
                yield from _by_bucket(block, keys, bits).to_batches()

    return run_


def _windows(bits: int, length: int, run: int):
    def run_(docs, told):
        import pyarrow as pa

        if not docs.num_rows or not told.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "twice": pa.array([], pa.binary())})
        block, words = blocks.words(docs)
        _, windows, may = _candidates(words, told, bits, length, run)
        return _by_bucket(block, windows[may], bits)

    return run_


SPANS = "shard long, block long, ord int, start int, part int, words binary"


def _spans(bits: int, length: int, run: int):
    """Reference passages (ord null) of this block, and its runs of repeated windows by the shard they refer to."""

    def run_(docs, told):
        import pyarrow as pa

        out: list[tuple] = []
        if docs.num_rows and told.num_rows:
            block, words = blocks.words(docs)
            h, windows, may = _candidates(words, told, bits, length, run)
            keys = np.unique(windows[may])
            first = _answers(keys, told, True, bits)
            at = np.where(may, _places(keys[first >= 0], windows), -1)
            found = np.flatnonzero(at >= 0)
            shard = first[first >= 0][at[found]]
            owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
            raw = h.astype("<u8")

            def runs(place: np.ndarray, to: np.ndarray):
                if not len(place):
                    return
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (np.diff(to) != 0) | (np.diff(owner[place]) != 0))))
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True):
                    for x in range(a, b, PIECE):  # every window lies in one piece
                        yield int(place[x]), int(place[min(x + PIECE, b) - 1]) + length, int(to[x])

            own = found[shard == block]
            own = np.sort(own[np.unique(windows[own], return_index=True)[1]])  # the first of each here
            size = 0
            for a, b, _ in runs(own, np.full(len(own), block)):
                out.append((block, block, None, None, size // PART, raw[a:b].tobytes()))
                size += b - a
            for a, b, to in runs(found, shard):
                doc = int(owner[a])
                out.append((to, block, doc, a - int(words.first[doc]), None, raw[a:b].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["shard", "block", "ord", "start", "part", "words"])

    return run_


MATCHED = "shard long, run binary, a int, b int"


def _match(length: int):
    """Covered spans of a shard's distinct runs, by the automaton of some of its passages."""

    def run_(table):
        import pyarrow as pa

        automaton, queries, shard = Automaton(), [], table.column("shard")[0].as_py()
        for run, words in zip(table.column("run").to_pylist(), table.column("words").to_pylist(), strict=True):
            if run is None:
                automaton.add(np.frombuffer(words, "<u8").tolist())
            else:
                queries.append((run, words))
        out = [(run, a, b) for run, words in queries for a, b in automaton.matches(np.frombuffer(words, "<u8").tolist(), length)]
        return pa.table([pa.array([shard] * len(out), pa.int64()), *[pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.int32()))]], ["shard", "run", "a", "b"])

    return run_


def _kept(docs, spans):
    """Each text's remaining words, joined by one space."""
    import pyarrow as pa

    names = ["doc_id", "text", "n_words", "n_removed"]
    if not docs.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64())], names)
    _, words = blocks.words(docs)
    n = len(words.start)
    edge = np.zeros(n + 1, np.int64)
    for o, a, b in zip(*(spans.column(c).to_pylist() for c in ("ord", "a", "b")), strict=True):
        first = words.first[o]
        edge[first + a] += 1
        edge[first + b] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[words.start[~gone]] += 1
    mark[words.end[~gone]] -= 1
    inside = np.cumsum(mark[:-1]).astype(bool)
    follow = np.zeros(len(words.data), bool)
    follow[words.end[~gone]] = True
    joined = np.where(inside, words.data, 32).astype(np.uint8)[inside | follow].tobytes()
    sizes = (words.end - words.start + 1) * ~gone
    at = np.concatenate(([0], np.cumsum(sizes)))
    bounds = at[words.first]
    texts = [joined[a : max(a, b - 1)] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
    removed = np.concatenate(([0], np.cumsum(gone)))[words.first]
    return pa.table([pa.array(docs.column("doc_id")[0].as_py(), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(removed), pa.int64())], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, run: int = RUN) -> DataFrame:
    """doc_id, text (remaining words, joined by one space), n_words, n_removed: one row per row of ``docs``.

    Null and empty texts have no words. Rows that repeat a text are texts like any
    other, so from ``length`` words on nothing of them stays. Sequences repeated
    within one text go too. Extra columns are ignored.
    """
    if run > length:
        raise ValueError("run must not exceed length")
    store = blocks.store(pick(docs, "doc_id", "text"), BLOCK, "blocks")
    bits = blocks.bucket_bits(store, BUCKET_BYTES)
    by_block = store.groupBy("block")
    names = materialise(store.mapInArrow(_names(bits, length, run), ASK).groupBy("bucket").applyInArrow(_repeated(False), TELL), "names")
    asked = by_block.cogroup(names.groupBy("block")).applyInArrow(_windows(bits, length, run), ASK)
    found = materialise(asked.groupBy("bucket").applyInArrow(_repeated(True), TELL), "windows")
    told = names.unionByName(found)
    spans = materialise(by_block.cogroup(told.groupBy("block")).applyInArrow(_spans(bits, length, run), SPANS), "spans")
    discard(names, found)
    # runs of equal words are matched once, however many places have them
    places = spans.filter("ord IS NOT NULL").withColumn("run", F.unhex(F.md5("words")))
    runs = materialise(places.groupBy("shard", "run").agg(F.any_value("words").alias("words")), "runs")
    passages = spans.filter("ord IS NULL").select("shard", F.lit(None).cast("binary").alias("run"), "part", "words")
    n = F.sum(F.length("words") / 8)
    parts = passages.groupBy("shard").agg((F.max("part") + 1).alias("parts"), n.alias("held"))
    # a task streams about as many words as its automaton holds, so that more tasks cost no more than twice as much
    load = runs.groupBy("shard").agg(n.alias("streamed")).join(parts, "shard")
    load = load.select("shard", "parts", F.ceil(F.col("streamed") / F.greatest(F.col("held") / F.col("parts"), F.lit(STREAM))).cast("int").alias("tasks"))
    load = materialise(load, "shards")
    runs = salted_join(runs, load, ["shard"], "inner").withColumn("task", F.pmod(F.xxhash64("run"), F.col("tasks")).cast("int"))
    runs = runs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    passages = salted_join(passages, load, ["shard"], "inner").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    both = runs.unionByName(passages).select("shard", "task", "part", "run", "words")
    matched = both.groupBy("shard", "task", "part").applyInArrow(_match(length), MATCHED)
    matched = matched.groupBy("shard", "run").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    covered = salted_join(places.select("shard", "run", "block", "ord", "start"), materialise(matched, "matched"), ["shard", "run"], "inner")
    covered = covered.select("block", "ord", "start", F.explode("spans").alias("s"))
    covered = materialise(covered.select("block", "ord", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b")), "covered")
    discard(spans, load)
    return by_block.cogroup(covered.groupBy("block")).applyInArrow(_kept, "doc_id long, text string, n_words long, n_removed long")
