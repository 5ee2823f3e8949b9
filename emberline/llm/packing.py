"""Harmonic packing of tokenised documents into sequences of fixed capacity.

What exceeds the capacity is cut off a document in whole sequences. The rest, of
length r, belongs to the reciprocal class k = capacity // r, whose bins hold k
documents each. Such a bin leaves room for less than any document of its class, so
the next document of the class is cut once to fill it, and what remains of that one
goes to the class of its new length. Every worker fills its classes' bins alone:
nothing is shuffled, and no state outgrows one open bin for each class, of which
there are about twice the capacity's square root. At a task's end the open bins are
filled up from each other, those of long documents first; the last ids are cut into
sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import os
import string
import sys
import types
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .text import U64, Words, grouped, span_hashes
from .workspace import pick

#: Fixed values of the task: ids in a sequence, and the id after each document.
CAPACITY, END_ID = 4096, 2
BUDGET = 1 << 20
#: Pieces of text that a worker remembers, and ids of theirs, after which it begins anew.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 4 << 20
#: Words of letters that are encoded as one text.
JOINED = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Byte classes: 1 for ASCII letters and digits, 2 for ASCII punctuation.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokens:
    """Ids of texts by a tokenizer that never joins across white space.

    A text is looked up in parts: it is cut at ASCII white space and between an
    ASCII letter or digit and the punctuation after it, where the tokenizer's own
    pattern always cuts; parts met before aren't encoded again. A text that holds
    a special token's string is encoded whole. Where the tokenizer lowers letters,
    parts are looked up with A-Z lowered. Where its last token of a word is marked,
    new words of letters are encoded joined by spaces and told apart by that mark.
    """

    WORD_END = "</w>"

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id = end_id
        normal, upper = self.tokenizer.normalizer, string.ascii_uppercase
        self.lowers = normal is not None and normal.normalize_str(upper) == upper.lower()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self.marked = sum(len(t) == len(self.WORD_END) + 1 for t in vocabulary if t.endswith(self.WORD_END)) >= 256
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, U64)  # ascending
        self.place = np.empty(0, np.int64)
        self.ids = np.full(1 << 16, self.end_id, np.uint32)  # the first is the end
        self.used = 1

    def lowered(self, data: np.ndarray) -> np.ndarray:
        """Bytes with A-Z lowered, but for those before a non-ASCII byte, which may be an accent to compose with."""
        if not self.lowers:
            return data
        upper = np.flatnonzero((data[:-1] >= 65) & (data[:-1] <= 90) & (data[1:] < 128))
        data = data.copy()
        data[upper] += 32
        return data

    def learn(self, keys: np.ndarray, parts: list[str]) -> None:
        """Encode the parts and keep their ids."""
        letters = [self.marked and p.isalpha() for p in parts]
        words = [i for i, yes in enumerate(letters) if yes]
        single = [i for i, yes in enumerate(letters) if not yes]
        groups = [words[a : a + JOINED] for a in range(0, len(words), JOINED)]
        joined = self.tokenizer.encode_batch_fast([" ".join([parts[i] for i in g]) for g in groups], add_special_tokens=False)
        whole, found, sizes = [], [], []
        for group, encoded in zip(groups, joined, strict=True):
            ids = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):  # every word is one word to the tokenizer too
                whole += group
                found.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                single += group
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([parts[i] for i in single], add_special_tokens=False)]
        found.append(np.array([x for ids in alone for x in ids], np.uint32))
        sizes.append(np.array(list(map(len, alone)), np.int64))
        self.store(keys[whole + single], np.concatenate(found), np.cumsum(np.concatenate(sizes)))

    def store(self, keys, ids: np.ndarray, ends: np.ndarray) -> None:
        """Keep the ids of several parts not kept yet, which end at ``ends``."""
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(need, np.uint32)))
        self.ids[self.used : need] = ids
        lengths = np.diff(ends, prepend=0)
        place = (self.used + ends - lengths) << 32 | lengths  # 31 bits for the offset, 32 for the length
        self.used = need
        keys = np.asarray(keys, U64)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.place = np.insert(self.keys, at, keys[order]), np.insert(self.place, at, place[order])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end after each text, and where each text's ids begin (one more than texts)."""
        if len(self.keys) > REMEMBERED or self.used > REMEMBERED_IDS:
            self.clear()
        odd = {i: t for i, t in enumerate(texts) if b"<|" in t and any(s in t for s in self.special)}
        words = Words([b"" if i in odd else t for i, t in enumerate(texts)])
        data = self.lowered(words.data)
        kind = _KIND[data]
        cuts = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
        start = np.sort(np.concatenate((words.start, cuts)))
        end = np.sort(np.concatenate((words.end, cuts)))
        first = np.searchsorted(start, np.append(words.text_start, len(data)))
        unique, at, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            known = self.keys[np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)] == unique
        unknown, blob = np.flatnonzero(~known), data.tobytes()
        for a in range(0, len(unknown), 20_000):
            some = unknown[a : a + 20_000]
            spans = zip(start[at[some]].tolist(), end[at[some]].tolist(), strict=True)
            self.learn(unique[some], [blob[x:y].decode("utf-8", "replace") for x, y in spans])
        place = self.place[np.searchsorted(self.keys, unique)]
        place = np.insert(place[back], first[1:], 1)  # position 0, one id: the end
        offset, length = place >> 32, place & 0xFFFFFFFF
        total = np.concatenate(([0], np.cumsum(length)))
        ids = self.ids[np.repeat(offset - total[:-1], length) + np.arange(total[-1])]
        bounds = total[np.concatenate(([0], first[1:] + np.arange(1, len(texts) + 1)))]
        if odd:
            lists = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            for i, t in odd.items():
                lists[i] = np.array([*self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, self.end_id], np.uint32)
            ids, bounds = np.concatenate(lists), np.concatenate(([0], np.cumsum(list(map(len, lists)))))
        return ids, bounds


def tokens(path: str, end_id: int) -> Tokens:
    """This worker's ``Tokens``; kept between tasks while the worker lives."""
    kept = sys.modules.setdefault("_emberline_tokens", types.ModuleType("_emberline_tokens")).__dict__
    if (path, end_id) not in kept:
        kept[path, end_id] = Tokens(path, end_id)
    return kept[path, end_id]


class Packer:
    """Bins of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, number: int):
        self.capacity, self.next = capacity, number << 36
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, whole in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), whole, self.next, at, ids))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole, at = len(ids), 0
        while whole - at >= self.capacity:
            self.close([(doc, at, ids[at : at + self.capacity], whole)])
            at += self.capacity
        while at < whole:
            k = self.capacity // (whole - at)
            held = self.open.setdefault(k, [])
            if len(held) < k:
                held.append((doc, at, ids[at:].copy(), whole))
                at = whole
            room = self.capacity - sum(len(p[2]) for p in held) if len(held) == k else -1
            if room > 0 and at < whole:
                held.append((doc, at, ids[at : at + room], whole))
                at, room = at + room, 0
            if room == 0:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        """Fill open bins from each other, those of the longest documents first."""
        rest = [p for k in sorted(self.open) for p in self.open[k]][::-1]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left, held = left - room, []
            while room:
                doc, start, ids, whole = rest.pop()
                held.append((doc, start, ids[:room], whole))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], whole))
                room -= len(held[-1][2])
            self.close(held)


def _pack(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
        packer = Packer(capacity, TaskContext.get().partitionId())

        def batch():
            rows, packer.rows = packer.rows, []
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
            names = schema.names
            if with_ids:
                bounds = np.cumsum([0, *[r[2] for r in rows]], dtype=np.int32)
                ids = np.concatenate([np.empty(0, "<u4"), *[r[7] for r in rows]]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)))
                names = [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        encoder = tokens(path, end_id)
        for texts, rest in grouped(batches, BUDGET, ["doc_id"]):
            ids, bounds = encoder.encode(texts)
            ids = ids.astype("<u4", copy=False)
            for doc, a, b in zip(rest["doc_id"], bounds.tolist(), bounds[1:].tolist(), strict=False):
                packer.add(doc, ids[a:b])
            yield batch()
        packer.finish()
        yield batch()

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``path`` names the tokenizer's file. A null or empty text is the end id alone.
    Rows that repeat a doc_id are packed each on their own; a null doc_id is kept
    as null. Other columns are ignored; an empty table gives no rows.
    """
    path = path or word_bpe_path()
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return pick(docs, "doc_id", "text").mapInArrow(_pack(path, capacity, end_id, with_ids), schema)
