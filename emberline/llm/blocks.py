"""Texts stored in blocks, which ask buckets of keys for something and read replies without keys.

A block is one row: its texts compressed together. A task works out a block's sorted
distinct keys, sends each bucket (the keys' first bits) its run of them, and gets one
reply for each run, in order. So a reply holds no keys, and no text moves with one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .text import U64, Words, grouped
from .workspace import materialise, written_bytes

SCHEMA = "block long, doc_id array<bigint>, held_out array<boolean>, size array<int>, texts binary"


def packed(values: np.ndarray, kind: str = "<i8") -> bytes:
    """Integers, the lowest byte of each first, then the next ones: most of these are alike and compress well."""
    import pyarrow as pa

    raw = np.ascontiguousarray(values, kind)
    raw = raw.view(np.uint8).reshape(-1, raw.dtype.itemsize).T.tobytes()
    return pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(data: bytes, n: int, kind: str = "<i8") -> np.ndarray:
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, size * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, with their number in front."""
    return len(keys).to_bytes(8, "little") + packed(np.diff(keys, prepend=U64(0)), "<u8")


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data[8:], int.from_bytes(data[:8], "little"), "<u8"), dtype=U64)


def runs(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of each bucket's run in ascending keys."""
    to = (keys >> U64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    return list(zip(to[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True))


def store(docs: DataFrame, budget: int, name: str) -> DataFrame:
    """``docs`` (doc_id, text and perhaps held_out) as blocks of about ``budget`` bytes, written."""
    more = [c for c in ("held_out",) if c in docs.columns]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        for texts, rest in grouped(batches, budget, ["doc_id", *more]):
            held = rest.get("held_out") or [False] * len(texts)
            squeezed = pa.Codec("zstd").compress(b"".join(texts), asbytes=True)
            columns = [pa.array([block], pa.int64()), pa.array([rest["doc_id"]], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([squeezed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "held_out", "size", "texts"])
            block += 1

    return materialise(docs.mapInArrow(run, SCHEMA), name)


def bucket_bits(table: DataFrame, bucket_bytes: int) -> int:
    """Bits that name a bucket if each has about ``bucket_bytes`` of a ``store``'s text, which takes a third of its bytes there."""
    return int(np.clip(int(np.log2(max(3 * written_bytes(table) // bucket_bytes, 1))) + 1, 4, 24))


def words(table, row: int = 0, lower: bool = False) -> tuple[int, Words]:
    """A stored block's number and the words of its texts."""
    import pyarrow as pa

    sizes = table.column("size")[row].as_py()
    data = pa.Codec("zstd").decompress(table.column("texts")[row].as_py(), sum(sizes), asbytes=True)
    ends = np.cumsum([0, *sizes]).tolist()
    return table.column("block")[row].as_py(), Words([data[a:b] for a, b in zip(ends, ends[1:], strict=False)], lower)
