"""Quality of documents by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. A symbol of a chunk is
a byte, or padding after the text's end; nothing else enters. Learned filters over
``WIDTH`` symbols are max-pooled over each chunk; a dense layer turns the pooled
features into the chunk's logit, and the mean of a text's logits gives one
probability. Because only the place of a filter's maximum has a gradient, training
is cheap: a filter is a table from (place, symbol) to a weight.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample, training_rows
from .text import grouped
from .workspace import pick, share, shared

#: Labelled documents of either class that the network is fitted on, at most; all chunks of each.
PER_CLASS = 1200
CHUNK, OVERLAP, WIDTH, FILTERS = 512, 64, 5, 16
PAD, SYMBOLS = 256, 257
EPOCHS, RATE, SEED = 12, 0.02, 11
BUDGET = 1 << 20
#: Chunks held as symbols at once.
SLICE = 256


class Chunks:
    """The chunks of several texts, made into symbols a slice at a time."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        step = CHUNK - OVERLAP
        self.per = np.maximum(1, -(-(sizes - OVERLAP) // step))
        #: The text each chunk is of.
        self.of = np.repeat(np.arange(len(texts)), self.per)
        number = np.arange(self.per.sum()) - np.repeat(np.cumsum(self.per) - self.per, self.per)
        self.begin, self.stop = first[self.of] + number * step, (first + sizes)[self.of]

    def symbols(self, chosen) -> np.ndarray:
        """chunks x (CHUNK + WIDTH - 1) symbols of some chunks."""
        at = self.begin[chosen][:, None] + np.arange(CHUNK + WIDTH - 1)
        inside = at < self.stop[chosen][:, None]
        return np.where(inside, self.data[np.minimum(at, len(self.data) - 1)], np.int16(PAD))


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
        self.dense = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled features of chunks, and the places of the maxima."""
        value = np.empty((len(chunks), FILTERS), np.float32)
        place = np.empty((len(chunks), FILTERS), np.int64)
        for a in range(0, len(chunks), 64):
            part = chunks[a : a + 64]
            total = self.filters[0][part[:, :CHUNK]]
            for k in range(1, WIDTH):
                total += self.filters[k][part[:, k : k + CHUNK]]
            best = total.argmax(axis=1)
            place[a : a + 64] = best
            value[a : a + 64] = np.take_along_axis(total, best[:, None, :], 1)[:, 0]
        return np.tanh(value), place

    def logits(self, chunks: Chunks) -> np.ndarray:
        """The mean logit of each text's chunks."""
        total = np.zeros(len(chunks.per))
        for a in range(0, len(chunks.of), SLICE):
            part = slice(a, a + SLICE)
            total += np.bincount(chunks.of[part], self.pooled(chunks.symbols(part))[0] @ self.dense, len(total))
        return total / chunks.per + self.bias[0]

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(Chunks(texts)), -30, 30)))

    def train(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam on the weighted log-loss of documents."""
        rng = np.random.default_rng(SEED)
        params = [self.filters, self.dense, self.bias]
        first, second = [[np.zeros_like(p) for p in params] for _ in range(2)]
        t = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(y))
            for a in range(0, len(order), 48):
                docs = order[a : a + 48]
                chunks = Chunks([texts[d] for d in docs])
                own, share = chunks.of, 1 / chunks.per
                parts = [slice(k, k + SLICE) for k in range(0, len(own), SLICE)]
                found = [self.pooled(chunks.symbols(p)) for p in parts]
                value = np.concatenate([f[0] for f in found])
                logit = np.bincount(own, value @ self.dense, len(docs)) * share + self.bias[0]
                error = weight[docs] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[docs]) / len(docs)
                each = (error * share)[own].astype(np.float32)
                g_value = each[:, None] * self.dense * (1 - value * value)
                g_filters = np.zeros_like(self.filters)
                for p, (_, place) in zip(parts, found, strict=True):
                    symbols, f = chunks.symbols(p), np.broadcast_to(np.arange(FILTERS), place.shape)
                    for k in range(WIDTH):
                        np.add.at(g_filters[k], (np.take_along_axis(symbols, place + k, 1), f), g_value[p])
                grads = [g_filters, value.T @ each, np.array([error.sum()], np.float32)]
                t += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, fold, per_class: int = PER_CLASS) -> Network:
    """The network of the labelled documents outside ``fold``; without labels it is untrained.

    Classes are weighted by their shares of all labels, so that probabilities are calibrated to them.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~fold)
    share = known.agg(F.avg("quality").alias("s")).first()["s"]
    rows = training_rows(docs, sample(labels, "quality", fold, per_class)).collect()  # at most 2 * per_class rows
    rows.sort(key=lambda r: (r["y"], r["text"] or ""))
    network = Network()
    if rows:
        y = np.array([r["y"] for r in rows], np.float64)
        share = float(np.clip(share, 0.05, 0.95))
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        network.train([(r["text"] or "").encode() for r in rows], y, weight)
    return network


def _score(network):
    def run(batches):
        import pyarrow as pa

        model = shared(network)
        for texts, rest in grouped(batches, BUDGET, ["doc_id"]):
            yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"], pa.int64()), pa.array(model.probability(texts), pa.float64())], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Labels are learnt from rows whose crc32 modulo ``folds`` isn't ``held``. Null
    and empty texts are one chunk of padding. A null doc_id is not held out.
    Repeated rows each give a row; other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text")
    network = fit(docs, pick(labels, "doc_id", "quality"), remainder(F.col("doc_id"), folds) == held)
    out = docs.mapInArrow(_score(share(docs.sparkSession, network)), "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
