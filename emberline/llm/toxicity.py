"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens get log-odds of the toxic against the other labelled documents, with an
informative Dirichlet prior drawn from both; a document counts a token once, so
that one burst isn't evidence. Every token of the sample has a score: its log-odds,
drawn to zero by the factor 1 - (CAUTION / z) ** 2 (zero where z is under CAUTION; z
is the signed root of the token's likelihood ratio), plus a small negative drift. Tokens
that the sample doesn't hold have the drift alone. A linear scan (Ruzzo and Tompa)
finds every maximal segment of a text.

The greatest segment of n tokens of ordinary text exceeds S with probability
1 - exp(-K n exp(-lambda S)); K and lambda are the maximum-likelihood fit to the
greatest segments of ordinary documents. A segment is significant if fewer than one
as good is expected in an ordinary text of its text's length, and the sum of the
significant segments' -log expectations gives the text's probability by a logistic
curve. K, lambda and the curve are fitted crosswise: each of ``PARTS`` parts of the
sample is scanned with log-odds learnt from the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample, training_rows
from .text import IS_MARK, U64, Words, grouped
from .workspace import discard, materialise, pick, share, shared

#: Labelled documents of either class that the model is fitted on, at most.
PER_CLASS = 8000
#: Mass of the prior in tokens; z score up to which log-odds count for nothing; score of a token without any.
PRIOR, CAUTION, DRIFT = 500.0, 3.0, -0.05
#: Parts of the sample for fitting crosswise.
PARTS = 5
BUDGET = 2 << 20
SCHEMA = "doc_id long, score double, passages array<struct<start:int,stop:int,score:double>>"


def segments(positions: list[int], weights: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, past the last, score), left to right.

    ``positions`` and ``weights`` are of the tokens that score; tokens between
    them score ``drift``. Ruzzo and Tompa's algorithm, over scored tokens only.
    """
    found: list[list] = []  # first, past the last, sum before, sum after
    total, last = 0.0, 0
    for p, w in zip(positions, weights, strict=True):
        total += drift * (p - last)
        last = p + 1
        if w <= 0:
            total += w
            continue
        new = [p, p + 1, total, total + w]
        total += w
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, d - c) for a, b, c, d in found]


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of tokens' counts with a Dirichlet prior, and signed roots of their likelihood ratios.

    The root of the likelihood ratio is a z score that holds for counts of zero.
    """
    both = toxic + other
    base = prior * both / max(both.sum(), 1.0)
    a, b = toxic + base, other + base
    score = np.log(a / (toxic.sum() + prior - a)) - np.log(b / (other.sum() + prior - b))
    share = toxic.sum() / max(both.sum(), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(toxic * np.log(toxic / (both * share)), nan=0.0) + np.nan_to_num(other * np.log(other / (both * (1 - share))), nan=0.0)
    return score, np.sign(score) * np.sqrt(np.maximum(2 * ratio, 0))


def weights(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Scores of tokens from the numbers of documents that hold them."""
    some = toxic + other > 0
    score, z = log_odds(toxic[some], other[some])
    out = np.full(len(toxic), DRIFT)
    out[some] += score * (1 - np.square(CAUTION / np.maximum(np.abs(z), CAUTION)))
    return out


def extreme_values(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """K and lambda by maximum likelihood from the greatest segments of texts of ``n`` tokens; a text without any has 0.

    The likelihood of x is K lambda n exp(-lambda x - K n exp(-lambda x)), and of none exp(-K n).
    """
    n = np.maximum(n, 1).astype(float)
    some = best > 0
    if not some.any():
        return 1.0 / max(n.sum(), 1.0), 1.0
    x, m, rest = best[some], n[some], n[~some].sum()

    def slope(rate: float) -> float:
        e = m * np.exp(-rate * x)
        return 1 / rate - x.mean() + (x * e).sum() / (e.sum() + rest)

    low, high = 1e-3, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return float(len(x) / ((m * np.exp(-low * x)).sum() + rest)), low


#: Counts of a token: of each part, among the others and among the toxic.
COUNTS = [f"{kind}{k}" for k in range(PARTS) for kind in ("other", "toxic")]


def _count(batches):
    """Documents with each token, by class and part, in a task."""
    import pyarrow as pa

    keys, sums = np.empty(0, U64), np.empty((0, 2 * PARTS))
    for texts, rest in grouped(batches, BUDGET, ["y", "part"]):
        words = Words(texts, lower=True, apart=IS_MARK)
        column = np.repeat(2 * np.array(rest["part"]) + np.array(rest["y"]), np.diff(words.first))
        h, owner = words.hashes(), np.repeat(np.arange(len(texts)), np.diff(words.first))
        order = np.lexsort((owner, h))
        once = order[np.concatenate(([True], (np.diff(h[order]) != 0) | (np.diff(owner[order]) != 0)))[: len(order)]]
        both, back = np.unique(np.concatenate((keys, h[once])), return_inverse=True)
        new = np.zeros((len(both), 2 * PARTS))
        new[back[: len(keys)]] += sums
        np.add.at(new, (back[len(keys) :], column[once]), 1)
        keys, sums = both, new
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(c.astype(np.int32)) for c in sums.T]], ["token", *COUNTS])


class Model:
    """Scores of tokens (by sorted hashes) and the calibration."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        self.hashes, self.weights = hashes, weights
        self.constant, self.rate, self.slope, self.bias = 1.0, 1.0, 1.0, -3.0

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """(number of tokens, maximal segments) of each text."""
        words = Words(texts, lower=True, apart=IS_MARK)
        n = np.diff(words.first).tolist()
        if not len(self.hashes):
            return [(k, []) for k in n]
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        scored = np.where(self.hashes[at] == h, self.weights[at], DRIFT)
        # runs of tokens at the drift are passed over at once
        hit = np.flatnonzero(scored != DRIFT)
        weight, bounds = scored[hit], np.searchsorted(hit, words.first)
        spans = zip(bounds.tolist(), bounds[1:].tolist(), words.first.tolist(), n, strict=False)
        return [(k, segments((hit[a:b] - first).tolist(), weight[a:b].tolist(), DRIFT)) for a, b, first, k in spans]

    def passages(self, texts: list[bytes]) -> list[tuple[float, list]]:
        """(evidence, significant passages) of each text."""
        out: list[tuple[float, list]] = []
        for n, found in self.scan(texts):
            each = [(-np.log(self.constant * n) + self.rate * s, a, b, s) for a, b, s in found]
            out.append((sum(e for e, *_ in each if e > 0), [{"start": a, "stop": b, "score": s} for e, a, b, s in each if e > 0]))
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.bias, -30, 30)))

    def calibrate(self, evidence: np.ndarray, y: np.ndarray, toxic_share: float) -> None:
        """Weighted logistic regression of the label on log(1 + evidence), lightly held to zero."""
        x = np.stack((np.log1p(evidence), np.ones(len(y))), 1)
        weight = np.where(y == 1, toxic_share / max((y == 1).mean(), 1e-9), (1 - toxic_share) / max((y == 0).mean(), 1e-9))
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.05
            step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.05 * beta)
            beta += np.clip(step, -4, 4)
        self.slope, self.bias = max(beta[0], 0.0), beta[1]


def _crosswise(models):
    """Scores of all segments of sample texts by the model that hasn't seen their part."""

    def run(batches):
        import pyarrow as pa

        scorers = shared(models)
        for texts, rest in grouped(batches, BUDGET, ["y", "part"]):
            found = [scorers[k].scan([t])[0] for t, k in zip(texts, rest["part"], strict=True)]
            lists = [[s for *_, s in segs] for _, segs in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(lists, pa.list_(pa.float64())), pa.array(rest["y"], pa.int32())], ["n", "scores", "y"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fold, per_class: int = PER_CLASS) -> Model:
    """The model of the labelled documents outside ``fold``; without labels, every score is low."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~fold)
    toxic_share = known.agg(F.avg("toxic").alias("s")).first()["s"] or 0.05
    rows = training_rows(docs, sample(labels, "toxic", fold, per_class)).withColumn("part", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(PARTS)).cast("int"))
    rows = materialise(rows, "toxic-sample")
    counts = rows.mapInArrow(_count, ", ".join(["token long", *[f"{c} int" for c in COUNTS]])).groupBy("token").agg(*[F.sum(c).cast("int").alias(c) for c in COUNTS])
    counts = counts.toArrow()  # of at most 2 * per_class documents
    hashes = counts.column("token").to_numpy().view(U64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    parts = np.stack([counts.column(c).to_numpy()[order] for c in COUNTS], 1).reshape(-1, PARTS, 2)
    del counts, order
    whole = parts.sum(1)

    def fitted(of: np.ndarray) -> Model:
        return Model(hashes, weights(of[:, 1].astype(float), of[:, 0].astype(float)))

    model, cross = fitted(whole), [fitted(whole - parts[:, k]) for k in range(PARTS)]
    del parts, whole
    seen = rows.mapInArrow(_crosswise(share(spark, cross)), "n long, scores array<double>, y int").collect()
    discard(rows)
    if seen:
        n, y = np.array([r["n"] for r in seen]), np.array([r["y"] for r in seen])
        best = np.array([max(r["scores"], default=0.0) for r in seen])
        if (y == 0).any():
            model.constant, model.rate = extreme_values(best[y == 0], n[y == 0])
        each = [[e for e in (-np.log(model.constant * max(r["n"], 1)) + model.rate * s for s in r["scores"]) if e > 0] for r in seen]
        model.calibrate(np.array([sum(e) for e in each]), y, float(np.clip(toxic_share, 0.01, 0.99)))
    return model


def _score(model):
    def run(batches):
        import pyarrow as pa

        scorer = shared(model)
        schema = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for texts, rest in grouped(batches, BUDGET, ["doc_id"]):
            found = scorer.passages(texts)
            score = scorer.probability(np.array([f[0] for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"], pa.int64()), pa.array(score), pa.array([f[1] for f in found], schema)], ["doc_id", "score", "passages"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, passages: one row per row of ``docs``.

    ``passages`` are the significant toxic segments, in words cut at white space
    and ASCII punctuation. Labels are learnt from rows whose crc32 modulo ``folds``
    isn't ``held``. Null and empty texts have no passage and the least score; a
    null doc_id is not held out. Repeated rows each give a row.
    """
    docs = pick(docs, "doc_id", "text")
    model = fit(docs, pick(labels, "doc_id", "toxic"), remainder(F.col("doc_id"), folds) == held)
    out = docs.mapInArrow(_score(share(docs.sparkSession, model)), SCHEMA)
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
