"""Quality rules: base counts, and robust multivariate outliers by group.

Every text gets a vector of transformed statistics. For each (lang, source) group
the minimum-covariance-determinant estimate of centre and scatter is sought: the
``SHARE`` of its documents whose covariance has the least determinant. Three starts
(documents nearest to the medians by the sum and by the greatest of their squared
deviations, and a share of them at random) each take concentration steps: keep the
share of documents nearest by Mahalanobis distance, take their mean and covariance,
which never raises the determinant. The start with the least determinant goes on until the
determinants settle, and its estimate is reweighted over all documents within the
97.5 % chi-square bound. A document is rejected if its distance from its group's
estimate is above a chi-square cut-off. The order statistic of a step comes from a
histogram of distances, so a step is two grouped sums over one small row per document
and start, and no group is gathered or sorted. What a step finds, one row per group, is
written and broadcast if its files are small, so the documents' rows stay where they are.

Only DataFrame functions are used. A group with fewer than ``least`` documents
joins the other small groups of its language, and those the small languages; if
even these are fewer than ``fewest`` in all, nothing is rejected there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import materialise, pick, small_side

#: Fixed values of the task.
SYMBOLS, WINDOW, LEAST_WORDS, REPEAT_PERCENT = "[#*$%&|<>]", 8, 20, 30
WORD = r"[^\x20\x09-\x0D]"
#: Share of a group that a concentration step keeps; steps of every start, and most steps of the best.
SHARE, STEPS, MOST_STEPS = 0.75, 2, 10
#: Fall of a log determinant that counts as settled; bound of the reweighting.
SETTLED, WITHIN = 0.01, 0.975
#: Smallest groups with an estimate of their own, and with any estimate.
LEAST, FEWEST = 100, 20
#: Chance that the cut-off leaves to a document of a normal group.
CHANCE = 1e-9
#: Statistics, and the least scale that each is measured in: differences below it are no evidence.
SCALES = {"word_length": 0.35, "symbol_rate": 0.05, "dup_line_rate": 0.06, "repeat_rate": 0.06, "upper_rate": 0.04, "echo_rate": 0.04}


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma."""
    a, h = k / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts of its column ``text``, each a long."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select("*", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    docs = docs.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_h"),
    ).drop("_words", "_lines")
    again = F.zip_with("_h", F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    docs = docs.withColumn("n_echoes", F.size(F.filter(again, lambda x: x)).cast("long"))
    width = 1
    while width < WINDOW:  # hashes of 1, 2, 4, 8 words
        rest = F.slice("_h", width + 1, F.greatest(F.size("_h"), F.lit(1)))
        joined = F.zip_with("_h", rest, lambda a, b: F.xxhash64(a, b))
        docs = docs.withColumn("_h", F.slice(joined, 1, F.greatest(F.size("_h") - width, F.lit(0))))
        width *= 2
    # only a text with a repeated window sorts its windows, as hash << bits | place
    docs = docs.withColumn("_some", F.size(F.array_distinct("_h")) < F.size("_h"))
    docs = docs.withColumn("_h", F.expr("IF(_some, _h, NULL)"))
    docs = docs.withColumn("_b", F.length(F.bin(F.size("_h").cast("long"))))
    docs = docs.withColumn("_s", F.expr("sort_array(transform(_h, (x, i) -> shiftleft(x, _b) | i))"))
    place = "CAST(x & (shiftleft(1L, _b) - 1) AS INT)"
    docs = docs.withColumn("_p", F.expr(f"transform(_s, x -> {place})"))
    docs = docs.withColumn("_v", F.expr("transform(_p, i -> _h[i])")).drop("_h", "_s")
    docs = docs.withColumn("_p", F.expr("sort_array(filter(transform(_p, (p, i) -> IF(coalesce(get(_v, i + 1) = _v[i], false) OR coalesce(get(_v, i - 1) = _v[i], false), p, -1)), p -> p >= 0))"))
    gap = f"zip_with(_p, slice(_p, 2, greatest(size(_p), 1)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW})))"
    docs = docs.withColumn("n_repeat_words", F.expr(f"CAST(IF(_some, aggregate({gap}, 0L, (s, x) -> s + x), 0L) AS LONG)"))
    return docs.drop("_some", "_b", "_p", "_v")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, drawn to ordinary values while a text is short, in units of their least scales."""
    n = F.col("n_words").cast("double")
    values = {
        "word_length": (F.col("word_chars") + 250.0) / (n + 50.0),
        "symbol_rate": F.col("n_symbols") / (n + 20.0),
        "dup_line_rate": F.col("n_dup_lines") / (F.col("n_lines") + 10.0),
        "repeat_rate": F.col("n_repeat_words") / (n + 100.0),
        "upper_rate": F.col("n_upper") / (F.col("word_chars") + 100.0),
        "echo_rate": F.col("n_echoes") / (n + 20.0),
    }
    return [(values[k] / s).alias(f"x{i}") for i, (k, s) in enumerate(SCALES.items())]


def _groups(rows: DataFrame) -> DataFrame:
    """(lang, source) -> group, large enough for an estimate if any can be."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.col("n") >= LEAST
    rest = F.sum(F.when(own, 0).otherwise(F.col("n"))).over(W.partitionBy("lang"))
    name = F.when(own, F.to_json(F.struct("lang", "source"))).when(rest >= LEAST, F.to_json(F.struct("lang"))).otherwise(F.lit("rest"))
    return sizes.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), name.alias("g"))


def _moments(rows: DataFrame, d: int, share: float = SHARE) -> DataFrame:
    """Centre (m_i), Cholesky factor (l_i_j) and log determinant of the rows of each group, the nearest ``share``, with a floor of half a least scale."""
    xs = [F.col(f"x{i}") for i in range(d)]
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    sums += [F.avg(xs[i] * xs[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]
    out = rows.groupBy("g").agg(F.count("*").alias("n"), *sums)
    factor = share / chi2_cdf(chi2_quantile(share, d), d + 2)
    for i in range(d):
        for j in range(i + 1):
            c = (F.col(f"c{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (0.25 if i == j else 0.0)
            for k in range(j):
                c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            value = F.sqrt(F.greatest(c, F.lit(1e-6))) if i == j else c / F.col(f"l{j}_{j}")
            out = out.withColumn(f"l{i}_{j}", value)
    out = out.withColumn("logdet", sum((F.log(f"l{i}_{i}") * 2 for i in range(1, d)), F.log("l0_0") * 2))
    keep = ["g", "n", "logdet", *[f"m{i}" for i in range(d)], *[f"l{i}_{j}" for i in range(d) for j in range(i + 1)]]
    return out.select(*keep)


def _distance(rows: DataFrame, moments: DataFrame, d: int) -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance by its group's moments (null: no estimate)."""
    own = rows.columns
    out = rows.join(moments.withColumnRenamed("g", "mg"), F.col("g") == F.col("mg"), "left")
    for i in range(d):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}_{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}_{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, d)), F.col("z0") * F.col("z0"))
    return out.select(*own, total.alias("d2"))


def _nearest(rows: DataFrame) -> DataFrame:
    """The SHARE of each group's rows with the least d2, by bins of 1/64 of a unit of ln(1 + d2)."""
    rows = rows.withColumn("bin", F.floor(F.log1p("d2") * 64.0))
    bins = rows.groupBy("g", "bin").agg(F.count("*").alias("k"))
    run = F.sum("k").over(W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    whole = F.sum("k").over(W.partitionBy("g"))
    used = bins.withColumn("before", F.coalesce(run, F.lit(0))).withColumn("whole", whole)
    edge = used.filter(F.col("before") < SHARE * F.col("whole")).groupBy("g").agg(F.max("bin").alias("edge"))
    edge = small_side(materialise(edge, "edges"))
    return rows.join(edge.withColumnRenamed("g", "eg"), F.col("g") == F.col("eg")).filter("bin <= edge").drop("eg", "edge", "bin")


def _starts(rows: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` once for every start, its number after g; and the same with d2 by that start."""
    quartiles = rows.groupBy("g").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(d)])
    quartiles = small_side(materialise(quartiles, "quartiles"))
    joined = rows.join(quartiles.withColumnRenamed("g", "qg"), F.col("g") == F.col("qg"))
    spread = [(F.col(f"x{i}") - F.col(f"q{i}")[1]) / F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(0.5)) for i in range(d)]
    squares = [s * s for s in spread]
    chance = F.pmod(F.xxhash64(*[f"x{i}" for i in range(d)]), F.lit(1 << 20)) / float(1 << 20)
    by = F.array(sum(squares[1:], squares[0]), F.greatest(*squares), chance)
    name = F.concat("g", F.lit("#"), F.col("start").cast("string"))
    begun = joined.select("g", *[f"x{i}" for i in range(d)], F.posexplode(by).alias("start", "d2")).withColumn("g", name).drop("start")
    every = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("g", name).drop("start")
    return every, begun


def _estimates(rows: DataFrame, d: int) -> DataFrame:
    """MCD moments of each group with at least FEWEST rows."""
    every, begun = _starts(rows, d)
    near = _nearest(begun)
    for step in range(STEPS):
        moments = small_side(materialise(_moments(near, d), "moments"))
        if step < STEPS - 1:
            near = _nearest(_distance(every, moments, d))
    columns = [c for c in moments.columns if c not in ("g", "start")]
    best = moments.withColumn("start", F.regexp_extract("g", r"#(\d)$", 1)).withColumn("g", F.regexp_replace("g", r"#\d$", ""))
    best = best.groupBy("g").agg(F.min_by(F.struct(*columns), F.struct("logdet", "start")).alias("m")).select("g", "m.*")
    moments = small_side(materialise(best, "best-moments"))
    for _ in range(MOST_STEPS):
        following = small_side(materialise(_moments(_nearest(_distance(rows, moments, d)), d), "moments"))
        fall = following.select("g", F.col("logdet").alias("new")).join(moments.select("g", "logdet"), "g").filter(F.col("logdet") - F.col("new") > SETTLED)
        settled = fall.isEmpty()
        moments = following
        if settled:
            break
    within = _distance(rows, moments, d).filter(F.col("d2") <= chi2_quantile(WITHIN, d))
    moments = small_side(materialise(_moments(within, d, WITHIN), "reweighted"))
    return moments.filter(F.col("n") >= FEWEST * SHARE).drop("n", "logdet")


def quality(docs: DataFrame, text: bool = True) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with its counts, base_failed, distance and kept.

    Null text counts as empty; a text of under 20 words fails the base rules, so
    empty ones do. Null lang or source are values like any other. Repeated rows
    each get the same verdict. Extra columns live inside ``row`` and clash with
    nothing. ``text`` False drops the text from ``row`` early.
    """
    wanted = [c for c in docs.columns if text or c != "text"]
    whole = F.struct(*[docs[f"`{c}`"] for c in wanted])
    plain = docs.select(whole.alias("row"), docs["text"], docs["lang"], docs["source"])
    counted = counts(plain).drop("text").withColumn("base_failed", base_failed())
    d = len(SCALES)
    stats = materialise(counted.select("*", *vector()), "quality")
    good = stats.filter(~F.col("base_failed")).select("lang", "source", *[f"x{i}" for i in range(d)])
    groups = small_side(materialise(_groups(good), "groups"))

    def grouped(rows: DataFrame, how: str) -> DataFrame:
        same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
        return rows.join(groups, same, how).drop("g_lang", "g_source")

    moments = _estimates(grouped(good, "inner").drop("lang", "source"), d)
    out = _distance(grouped(stats, "left"), moments, d)
    limit = chi2_quantile(1 - CHANCE, d)
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)
    return out.withColumn("kept", kept).drop("lang", "source", "g", *[f"x{i}" for i in range(d)]).withColumnRenamed("d2", "distance2")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept of every row."""
    out = quality(pick(docs, "doc_id", "text", "lang", "source"), text=False)
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return quality(docs).filter("kept").select("row.*")
