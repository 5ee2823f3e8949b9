"""Mixing sources to target weights by capped water-filling.

Targets: every source gets a share of the mix by its weight; a source whose share
is above ``epochs`` times its size stops there, and the excess goes to the others
by weight until none is above. That level has a closed form: in ascending order
of (largest target / weight), sources are clamped up to the first one that fits.

Samples: of a source with target t and size s, every document is taken whole
floor(t / s) times. The rest is one more repetition of the documents that come
first by a seeded hash, and a part of the one at the border, so that the words
taken meet the target to the word. Hash ranges are summed before documents are
ranked, and only a source's one range at the border is ranked, so no source is
gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import materialise, pick, salted_join

#: Fixed values of the task: weights in the sources' order, share of all sizes, epochs.
WEIGHTS, SHARE, EPOCHS = (5.0, 2.0, 1.0), 1.5, 2
SEED = "mix-1"
#: Hex digits of the hash that name a range.
RANGE_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words (runs outside 0x20, 0x09-0x0D); null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, target.

    One row per source, a null source last in the order of weights. The window
    without partitions ranks sources, of which there are few, not documents.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    at = sizes.withColumn("weight", weight).withColumn("most", (F.col("source_size") * epochs).cast("double"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    at = at.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("clamped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
        (F.sum("source_size").over(whole) * F.lit(share)).alias("total"),
    )
    # the level if the sources before this one are clamped; the true level is the first that fits
    room = F.col("total") - F.col("clamped")
    fits = F.col("weight") * room / F.col("left_weight") <= F.col("most")
    at = at.withColumn("room", F.first(F.when(fits, room), True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    at = at.withColumn("rest", F.first(F.when(fits, F.col("left_weight")), True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    level = F.col("weight") * F.col("room") / F.col("rest")
    return at.select("source", "source_size", F.coalesce(F.least("most", level), F.col("most")).alias("target"))


def _rank(name: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(name, F.lit("null"))).cast("binary"))


def _plan(sized: DataFrame, weights, share: float, epochs: int) -> DataFrame:
    """What every range of a source takes, written: a row for each source and range, at most 4096 a source.

    ``sized`` has source, rank and size. ``part`` words of a source come from one more
    repetition; ``before`` of them lie in earlier ranges.
    """
    ranges = sized.groupBy("source", F.substring("rank", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("range_size"))
    ranges = materialise(ranges, "ranges")
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    goal = targets(sizes, weights, share, epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    r = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(r), F.lit(0)))
    goal = goal.withColumnRenamed("source", "s2")
    plan = ranges.join(goal, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    return materialise(plan, "mix-plan")


def _taken(rows: DataFrame, plan: DataFrame, size: Column, order: list) -> DataFrame:
    """``rows`` (with source and rank) with size, source_size, target and the words taken of each.

    Rows stay where they are but those of a source's one range at the border of its
    part, which are ranked by ``order``.
    """
    own = rows.columns
    rows = salted_join(rows.withColumn("range", F.substring("rank", 1, RANGE_DIGITS)), plan, ["source", "range"], "inner")
    border = (F.col("before") < F.col("part")) & (F.col("before") + F.col("range_size") > F.col("part"))
    inner = rows.filter(~border).withColumn("size", size)
    inner = inner.withColumn("extra", F.when(F.col("before") < F.col("part"), F.col("size")).otherwise(F.lit(0)))
    d = W.partitionBy("source").orderBy("rank", *order).rowsBetween(W.unboundedPreceding, -1)
    edge = rows.filter(border).withColumn("size", size).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(d), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("start")))
    out = inner.unionByName(edge.withColumn("extra", extra).drop("start"))
    taken = (F.col("size") * F.col("whole") + F.col("extra")).cast("long")
    return out.select(*[c for c in own if c not in ("size", "rank")], "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of ``docs``.

    ``taken`` counts words with repetitions: at most ``epochs`` times the size. A
    null or empty text has size 0 and takes 0. A null source is a source like any
    other. Rows that repeat a doc_id are ranked by their size; of rows alike in
    both, any may take the part at the border. Null ids share one place in the order, so
    one task ranks them if the border falls on it. No rows in, no rows out. Extra
    columns are ignored.
    """
    docs = pick(docs, "doc_id", "text", "source")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _rank(F.col("doc_id").cast("string"), seed).alias("rank"))
    sized = materialise(sized, "sizes")
    return _taken(sized, _plan(sized, weights, share, epochs), F.col("size"), ["size"]).select("doc_id", "source", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs`` as often as a mix of them takes them, with all columns.

    Every whole repetition is a row, and a part is a row with the first words of
    the text, up to the last word taken. A text without words takes no row. Rows are
    ranked by a hash of (doc_id, hash of the text), and rows alike in these by a hash
    of all columns, so reruns agree. Texts aren't shuffled but those of border ranges.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    name = F.to_json(F.struct(docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("key")))
    rows = docs.select(whole.alias("row"), docs["source"].alias("source"), _rank(name, seed).alias("rank"))
    plan = _plan(rows.select("source", "rank", n_words(F.col("row.text")).alias("size")), weights, share, epochs)
    some = _taken(rows, plan, n_words(F.col("row.text")), [F.xxhash64(F.to_json("row"))]).filter("taken > 0")
    some = some.withColumn("times", F.expr("taken div size").cast("int")).withColumn("part", F.expr("taken % size").cast("int"))
    # repetition 0 is the part
    some = some.select("row", "part", F.explode(F.sequence(F.when(F.col("part") > 0, 0).otherwise(1), F.col("times"))).alias("k"))
    words = F.regexp_extract_all("row.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    text = F.when(F.col("k") == 0, F.array_join(F.slice(words, 1, F.col("part")), "")).otherwise(F.col("row.text"))
    return some.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: The same rows in DuckDB, with the fixed values written out.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS rank
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CAST(source_size * 2 AS DOUBLE) AS most FROM s),
c AS (SELECT *, coalesce(sum(most) OVER o, 0) AS clamped,
             sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight, sum(source_size) OVER () * 1.5::DOUBLE AS total
      FROM w WINDOW o AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT * FROM c WHERE weight * (total - clamped) / left_weight <= most ORDER BY most / weight, source IS NULL, source LIMIT 1),
t AS (SELECT c.source, c.source_size,
             coalesce(least(c.most, c.weight * (SELECT total - clamped FROM f) / (SELECT left_weight FROM f)), c.most) AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS part FROM p),
d AS (SELECT sized.doc_id, size, source_size, target, whole, part,
             coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY rank, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM sized JOIN q ON sized.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(size * whole + greatest(0, least(size, part - start)) AS BIGINT) AS taken FROM d
"""
