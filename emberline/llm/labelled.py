"""Bounded samples of labelled documents for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample(labels: DataFrame, label: str, fold: Column, per_class: int) -> DataFrame:
    """doc_id, y: at most ``per_class`` documents of either class outside ``fold``.

    They are the first by a hash of the id, so the choice doesn't depend on the
    order of rows. Null ids and labels are left out; a document with several
    labels has the largest. At most 2 * per_class rows.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~fold)
    one = one.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    halves = [one.filter(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return halves[0].union(halves[1])


def training_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """text, y of the chosen documents, one row each; ``chosen`` is bounded, so it is broadcast.

    Of rows that repeat a chosen doc_id, the one with the least text is taken.
    """
    ids = chosen.withColumnRenamed("doc_id", "chosen_id")
    rows = docs.join(F.broadcast(ids), docs["doc_id"] == ids["chosen_id"])
    return rows.groupBy("chosen_id").agg(F.min("text").alias("text"), F.any_value("y").alias("y")).select("text", "y")
