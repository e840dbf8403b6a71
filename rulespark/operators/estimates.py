"""Sizes of path bodies estimated from statistics of relations alone, for all paths of a length at once.

A label is a relation seen from its subject (``+``) or object (``-``); an entity is a start of a label if it has a fact that way. The expected number of head pairs that
a path l1, ..., lk reaches is a product along the path: the starts of l1 that are in the head's place, over the functionality of l1; then for each step the share of the
ends of l(i-1) that are starts of l(i), times the inverse functionality of l(i) over its functionality. So all paths of one length come from those one shorter by a join
with the table of overlaps of labels. Support over that product estimates the PCA confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulespark.operators.stats import label_sets
from rulespark.operators.storage import stored


def _back(l: str) -> F.Column:  # noqa: E741
    return F.concat(F.expr(f"left({l}, length({l}) - 1)"), F.when(F.col(l).endswith("+"), "-").otherwise("+"))


def label_statistics(sets: DataFrame) -> DataFrame:
    """``l``, ``starts``, ``ends``, ``fun`` (starts a fact), ``ifun`` (ends a fact), from :func:`~rulespark.operators.stats.label_sets`."""
    one = sets.groupBy("l").agg(F.sum("facts").alias("n"), F.coalesce(F.sum(F.when(F.col("known"), F.col("entities"))), F.lit(0)).alias("starts"))
    both = one.join(one.select(_back("l").alias("l"), F.col("starts").alias("ends")), "l")
    return both.select("l", "starts", "ends", (F.col("starts").cast("double") / F.col("n")).alias("fun"), (F.col("ends").cast("double") / F.col("n")).alias("ifun"))


def label_overlaps(sets: DataFrame) -> DataFrame:
    """``l1``, ``l2``, ``common``: entities that start both."""
    return sets.filter("known").select(F.col("l").alias("l1"), F.explode("set").alias("l2"), "entities").groupBy("l1", "l2").agg(F.sum("entities").alias("common"))


def path_bodies(kb: DataFrame, length: int) -> DataFrame:
    """``h`` (relation), ``l1`` ... ``l<length>``, ``pairs``: the estimate for each head and path that can join a subject of the head to an object."""
    if length < 1:
        raise ValueError("a path has one atom at least")
    sets = label_sets(kb)
    stats, common = stored(label_statistics(sets).coalesce(1), "label-statistics"), stored(label_overlaps(sets).coalesce(1), "label-overlaps")
    heads = stats.filter(F.col("l").endswith("+")).select(F.expr("left(l, length(l) - 1)").alias("h"), F.col("l").alias("hs"), _back("l").alias("ho"))
    first = heads.join(common.select(F.col("l1").alias("hs"), F.col("l2").alias("l1"), "common"), "hs").join(stats.select(F.col("l").alias("l1"), "fun"), "l1")
    rows = first.select("h", "ho", "l1", (F.col("common") / F.col("fun")).alias("pairs"))
    ends = stats.select("l", "ends")
    for i in range(2, length + 1):
        # an entity that is an end of the last label starts its reverse
        step = common.select(_back("l1").alias(f"l{i - 1}"), F.col("l2").alias(f"l{i}"), "common")
        step = step.join(ends.select(F.col("l").alias(f"l{i - 1}"), "ends"), f"l{i - 1}").join(stats.select(F.col("l").alias(f"l{i}"), "fun", "ifun"), f"l{i}")
        rows = rows.join(step, f"l{i - 1}").select("h", "ho", *[f"l{k}" for k in range(1, i + 1)], (F.col("pairs") * ((F.col("common") * F.col("ifun")) / (F.col("ends") * F.col("fun")))).alias("pairs"))
    last = common.select(_back("l1").alias(f"l{length}"), F.col("l2").alias("ho"))
    return rows.join(last, [f"l{length}", "ho"], "left_semi").select("h", *[f"l{k}" for k in range(1, length + 1)], "pairs")
