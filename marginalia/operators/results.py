"""Ordering, filtering and counting of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.schema import SEVERITIES
from marginalia.storage import kept


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for at, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, at).otherwise(rank)
    return rank


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first; among equals in order of emission."""
    return findings.orderBy(severity_rank(F.col("severity")), "emit_order", "doc_id", "seq")


def positions(findings: DataFrame) -> DataFrame:
    """Findings with ``pos``: their places, from 1, in the order in which they are shown; finding_id tells equals apart.

    Rows are dealt by ranges of that order and numbered within their ranges; what lies in
    the ranges before is one number for each of them. No task holds more than a range.
    """
    order = [severity_rank(F.col("severity")), F.col("emit_order"), F.col("doc_id"), F.col("seq"), F.col("finding_id")]
    ranged = findings.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = kept(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranges")
    sizes = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    everything = F.array_sort(F.collect_list(F.struct("_range", "n")))
    of_ranges = sizes.agg(everything.alias("all")).select(F.explode("all").alias("r"), "all")  # as many rows as there are ranges
    before = of_ranges.select(F.col("r._range").alias("_range"), F.aggregate(F.filter("all", lambda x: x["_range"] < F.col("r._range")), F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("_before"))
    return numbered.join(F.broadcast(before), "_range").withColumn("pos", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def shown(findings: DataFrame, category: str | None = None, important_only: bool = False) -> DataFrame:
    if category is not None:
        findings = findings.where(F.col("category") == category)
    return findings.where(F.col("severity") == "important") if important_only else findings


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by category and severity, by category, and of all; null stands for any."""
    return findings.rollup("category", "severity").agg(F.count(F.lit(1)).alias("n"))


def top_categories(findings: DataFrame, n: int = 3) -> DataFrame:
    """The n categories with the most important findings, then the most of those that aren't info."""
    counts = findings.where("severity <> 'info'").groupBy("category").agg(F.count_if(F.col("severity") == "important").alias("n_important"), F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n_important"), F.desc("n"), "category").limit(n)
