"""Filters, keys and checked joins of metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lineages that name none (fixed values).
NO_LINEAGE = ("None", "Unassigned", "unclassifiable")


def usable_records(metadata: DataFrame, accessions: DataFrame, place: str = "USA", first: str = "2019-01-01", last: str = "2024-12-31") -> DataFrame:
    """Records (accession, location, complete, high_coverage, day, lineage) to work on, one for each accession.

    They have a sequence, a place, are complete and of high coverage, have a whole date in the period and a lineage. Of
    several with one accession that of the least day, then lineage, stays.
    """
    lineage = F.col("lineage").isNotNull() & ~F.col("lineage").isin(*NO_LINEAGE)
    day = F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("day").between(first, last)
    fine = metadata.where(F.lower("location").contains(place.lower()) & F.col("complete") & F.col("high_coverage") & day & lineage)
    found = fine.join(accessions.select("accession").distinct(), "accession", "left_semi")
    one = F.row_number().over(Window.partitionBy("accession").orderBy("day", "lineage"))
    return found.withColumn("_n", one).where("_n = 1").drop("_n")


def labelled_or_included(rows: DataFrame, label: str, wanted: str, key: str, included: list[str]) -> DataFrame:
    """Rows with the label in whatever case, or with one of the keys."""
    return rows.where((F.lower(F.trim(label)) == wanted.lower()) | F.col(key).isin(*included))


def many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left with the columns of right: its keys must be unique and each row of left must have one, else an error."""
    n = right.groupBy(*on).agg(F.count("*").alias("_times")).where("_times > 1")
    if not n.isEmpty():
        raise ValueError(f"{on} repeat on the right")
    joined = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    there = F.coalesce(F.col("_there"), F.raise_error(F.lit("a row has no match")).cast("boolean"))
    return joined.where(there).drop("_there")


def in_order(first: DataFrame, *others: DataFrame) -> DataFrame:
    """(accession, position): accessions of the first list that all others have too, by their places in it."""
    kept = first
    for other in others:
        kept = kept.join(other.select("accession").distinct(), "accession", "left_semi")
    return kept.groupBy("accession").agg(F.min("position").alias("position"))


def represented(rows: DataFrame, key: str, content: str) -> DataFrame:
    """rows with `representative`, the least key that has the same content; a row without content stands for itself."""
    least = rows.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(key).alias("representative"))
    return rows.join(least, content, "left").withColumn("representative", F.coalesce("representative", key))


def label_codes(rows: DataFrame, label: str) -> DataFrame:
    """(label, code): labels in order, from 0; there are few."""
    names = rows.where(F.col(label).isNotNull()).select(label).distinct()
    return names.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("code"))


def grouped_spearman(rows: DataFrame, group: str, x: str, y: str, least: int = 8) -> DataFrame:
    """(group, n, rho) within groups; null with fewer than `least` pairs."""
    from .stats import average_rank, correlation

    fine = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, average_rank(x, group).alias("rx"), average_rank(y, group).alias("ry"))
    return fine.groupBy(group).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, correlation("rx", "ry")).alias("rho"))


def metric_summary(rows: DataFrame, group: str, *metrics: str) -> DataFrame:
    """(group, metric, n, mean, sd, least, q1, median, q3, most) of each metric, one pass for all."""
    long = rows.select(group, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("m")).select(group, "m.*").where("x IS NOT NULL AND NOT isnan(x)")
    q = lambda p: F.percentile("x", F.lit(p))
    return long.groupBy(group, "metric").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("x").alias("most"))


def duplicate_audit(rows: DataFrame, group: str, content: str) -> DataFrame:
    """(group, n, n_distinct, n_repeated, median_multiplicity, most): how often contents repeat in a group."""
    times = rows.groupBy(group, content).agg(F.count("*").alias("times"))
    return times.groupBy(group).agg(
        F.sum("times").alias("n"),
        F.count("*").alias("n_distinct"),
        F.sum(F.when(F.col("times") > 1, F.col("times")).otherwise(0)).alias("n_repeated"),
        F.percentile("times", F.lit(0.5)).alias("median_multiplicity"),
        F.max("times").alias("most"),
    )


def stable_seed(*parts: Column) -> Column:
    """An unsigned 32-bit seed of some values."""
    return F.crc32(F.concat_ws("|", *parts))
