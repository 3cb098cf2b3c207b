"""Row numbers without a sort in one task, and what joins or cuts by them.

A table is split, by file blocks or by ranges of keys; a row's number within its split, plus how many rows the splits
before it hold, is its number. Only a row for each split meets in one place.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled


def file_rows(scan: DataFrame, *columns: Column) -> DataFrame:
    """(row, columns) of a scan of files: row numbers from 0 in the order of paths, and of records in each file.

    Blocks of one file are read by different tasks; Spark deals them in an order of its own, so they are put in order
    by where they begin.
    """
    at = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    kept = settled(scan.select(*columns, *at).withColumn("_at", F.monotonically_increasing_id()), "file-rows")
    spans = kept.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = spans.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    row = (F.col("_before") + F.col("_at") - F.col("_first")).alias("row")
    return kept.join(before, ["_file", "_block"]).select(row, *(c for c in kept.columns if not c.startswith("_")))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """df with each row's number from 0 within its group, by `order`; no group has to fit in a task.

    Rows that are alike in `by` and `order` are numbered in some order. Nulls of `by` are a group, the first.
    """
    keys = [F.col(c) for c in (*by, *order)]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    kept = settled(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    # null keys are no keys of a join: groups go by a struct of what they are
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    kept = kept.withColumn("_group", group)
    spans = kept.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return kept.join(before, ["_group", "_part"]).withColumn(name, place).drop("_group", "_part", "_at", "_first", "_before")


class Aligned(NamedTuple):
    rows: DataFrame
    #: Did both sides have as many rows? Otherwise nothing was filled.
    agrees: bool


def filled_by_position(ids: DataFrame, headers: DataFrame, known: DataFrame) -> Aligned:
    """ids (row, accession, ...) whose accession is not in known (accession) take that of the header (row, accession) in
    the same row, if that one is known; only where both files have as many rows."""
    if ids.count() != headers.count():
        return Aligned(ids, False)
    names = known.select("accession").where("accession IS NOT NULL").distinct()
    other = headers.select("row", F.col("accession").alias("_other")).join(names.withColumnRenamed("accession", "_other"), "_other", "left_semi")
    both = ids.join(names.withColumn("_known", F.lit(True)), "accession", "left").join(other, "row", "left")
    chosen = F.when(F.col("_known").isNull() & F.col("_other").isNotNull(), F.col("_other")).otherwise(F.col("accession"))
    return Aligned(both.withColumn("accession", chosen).select(*ids.columns), True)


class Run(NamedTuple):
    """Rows of one cost: `lead` of them end the batch `first`, then come batches of `each`."""

    cost: int
    first: int
    lead: int
    each: int


def batch_runs(sizes: list[tuple[int, int]], budget: int) -> list[Run]:
    """Where the rows of each cost go when (cost, rows), largest cost first, fill batches one after the other."""
    runs = []
    batch, used = 0, 0  # the batch that is open, and what it holds
    for cost, n in sizes:
        each = max(1, budget // cost) if cost > 0 else n
        lead = min(n, max(0, (budget - used) // cost) if cost > 0 else n) if used else min(n, each)
        runs.append(Run(cost, batch, lead, each))
        left = n - lead
        if left:
            batch += -(-left // each)
            used = (left - (-(-left // each) - 1) * each) * cost
        else:
            used += lead * cost
    return runs


def token_batches(rows: DataFrame, length: str, key: str, budget: int, extra: int = 2) -> DataFrame:
    """rows with batch, from 0: longest first (ties by key), a batch is closed when the next row, with `extra` tokens of
    its own, goes beyond the budget; a row beyond it stands alone. Rows without a length have no batch.

    Rows of one length follow one another, so a histogram of lengths, a row for each on the driver, says where each
    length begins in its batch; a row then needs its number within its length only.
    """
    cost = F.col(length).cast("bigint") + extra
    some = rows.where(F.col(length).isNotNull())
    sizes = sorted(((r["cost"], r["n"]) for r in some.groupBy(cost.alias("cost")).agg(F.count("*").alias("n")).collect()), reverse=True)
    schema = "_cost bigint, _first bigint, _lead bigint, _each bigint"
    runs = rows.sparkSession.createDataFrame(batch_runs(sizes, budget), schema)
    placed = numbered(some.withColumn("_cost", cost), ["_cost"], [key], "_place").join(runs, "_cost")
    late = F.col("_place") - F.col("_lead")
    batch = F.col("_first") + F.when(late < 0, 0).otherwise(1 + F.floor(late / F.col("_each")))
    return placed.withColumn("batch", batch.cast("bigint")).select(*rows.columns, "batch").unionAll(rows.where(F.col(length).isNull()).withColumn("batch", F.lit(None).cast("bigint")))
