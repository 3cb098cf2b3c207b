"""Moments of edge lags that grow with arriving edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def lag_moments(edges: DataFrame) -> DataFrame:
    """n, mean, sd, min, max of lag_days by graph; edges may be a stream, whose state is these few sums."""
    return edges.groupBy("graph").agg(F.count("lag_days").alias("n"), F.avg("lag_days").alias("mean"), F.stddev_samp("lag_days").alias("sd"), F.min("lag_days").alias("min"), F.max("lag_days").alias("max"))


def keep_moments(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the moments after each batch to a folder of its own, so that a batch done again leaves no doubles."""

    def write(found: DataFrame, batch: int) -> None:
        found.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return lag_moments(edges).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
