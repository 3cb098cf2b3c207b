"""Graph bundles: edges, nodes and a row of statistics below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import graph_stats


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, name: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/{name}/nodes")
    edges.withColumn("status", F.lit("kept")).write.mode("overwrite").parquet(f"{path}/{name}/edges")
    graph_stats(nodes, edges).withColumn("graph", F.lit(name)).write.mode("overwrite").json(f"{path}/{name}/stats")


def read_edges(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Kept edges; a negative or missing weight is an error."""
    edges = spark.read.parquet(f"{path}/{name}/edges").where("status = 'kept'").drop("status")
    checked = F.when(F.col("weight") >= 0, F.col("weight")).otherwise(F.raise_error(F.lit("an edge has a negative or missing weight")).cast("double"))
    return edges.withColumn("weight", checked)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of all graphs below path."""
    return spark.read.json(f"{path}/*/stats")
