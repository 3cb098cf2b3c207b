"""The engine's inputs from the given tables, and the same as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distance


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.vectors(table(spark, sf_dir, "embeddings"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").cast("string").alias("label"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, day): the day of the event with a vector's id."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.to_date("ts").alias("day"))
    return events.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node")), "node", "left_semi")


#: CTEs for DuckDB, each with what it needs before it.
NODES = "nodes AS (SELECT vec_id AS id, embedding AS v, CAST(label AS VARCHAR) AS label FROM embeddings)"
PAIRS = NODES + """, pairs AS (SELECT a.id AS i, b.id AS j,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) AS FLOAT) AS d
    FROM nodes a JOIN nodes b ON a.id < b.id)"""
HALF = PAIRS + ", half AS (SELECT i, j, d FROM pairs UNION ALL SELECT j, i, d FROM pairs)"


def knn_sql(k: int) -> str:
    return HALF + f""", near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM half) WHERE rank <= {k}),
    knn AS (SELECT least(i, j) AS source, greatest(i, j) AS target, min(d) AS weight FROM near GROUP BY 1, 2)"""


RNG = HALF + """, rng AS (SELECT p.i AS source, p.j AS target, p.d AS weight FROM pairs p
    WHERE NOT EXISTS (SELECT 1 FROM half a JOIN half b ON a.j = b.j WHERE a.i = p.i AND b.i = p.j AND a.d < p.d AND b.d < p.d))"""


def undirected_sql(edges: str) -> str:
    """CTEs with the component of every node: SQL's own iteration over edges named so."""
    return f""", ends AS (SELECT source AS a, target AS b FROM {edges} UNION ALL SELECT target, source FROM {edges}),
    reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a),
    comps AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


def paths_sql(edges: str, step: str = "g.distance + h.w") -> str:
    """A CTE geo (root, node, distance) of every two nodes of edges named so: SQL's own keyed iteration over shorter paths.

    With greatest(g.distance, h.w) as the step, distance is the least largest weight on a path.
    """
    return f""", path_ends AS (SELECT source AS a, target AS b, CAST(weight AS DOUBLE) AS w FROM {edges} UNION ALL SELECT target, source, CAST(weight AS DOUBLE) FROM {edges}),
    geo(root, node, distance) USING KEY (root, node) AS (SELECT id, id, CAST(0 AS DOUBLE) FROM nodes UNION
    (SELECT g.root, h.b, min({step}) FROM geo g JOIN path_ends h ON g.node = h.a LEFT JOIN recurring.geo k ON k.root = g.root AND k.node = h.b WHERE k.distance IS NULL OR {step} < k.distance GROUP BY g.root, h.b))"""
