"""Queries of removed edges and their controls over the given tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import controls as K
from ..operators import distance as D
from ..operators import graphs as G
from ..storage import settled
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges of the ten nearest, those that a third vector is nearer to both ends of (rejected), and of these the
    ones between different labels (removed)."""
    nodes, labels = T.vectors(spark, sf_dir), T.labels(spark, sf_dir)
    edges = settled(G.prune_nearest(D.nearest(nodes, 10), nodes), "edges-judged")
    rejected = edges.where("status = 'pruned'").select("source", "target")
    ends = [labels.select(F.col("node").alias(e), F.col("label").alias(c)) for e, c in (("source", "a"), ("target", "b"))]
    removed = settled(rejected.join(ends[0], "source").join(ends[1], "target").where("a <> b").select("source", "target"), "edges-removed")
    return edges.select("source", "target", "weight"), rejected, removed


#: A turn is a removed edge at one of its ends; its sorted candidates are gone through without those used before.
MATCHED = f"""WITH RECURSIVE {T.knn_sql(10)}, e AS (SELECT source, target, CAST(weight AS DOUBLE) AS weight, EXISTS (SELECT 1 FROM half a JOIN half b ON a.j = b.j WHERE a.i = knn.source AND b.i = knn.target AND a.d < knn.weight AND b.d < knn.weight) AS rejected FROM knn),
    r AS (SELECT source, target, weight, row_number() OVER (ORDER BY md5('0-' || source || '-' || target), source, target) - 1 AS place FROM e JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE rejected AND a.label <> b.label),
    t AS (SELECT 2 * place AS turn, 'source' AS role, source AS shared, r.* FROM r UNION ALL SELECT 2 * place + 1, 'target', target, r.* FROM r),
    k AS (SELECT source AS node, target AS partner, weight FROM e WHERE NOT rejected UNION ALL SELECT target, source, weight FROM e WHERE NOT rejected),
    o AS (SELECT turn, list(struct_pack(gap := abs(k.weight - t.weight), partner := partner, c_source := least(node, partner), c_target := greatest(node, partner)) ORDER BY abs(k.weight - t.weight), partner) AS found FROM t JOIN k ON k.node = t.shared GROUP BY turn),
    q AS (SELECT turn, row_number() OVER (ORDER BY turn) AS n, found FROM o),
    g AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS used, NULL::STRUCT(gap DOUBLE, partner BIGINT, c_source BIGINT, c_target BIGINT) AS won UNION ALL
        SELECT n, turn, CASE WHEN won IS NULL THEN used ELSE list_append(used, won.c_source || '-' || won.c_target) END, won
        FROM (SELECT q.n, q.turn, used, list_filter(found, lambda x: NOT list_contains(used, x.c_source || '-' || x.c_target))[1] AS won FROM g JOIN q ON q.n = g.n + 1)),
    m AS (SELECT t.source, t.target, t.turn, role, shared, won.partner AS partner, won.c_source AS c_source, won.c_target AS c_target, t.weight, c.weight AS c_weight, won.gap AS gap FROM g JOIN t USING (turn) JOIN e c ON c.source = won.c_source AND c.target = won.c_target WHERE won IS NOT NULL)"""


@query(MATCHED + """ SELECT source, target, turn, role, shared, partner, c_source, c_target, round(gap, 5) AS gap, CASE WHEN weight = 0 OR c_weight = 0 THEN weight = c_weight ELSE abs(c_weight - weight) <= 0.01 * weight END AS within FROM m""")
def control_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each removed edge, at both ends, the kept edge of the nearest weight that none before it took."""
    found = K.control_edges(*_graph(spark, sf_dir), caliper=0.01)
    return found.select("source", "target", "turn", "role", "shared", "partner", "c_source", "c_target", F.round("gap", 5).alias("gap"), "within")


#: What became of an edge, and what is compared.
TABLE = MATCHED + """, w AS (SELECT event_id AS node, CAST(ts AS DATE) AS day FROM events), h AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node),
    x AS (SELECT e.source, e.target, e.weight, CASE WHEN r.source IS NOT NULL THEN 'removed' WHEN e.rejected THEN 'kept_for_connection' ELSE 'retained' END AS status,
        CASE WHEN (e.source, e.target) IN (SELECT (source, target) FROM m) THEN 'removed' WHEN (e.source, e.target) IN (SELECT (c_source, c_target) FROM m) THEN 'control' ELSE 'none' END AS role,
        CAST(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))) AS FLOAT) AS other, abs(date_diff('day', da.day, db.day)) AS day_gap, a.label = b.label AS same_label, least(ha.degree, hb.degree) AS low_degree, greatest(ha.degree, hb.degree) AS high_degree
        FROM e LEFT JOIN r ON r.source = e.source AND r.target = e.target JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target LEFT JOIN w da ON da.node = e.source LEFT JOIN w db ON db.node = e.target JOIN h ha ON ha.node = e.source JOIN h hb ON hb.node = e.target)"""


def _edge_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, rejected, removed = _graph(spark, sf_dir)
    controls = settled(K.control_edges(edges, rejected, removed, caliper=0.01), "controls")
    nodes = T.vectors(spark, sf_dir)
    a, b = (nodes.select(F.col("id").alias(i), F.col("v").alias(v)) for i, v in (("source", "v"), ("target", "w")))
    apart = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)).cast("float")
    other = edges.join(a, "source").join(b, "target").select(F.col("source").alias("i"), F.col("target").alias("j"), apart.alias("d"))
    return K.edge_table(edges, rejected, removed, controls, T.labels(spark, sf_dir), T.dates(spark, sf_dir), other), controls


@query(TABLE + " SELECT source, target, round(weight, 3) AS weight, status, role, round(CAST(other AS DOUBLE), 3) AS other, day_gap, same_label, low_degree, high_degree FROM x")
def edge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges with their status, part in the design, a second distance, days, labels and degrees."""
    table, _ = _edge_table(spark, sf_dir)
    return table.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in ("weight", "other")}).withColumn("day_gap", F.col("day_gap").cast("long"))


@query(TABLE + """, l AS (SELECT source, target, metric, value FROM (SELECT source, target, CAST(day_gap AS DOUBLE) AS day_gap, CAST(low_degree AS DOUBLE) AS low_degree, CAST(high_degree AS DOUBLE) AS high_degree FROM x) UNPIVOT (value FOR metric IN (day_gap, low_degree, high_degree))),
    p AS (SELECT m.source, m.target, l.metric, avg(value) AS control FROM m JOIN l ON l.source = m.c_source AND l.target = m.c_target GROUP BY ALL)
    SELECT metric, count(*) AS n_groups, round(avg(value), 6) AS mean_removed, round(avg(control), 6) AS mean_controls, round(avg(value - control), 6) AS mean_delta, CAST(count_if(value > control) AS BIGINT) AS n_higher, CAST(count_if(value < control) AS BIGINT) AS n_lower, CAST(count_if(value = control) AS BIGINT) AS n_equal FROM p JOIN l USING (source, target, metric) GROUP BY metric""")
def matched_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed edges beside the mean of their controls."""
    table, controls = _edge_table(spark, sf_dir)
    found = K.matched_contrasts(settled(table, "edge-table"), controls, ["day_gap", "low_degree", "high_degree"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean_removed", "mean_controls", "mean_delta")})
