"""Queries of structural audits over the given tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import structure as R
from ..operators.within import Within
from ..storage import settled
from . import tables as T
from .graph_queries import DEGREES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: A threshold that leaves nodes alone and makes leaves.
TAU = 7.4
TAUS = T.PAIRS + f", tau AS (SELECT i AS source, j AS target, d AS weight FROM pairs WHERE d <= {TAU})"


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = T.vectors(spark, sf_dir)
    return nodes.select(F.col("id").alias("node")), settled(G.tau_graph(nodes, TAU), "tau")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders are the records of the vector that has their part's number."""
    lines = T.table(spark, sf_dir, "lineitem")
    record = (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("record")
    return lines.select(F.col("l_partkey").cast("long").alias("node"), record, F.col("l_returnflag").alias("lineage"), F.to_date("l_shipdate").alias("day"))


#: What rounds begin with: lists of nodes, in SQL's own iteration.
BATCHES = f"""WITH RECURSIVE {TAUS}{DEGREES}, links AS (SELECT source AS a, target AS b FROM tau UNION ALL SELECT target, source FROM tau),
    p AS (SELECT CAST(0 AS BIGINT) AS round, list(DISTINCT a) AS kept FROM links UNION ALL
        SELECT round + 1, list(node) FROM (SELECT round, node, d, count(*) OVER () AS n, sum(d) OVER () AS d2 FROM (SELECT round, a AS node, count(*) AS d FROM p JOIN links ON list_contains(kept, a) AND list_contains(kept, b) GROUP BY round, a)) WHERE d * 100 * n > 110 * d2 GROUP BY round),
    x AS (SELECT round, a, count(*) AS d FROM p JOIN links ON list_contains(kept, a) AND list_contains(kept, b) GROUP BY round, a), trace AS (SELECT round, count(*) AS n_nodes, CAST(sum(d) // 2 AS BIGINT) AS n_edges FROM x GROUP BY round)"""


@query(BATCHES + " SELECT round, n_nodes, n_edges, round(n_edges / n_nodes, 8) AS edges_per_node FROM trace")
def batch_peeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each round of peeling by batches begins with."""
    _, edges = _graph(spark, sf_dir)
    return R.densest_by_batches(edges).trace.withColumn("edges_per_node", F.round("edges_per_node", 8))


#: The 2-core is what is left by keyed iteration over nodes that go.
CORE = """, gone(node) USING KEY (node) AS (SELECT node FROM deg WHERE degree < 2 UNION
    (SELECT a FROM links LEFT JOIN recurring.gone x ON x.node = b WHERE a NOT IN (SELECT node FROM recurring.gone) AND (SELECT count(*) FROM gone) > 0 GROUP BY a HAVING count(*) - count(x.node) < 2)), core AS (SELECT id AS node FROM nodes WHERE id NOT IN (SELECT node FROM gone))"""


@query(BATCHES + CORE + """, s AS (SELECT 'original_graph' AS stage, id AS node FROM nodes UNION ALL SELECT 'one_round_degree_1_removed', node FROM deg WHERE degree <> 1 UNION ALL SELECT 'recursive_2_core', node FROM core UNION ALL
    SELECT 'densest_by_batches', a FROM x WHERE round = (SELECT round FROM trace ORDER BY n_edges / n_nodes DESC, round LIMIT 1)),
    h AS (SELECT s.stage, s.node, count(t.node) AS d FROM s LEFT JOIN links ON a = s.node LEFT JOIN s t ON t.stage = s.stage AND t.node = b GROUP BY ALL)
    SELECT stage, count(*) AS n, CAST(sum(d) // 2 AS BIGINT) AS m, round(sum(d) / 2 / count(*), 8) AS edges_per_node, round(sum(d) / count(*), 8) AS mean_degree, CAST(quantile_cont(d, 0.5) AS DOUBLE) AS median_degree, min(d) AS min_degree, max(d) AS max_degree, round(sum(d) / (count(*) * (count(*) - 1)), 8) AS density FROM h GROUP BY stage""")
def structure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold graph, without its leaves, its 2-core and its dense part, side by side."""
    found = R.stages_within(Within(T.vectors(spark, sf_dir), TAU))
    return found.withColumns({c: F.round(c, 8) for c in ("edges_per_node", "mean_degree", "density")})


@query(f"""WITH {TAUS}{DEGREES}, t AS (SELECT node, degree, count(e.l_orderkey) AS times FROM deg LEFT JOIN lineitem e ON e.l_partkey = node GROUP BY node, degree),
    g AS (SELECT unnest(list_filter(['all_nodes', '=' || degree, CASE WHEN degree = 1 THEN 'degree_1' END, CASE WHEN degree = 2 THEN 'degree_2' END, CASE WHEN degree >= 2 THEN 'degree_ge_2' END], lambda x: x IS NOT NULL)) AS node_group, times FROM t)
    SELECT node_group, count(*) AS n_nodes, CAST(sum(times) AS BIGINT) AS n_records, round(avg(times), 8) AS mean, CAST(quantile_cont(times, 0.5) AS DOUBLE) AS median, CAST(count_if(times > 1) AS BIGINT) AS n_repeated, round(count_if(times > 1) / count(*), 8) AS share_repeated, max(times) AS most FROM g GROUP BY node_group""")
def multiplicity_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records stand behind nodes of each degree and of groups of degrees."""
    found = R.multiplicity_by_degree(Within(T.vectors(spark, sf_dir), TAU).degrees(), _records(spark, sf_dir))
    return found.withColumns({c: F.round(c, 8) for c in ("mean", "share_repeated")})


@query(f"""WITH RECURSIVE {TAUS}{DEGREES}, links AS (SELECT source AS a, target AS b FROM tau UNION ALL SELECT target, source FROM tau){CORE}, r AS (SELECT * FROM deg ORDER BY degree DESC, node LIMIT 4),
    l AS (SELECT a AS node, count_if(degree = 1) AS leaves, count_if(degree <> 1) AS others, count_if(b IN (SELECT node FROM core)) AS kept FROM links JOIN deg ON deg.node = b GROUP BY a),
    e AS (SELECT l_partkey AS node, count(*) AS n, min(CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) AS first, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS lineages, min(CAST(l_shipdate AS DATE)) AS earliest, max(CAST(l_shipdate AS DATE)) AS latest FROM lineitem GROUP BY l_partkey)
    SELECT node, degree, coalesce(n, 0) AS n_records, CAST(coalesce(leaves, 0) AS BIGINT) AS leaf_neighbours, CAST(coalesce(others, 0) AS BIGINT) AS degree_without_leaves, node IN (SELECT node FROM core) AS in_core, CAST(CASE WHEN node IN (SELECT node FROM core) THEN kept ELSE 0 END AS BIGINT) AS degree_in_core, first AS representative, coalesce(lineages, '') AS lineages, earliest, latest FROM r LEFT JOIN l USING (node) LEFT JOIN e USING (node)""")
def hub_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nodes of most neighbours and the records behind them (a top-k report)."""
    graph = Within(T.vectors(spark, sf_dir), TAU)
    return R.hub_records(graph.names, graph, _records(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS year FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9000), g AS (SELECT * FROM (SELECT DISTINCT o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'P') CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS year FROM orders)),
    n AS (SELECT priority, year, count(*) AS n_runs FROM r GROUP BY ALL) SELECT priority, year, coalesce(n_runs, 0) AS n_runs, CASE WHEN g.priority IS NULL THEN 'unexpected' WHEN n_runs IS NULL THEN 'missing' WHEN n_runs = 1 THEN 'once' ELSE 'repeated' END AS state FROM g FULL JOIN n USING (priority, year)""")
def completeness_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of rich customers as runs over a grid of priorities and years: which cells are missing or repeated?"""
    orders = T.table(spark, sf_dir, "orders")
    rich = T.table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    cell = [F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("long").alias("year")]
    axes = {"priority": orders.where("o_orderstatus = 'P'").select(cell[0]), "year": orders.select(cell[1])}
    return R.grid_check(orders.join(rich, "o_custkey", "left_semi").select(*cell), axes)
