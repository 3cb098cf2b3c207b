"""Queries of drawn quartets, centres, top-ups, panels and calibrations over the given tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison as C
from ..operators import sampling as P
from ..operators import stats as S
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


def _rest(j: int) -> str:
    return f"CAST('0x' || substr(md5('0-' || id || '-{j}'), 1, 15) AS BIGINT) % (n - {j})"


def _step(x: str, gone: str) -> str:
    return f"list_reduce(list_prepend({x}, list_sort({gone})), lambda x, g: x + CASE WHEN x >= g THEN 1 ELSE 0 END)"


#: Places of four different vectors for each vector, as distinct_draws gives them.
DRAWS = f"""n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM nodes), d1 AS (SELECT id, n, {_rest(0)} AS a FROM n), d2 AS (SELECT *, {_step(_rest(1), "[a]")} AS b FROM d1),
    d3 AS (SELECT *, {_step(_rest(2), "[a, b]")} AS c FROM d2), d4 AS (SELECT *, {_step(_rest(3), "[a, b, c]")} AS d FROM d3),
    t AS (SELECT d4.id AS qid, na.id AS a, nb.id AS b, nc.id AS c, nd.id AS d FROM d4 JOIN n na ON na.place = d4.a JOIN n nb ON nb.place = d4.b JOIN n nc ON nc.place = d4.c JOIN n nd ON nd.place = d4.d)"""
SUMS = ", ".join(f"(SELECT CAST(any_value(h.d) AS DOUBLE) FROM half h WHERE h.i = t.{x[0]} AND h.j = t.{x[1]}) + (SELECT CAST(any_value(h.d) AS DOUBLE) FROM half h WHERE h.i = t.{y[0]} AND h.j = t.{y[1]}) AS s{k}" for k, (x, y) in enumerate((("ab", "cd"), ("ac", "bd"), ("ad", "bc"))))


@query(f"""WITH {T.HALF}, {DRAWS}, q AS (SELECT qid, {SUMS} FROM t), o AS (SELECT *, list_sort([s0, s1, s2]) AS s FROM q)
    SELECT qid, round(CASE WHEN s[3] > s[1] THEN (s[3] - s[2]) / (s[3] - s[1]) ELSE 0 END, 4) AS delta_q, round((s[3] - s[2]) / 2, 4) AS half_gap, CAST(CASE WHEN s[2] - s[1] > 1e-9 * s[3] THEN list_position([s0, s1, s2], s[1]) - 1 ELSE -1 END AS INTEGER) AS topology FROM o""")
def drawn_quartets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four-point condition over quartets that are drawn, one for each vector."""
    nodes = T.vectors(spark, sf_dir)
    quartets = P.drawn_tuples(nodes, nodes.select(F.col("id").alias("qid")), ["a", "b", "c", "d"])
    found = S.four_point(S.quartet_sums_of(quartets, nodes))
    return found.withColumns({c: F.round(c, 4) for c in ("delta_q", "half_gap")})


@query("""(SELECT 'first' AS how, vec_id AS node FROM embeddings ORDER BY vec_id LIMIT 20) UNION ALL (SELECT 'random', vec_id FROM embeddings ORDER BY md5('0-' || vec_id), vec_id LIMIT 20) UNION ALL (SELECT 'chosen', min(vec_id) FROM embeddings)""")
def chosen_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty centres by each rule, and one that is named."""
    nodes = T.vectors(spark, sf_dir).select(F.col("id").alias("node"))
    least = nodes.agg(F.min("node").alias("n")).first()["n"]
    parts = [P.centers(nodes, 20, "first").select(F.lit("first").alias("how"), "node"), P.centers(nodes, 20, "random").select(F.lit("random").alias("how"), "node")]
    return parts[0].unionAll(parts[1]).unionAll(P.centers(nodes, 1, chosen=[least]).select(F.lit("chosen").alias("how"), "node"))


#: Rows that can be used have distinct customers; half of those are asked for.
@query("""WITH u AS (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus <> 'P')
    SELECT 'half' AS asked, n // 2 AS n, n // 2 AS n_different, CAST(0 AS BIGINT) AS n_unusable, true AS reached FROM u UNION ALL SELECT 'too many', n, n, 0, false FROM u""")
def topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with different customers, sampled over years until half of all customers are there, and until more are
    asked for than there are."""
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("year"), F.col("o_custkey").cast("string").alias("sequence"))
    usable = F.col("o_orderstatus") != "P"
    n = orders.where(usable).select("o_custkey").distinct().count()
    out = None
    for asked, target in (("half", n // 2), ("too many", n + 1)):
        found = P.top_up(orders, target, "year", "o_orderkey", "sequence", usable)
        one = found.rows.agg(F.lit(asked).alias("asked"), F.count("*").alias("n"), F.count_distinct("sequence").alias("n_different"), F.count_if(~usable).alias("n_unusable"), F.lit(found.reached).alias("reached"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_mktsegment AS graph, c_custkey AS group_id, l_suppkey AS node, s_nationkey AS sequence FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey),
    g AS (SELECT graph, group_id, list(DISTINCT node) AS nodes, list(DISTINCT sequence) AS sequences, row_number() OVER (PARTITION BY graph ORDER BY md5(CAST(group_id AS VARCHAR)), group_id) AS cursor FROM e GROUP BY graph, group_id),
    t AS (SELECT *, row_number() OVER (ORDER BY cursor, list_position(['HOUSEHOLD', 'AUTOMOBILE', 'BUILDING', 'MACHINERY', 'FURNITURE'], graph)) AS turn, (SELECT count(DISTINCT node) * 2 // 3 FROM e) AS most_tips, (SELECT count(DISTINCT sequence) - 2 FROM e) AS most_unique FROM g),
    p AS (SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS INTEGER[]) AS tips, CAST([] AS INTEGER[]) AS uniques, false AS accepted, CAST(0 AS BIGINT) AS n_new_tips, CAST(0 AS BIGINT) AS n_new_unique UNION ALL
        SELECT turn, CASE WHEN ok THEN list_concat(tips, new_tips) ELSE tips END, CASE WHEN ok THEN list_concat(uniques, new_unique) ELSE uniques END, ok, len(new_tips), len(new_unique)
        FROM (SELECT *, len(tips) + len(new_tips) <= most_tips AND len(uniques) + len(new_unique) <= most_unique AS ok
            FROM (SELECT t.turn, tips, uniques, most_tips, most_unique, CAST(list_filter(nodes, lambda x: NOT list_contains(tips, x)) AS INTEGER[]) AS new_tips, CAST(list_filter(sequences, lambda x: NOT list_contains(uniques, x)) AS INTEGER[]) AS new_unique FROM p JOIN t ON t.turn = p.turn + 1)))
    SELECT graph, group_id, accepted, n_new_tips, n_new_unique FROM p JOIN t USING (turn)""")
def packed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in turn from each segment bring their suppliers into a panel of two thirds of all, two nations short."""
    supplied = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(T.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
    joined = supplied.join(T.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").join(T.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    groups = joined.select(F.col("c_mktsegment").alias("graph"), F.md5(F.col("c_custkey").cast("string")).alias("rank"), F.col("c_custkey").alias("group_id"), F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("sequence")).distinct()
    sizes = groups.agg(F.count_distinct("node").alias("n"), F.count_distinct("sequence").alias("s")).first()
    return P.packed_panel(groups, ["HOUSEHOLD", "AUTOMOBILE", "BUILDING", "MACHINERY", "FURNITURE"], sizes["s"] - 2, sizes["n"] * 2 // 3)


#: Orders up to each month of each priority, one priority by its month's own number; each customer's balance is a target.
@query("""WITH m AS (SELECT o_orderpriority AS key, month(o_orderdate) AS dimension, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT key, dimension, CASE WHEN key LIKE '1%' THEN n ELSE sum(n) OVER (PARTITION BY key ORDER BY dimension) END AS value FROM m),
    k AS (SELECT key, list(struct_pack(x := CAST(dimension AS DOUBLE), v := CAST(value AS DOUBLE)) ORDER BY dimension) AS c FROM c GROUP BY key),
    t AS (SELECT c_custkey AS id, (c_custkey % 6 + 1) || substr('1-URGENT2-HIGH  3-MEDIUM4-NOT SP5-LOW   6-NONE  ', c_custkey % 6 * 8 + 2, 7) AS name, c_custkey % 6 + 1 AS digit FROM customer),
    g AS (SELECT id, (SELECT min(o_orderpriority) FROM orders WHERE CAST(left(o_orderpriority, 1) AS INTEGER) = digit) AS key, digit FROM t),
    a AS (SELECT id, g.key, CAST(CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN (SELECT value FROM c WHERE c.key = g.key AND dimension = 6) ELSE id * 7 % 4001 END AS DOUBLE) AS target FROM g),
    b AS (SELECT a.*, c, list_sort(list_transform(c, lambda p: struct_pack(d := abs(p.v - target), x := p.x, v := p.v)))[1] AS near, list_filter(c, lambda p: abs(p.v - target) <= 1e-12)[1].x AS same, list_filter(c, lambda p: p.v <= target)[-1] AS low, list_filter(c, lambda p: p.v > target)[1] AS high,
        len(list_filter(range(2, len(c) + 1), lambda i: c[i].v - c[i - 1].v < -1e-12)) = 0 AS rising FROM a LEFT JOIN k USING (key)),
    s AS (SELECT *, CASE WHEN target IS NULL OR c IS NULL THEN 'not_bracketed' WHEN NOT rising THEN 'nonmonotone_calibration' WHEN target < c[1].v OR target > c[-1].v THEN 'outside_calibration_range' WHEN same IS NOT NULL THEN 'exact' WHEN low.v = high.v THEN 'flat_bracket' ELSE 'interpolated' END AS status FROM b)
    SELECT id, key, target, CASE WHEN target IS NOT NULL THEN near.x END AS nearest_dimension, CASE WHEN target IS NOT NULL THEN near.v END AS nearest_value, round(CASE status WHEN 'exact' THEN same WHEN 'interpolated' THEN low.x + (target - low.v) / (high.v - low.v) * (high.x - low.x) END, 6) AS dimension, status FROM s""")
def calibrated_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which month does a priority's count of orders reach a target? One priority has no rising counts, one no orders."""
    from pyspark.sql import Window

    orders = T.table(spark, sf_dir, "orders")
    months = orders.groupBy(F.col("o_orderpriority").alias("key"), F.month("o_orderdate").alias("dimension")).agg(F.count("*").alias("n"))
    value = F.when(F.col("key").startswith("1"), F.col("n")).otherwise(F.sum("n").over(Window.partitionBy("key").orderBy("dimension")))
    curves = months.select("key", "dimension", value.alias("value"))
    names = orders.groupBy(F.left("o_orderpriority", F.lit(1)).cast("bigint").alias("digit")).agg(F.min("o_orderpriority").alias("key"))
    sixth = curves.where("dimension = 6").select("key", F.col("value").alias("sixth"))
    asked = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 6 + 1).alias("digit")).join(names, "digit", "left").join(sixth, "key", "left")
    target = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, F.col("sixth")).otherwise(F.col("id") * 7 % 4001).cast("double")
    return C.interpolated(asked.select("id", "key", target.alias("target")), curves, "key").withColumn("dimension", F.round("dimension", 6))
