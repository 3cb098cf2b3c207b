"""Queries of exact laws, shifts and bootstrap medians, with SQL: recursions over items, and cross joins where the
engine forms none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import exact as X
from . import tables as T
from .comparison_queries import tail_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH a AS (SELECT value FROM events WHERE event_type = 'click' AND value IS NOT NULL), b AS (SELECT value FROM events WHERE event_type <> 'click' AND value IS NOT NULL)
    SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, (SELECT round(median(a.value - b.value), 6) FROM a CROSS JOIN b) AS shift""")
def hodges_lehmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much larger are the values of clicks? The median of all differences, by counting."""
    events = T.table(spark, sf_dir, "events")
    return X.shift(events, "value", F.col("event_type") == "click").withColumn("shift", F.round("shift", 6))


#: Users of even number fall into small groups by day of the week, others are groups each.
GROUP_SQL = "CASE WHEN user_id % 2 = 0 THEN user_id * 10 + dayofweek(ts) + 1 ELSE user_id END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("user_id") % 2 == 0, F.col("user_id") * 10 + F.dayofweek("ts")).otherwise(F.col("user_id"))
    return T.table(spark, sf_dir, "events").withColumn("grp", group)


@query(f"""WITH RECURSIVE e AS (SELECT {GROUP_SQL} AS grp, floor(value / 10) AS v, CAST(event_type = 'click' AS BIGINT) AS g FROM events WHERE value IS NOT NULL),
    r AS (SELECT grp, g, rank() OVER (PARTITION BY grp ORDER BY v) * 2 + count(*) OVER (PARTITION BY grp, v) - 1 AS r, row_number() OVER (PARTITION BY grp ORDER BY v) AS i, count(*) OVER (PARTITION BY grp, v) AS c FROM e),
    s AS (SELECT grp, count(*) AS n, CAST(sum(g) AS BIGINT) AS n1, CAST(sum(g * r) AS BIGINT) AS w, CAST(sum(c * c - 1) AS DOUBLE) AS ties FROM r GROUP BY grp),
    d(i, grp, k, total, ways) AS (SELECT CAST(0 AS BIGINT), grp, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM s WHERE n <= {X.EXACT_VALUES} AND n1 > 0 AND n1 < n
        UNION ALL SELECT d.i + 1, d.grp, d.k + x.x, d.total + x.x * r.r, sum(ways) FROM d JOIN r ON r.grp = d.grp AND r.i = d.i + 1 JOIN s ON s.grp = d.grp CROSS JOIN (VALUES (0), (1)) x(x) WHERE d.k + x.x <= s.n1 GROUP BY ALL),
    t AS (SELECT s.grp, sum(ways) FILTER (total <= w) / sum(ways) AS low, sum(ways) FILTER (total >= w) / sum(ways) AS high FROM d JOIN s ON s.grp = d.grp AND d.i = s.n AND d.k = s.n1 GROUP BY s.grp),
    u AS (SELECT *, n - n1 AS n2, w / 2 - n1 * (n1 + 1) / 2 AS u, n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1))) AS var FROM s),
    z AS (SELECT *, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(CASE WHEN var > 0 THEN var END) AS z FROM u)
    SELECT grp, n1, n2, u, CASE WHEN n1 > 0 AND n2 > 0 THEN round(2 * u / (n1 * n2) - 1, 6) END AS rank_biserial, CASE WHEN n1 > 0 AND n2 > 0 THEN round(CASE WHEN low IS NOT NULL THEN least(1, 2 * least(low, high)) WHEN z IS NULL THEN 1 ELSE least(1, 2 * {tail_sql("z")}) END, 6) END AS p, low IS NOT NULL AS exact FROM z LEFT JOIN t USING (grp)""")
def rank_sum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks against other events in each group, by values in tens; the exact law in small groups."""
    events = _events(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 10))
    found = X.rank_sum_tests(events, "v", F.col("event_type") == "click", "grp")
    return found.withColumns({c: F.round(c, 6) for c in ("rank_biserial", "p")})


@query(f"""WITH RECURSIVE e AS (SELECT {GROUP_SQL} AS grp, floor((value - lag(value) OVER (PARTITION BY {GROUP_SQL} ORDER BY event_id)) / 5) AS delta FROM events),
    a AS (SELECT * FROM e WHERE delta IS NOT NULL),
    r AS (SELECT grp, delta > 0 AS up, rank() OVER (PARTITION BY grp ORDER BY abs(delta)) * 2 + count(*) OVER (PARTITION BY grp, abs(delta)) - 1 AS r, row_number() OVER (PARTITION BY grp ORDER BY abs(delta)) AS i, count(*) OVER (PARTITION BY grp, abs(delta)) AS c FROM a WHERE delta <> 0),
    s AS (SELECT grp, count(*) AS m, count(*) FILTER (up) AS n_positive, CAST(coalesce(sum(r) FILTER (up), 0) AS BIGINT) AS w, CAST(sum(c * c - 1) AS DOUBLE) AS ties FROM r GROUP BY grp),
    d(i, grp, total, ways) AS (SELECT CAST(0 AS BIGINT), grp, CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM s WHERE m <= {X.EXACT_VALUES}
        UNION ALL SELECT d.i + 1, d.grp, d.total + x.x * r.r, sum(ways) FROM d JOIN r ON r.grp = d.grp AND r.i = d.i + 1 CROSS JOIN (VALUES (0), (1)) x(x) GROUP BY ALL),
    t AS (SELECT s.grp, sum(ways) FILTER (total <= w) / sum(ways) AS low, sum(ways) FILTER (total >= w) / sum(ways) AS high FROM d JOIN s ON s.grp = d.grp AND d.i = s.m GROUP BY s.grp),
    z AS (SELECT *, abs(w / 2 - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z, least(n_positive, m - n_positive) AS least FROM s)
    SELECT grp, n, coalesce(n_positive, 0) AS n_positive, coalesce(m - n_positive, 0) AS n_negative, coalesce(w / 2, 0.0) AS w, round(CASE WHEN low IS NOT NULL THEN least(1, 2 * least(low, high)) WHEN m > 0 THEN least(1, 2 * {tail_sql("z")}) END, 6) AS p, coalesce(low IS NOT NULL, false) AS exact,
        round(CASE WHEN m > 0 THEN least(1, 2 * list_sum(list_transform(range(0, least + 1), lambda k: exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2))))) END, 6) AS sign_p
    FROM (SELECT grp, count(*) AS n FROM a GROUP BY grp) LEFT JOIN z USING (grp) LEFT JOIN t USING (grp)""")
def signed_rank_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from a group's event to its next, in fives: signed-rank and sign tests."""
    change = F.floor((F.col("value") - F.lag("value").over(Window.partitionBy("grp").orderBy("event_id"))) / 5)
    found = X.signed_rank_tests(_events(spark, sf_dir).withColumn("delta", change), "delta", "grp")
    return found.withColumns({c: F.round(c, 6) for c in ("p", "sign_p")})


@query(f"""WITH k AS (SELECT event_type, value AS v, k, CASE WHEN k = 0 THEN 1 ELSE len(list_filter({X.POISSON}, lambda p: p < CAST('0x' || substr(md5(event_id || '-' || k), 1, 8) AS BIGINT) / 4294967296.0)) END AS w
        FROM events CROSS JOIN range(0, 41) r(k) WHERE value IS NOT NULL),
    c AS (SELECT event_type, k, v, sum(w) AS n FROM k WHERE w > 0 GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY event_type, k ORDER BY v) AS run, sum(n) OVER (PARTITION BY event_type, k) AS whole FROM c),
    m AS (SELECT event_type, k, (min(v) FILTER (2 * run >= whole) + min(v) FILTER (2 * run > whole)) / 2 AS m, any_value(whole) AS whole FROM s GROUP BY ALL)
    SELECT event_type, CAST(max(whole) FILTER (k = 0) AS BIGINT) AS n, round(max(m) FILTER (k = 0), 6) AS median, round(quantile_cont(m, 0.025) FILTER (k > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (k > 0), 6) AS high FROM m GROUP BY event_type""")
def bootstrap_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median value of each kind of event, and its interval over 40 resamples."""
    found = X.bootstrap_medians(T.table(spark, sf_dir, "events"), "value", "event_id", 40, "event_type")
    return found.withColumns({c: F.round(c, 6) for c in ("median", "low", "high")})
