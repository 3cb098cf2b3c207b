"""Queries of statistics, dates and scalar functions over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import distance as D
from ..operators import graphs as G
from ..operators import pairs as P
from ..operators import stats as S
from ..operators import temporal as M
from ..storage import settled
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 5


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


DATES = "dates AS (SELECT event_id AS node, CAST(ts AS DATE) AS day FROM events WHERE event_id IN (SELECT vec_id FROM embeddings))"
ORIENTED = f"""{T.knn_sql(K)}, {DATES}, o AS (SELECT source, target, CASE WHEN a.day IS NULL OR b.day IS NULL THEN 'missing' WHEN a.day = b.day THEN 'equal' ELSE 'older_to_newer' END AS status,
    CASE WHEN a.day < b.day THEN source WHEN a.day > b.day THEN target END AS older, CASE WHEN a.day < b.day THEN target WHEN a.day > b.day THEN source END AS newer,
    CASE WHEN a.day <> b.day THEN CAST(abs(date_diff('day', a.day, b.day)) AS INTEGER) END AS lag_days
    FROM knn LEFT JOIN dates a ON a.node = source LEFT JOIN dates b ON b.node = target)"""


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.knn_graph(T.vectors(spark, sf_dir), K)


@query(f"WITH {ORIENTED} SELECT source, target, status, coalesce(older, -1) AS older, coalesce(newer, -1) AS newer, coalesce(lag_days, -1) AS lag_days FROM o")
def temporal_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.orient(_knn(spark, sf_dir), T.dates(spark, sf_dir)).drop("weight").fillna(-1, ["older", "newer", "lag_days"])


@query(f"""WITH {ORIENTED}, i AS (SELECT newer AS node, count(*) AS n FROM o WHERE newer IS NOT NULL GROUP BY 1), u AS (SELECT older AS node, count(*) AS n FROM o WHERE older IS NOT NULL GROUP BY 1),
    c AS (SELECT node, coalesce(i.n, 0) AS n_in, coalesce(u.n, 0) AS n_out FROM dates LEFT JOIN i USING (node) LEFT JOIN u USING (node))
    SELECT node, n_in, n_out, CASE WHEN n_in = 0 AND n_out = 0 THEN 'isolated' WHEN n_in = 0 THEN 'source' WHEN n_out = 0 THEN 'sink' ELSE 'bridge' END AS role, least(n_in, n_out) AS bridge, n_in * n_out AS flow FROM c""")
def temporal_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = T.dates(spark, sf_dir)
    return M.roles(M.orient(_knn(spark, sf_dir), dates), dates)


@query(f"WITH {ORIENTED}, l AS (SELECT coalesce(lag_days, 0) AS lag FROM o WHERE status <> 'missing') SELECT count(*) AS n, round(avg(lag), 6) AS mean, round(stddev_samp(lag), 6) AS sd, min(lag) AS min, max(lag) AS max FROM l")
def edge_date_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.edge_lags(_knn(spark, sf_dir), T.dates(spark, sf_dir)), "mean", "sd")


@query(f"""WITH {T.HALF}, {DATES}, b AS (SELECT i AS center, radius, j AS node FROM (SELECT i, j, d FROM half UNION ALL SELECT id, id, 0 FROM nodes), (SELECT unnest([7.0, 8.0]) AS radius) WHERE d <= radius),
    g AS (SELECT center, radius, date_diff('day', DATE '1970-01-01', day) AS x, row_number() OVER (PARTITION BY center, radius ORDER BY day) AS r FROM b JOIN dates USING (node)),
    m AS (SELECT center, radius, count(*) AS n_dated, max(x) - min(x) AS span, CASE WHEN count(*) > 1 THEN (sum(x * (2 * r - 1)) - count(*) * sum(x)) / (count(*) * (count(*) - 1) / 2) ELSE 0 END AS mean_gap FROM g GROUP BY 1, 2),
    s AS (SELECT center, radius, count(*) AS n_nodes FROM b GROUP BY 1, 2)
    SELECT center, radius, n_nodes, coalesce(n_dated, 0) AS n_dated, CAST(span AS INTEGER) AS span, round(mean_gap, 6) AS mean_gap FROM s LEFT JOIN m USING (center, radius)""")
def ball_date_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balls of raw distance around every vector; only pairs within the largest radius leave the kernel."""
    nodes = T.vectors(spark, sf_dir)
    near = D.both_ways(D.pairwise(nodes, within=8.0)).unionByName(nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).cast("float").alias("d")))
    balls = near.withColumn("radius", F.explode(F.array(F.lit(7.0), F.lit(8.0)))).where("d <= radius").select(F.col("i").alias("center"), "radius", F.col("j").alias("node"))
    return _round(M.ball_spread(balls, T.dates(spark, sf_dir)), "mean_gap")


PROFILES = """p AS (SELECT user_id AS node, list_sort(list(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)))) AS days FROM events GROUP BY user_id),
    q AS (SELECT node, days, len(days) AS n, days[1] AS first, days[1 + CAST(round_even((len(days) - 1) * 0.25, 0) AS INTEGER)] AS q25, days[1 + CAST(round_even((len(days) - 1) * 0.5, 0) AS INTEGER)] AS median, days[1 + CAST(round_even((len(days) - 1) * 0.75, 0) AS INTEGER)] AS q75, days[-1] AS last FROM p)"""


@query(f"WITH {PROFILES} SELECT node, CAST(n AS INTEGER) AS n, CAST(first AS INTEGER) AS first, CAST(q25 AS INTEGER) AS q25, CAST(median AS INTEGER) AS median, CAST(q75 AS INTEGER) AS q75, CAST(last AS INTEGER) AS last, CAST(last - first AS INTEGER) AS span FROM q")
def date_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.to_date("ts").alias("day"))
    return M.profiles(events).drop("days")


@query(f"""WITH {T.knn_sql(K)}, {PROFILES}
    SELECT source, target, CASE WHEN a.last < b.first THEN 'before' WHEN b.last < a.first THEN 'after' ELSE 'overlap' END AS relation, CAST(greatest(b.first - a.last, a.first - b.last, 0) AS INTEGER) AS gap,
    round(list_sum(list_transform(a.days, lambda x: len(list_filter(b.days, lambda y: x < y)))) / (len(a.days) * len(b.days)), 6) AS p_before
    FROM knn JOIN q a ON a.node = source JOIN q b ON b.node = target""")
def edge_date_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between vectors whose ids are users with events: a user's days are its node's."""
    events = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.to_date("ts").alias("day"))
    return _round(M.edge_relations(_knn(spark, sf_dir), M.profiles(events)), "p_before")


@query(f"""WITH {ORIENTED}, k AS (SELECT unnest(generate_series(1, 99)) AS k), n AS (SELECT k, node, row_number() OVER (PARTITION BY k ORDER BY node) AS r FROM dates, k), x AS (SELECT k, day, row_number() OVER (PARTITION BY k ORDER BY md5(k || '-' || node), node) AS r FROM dates, k),
    dealt AS (SELECT k, node, day FROM n JOIN x USING (k, r)), m AS (SELECT a.k, avg(abs(date_diff('day', a.day, b.day))) AS m FROM knn JOIN dealt a ON a.node = source JOIN dealt b ON b.node = target AND b.k = a.k GROUP BY a.k),
    s AS (SELECT avg(coalesce(lag_days, 0)) AS observed FROM o WHERE status <> 'missing') SELECT round(any_value(observed), 6) AS observed, round(avg(m), 6) AS null_mean, round(stddev_samp(m), 6) AS null_sd, round((any_value(observed) - avg(m)) / stddev_samp(m), 6) AS z,
    round((count(*) FILTER (m >= observed) + 1) / (count(*) + 1), 6) AS p_ge, round((count(*) FILTER (m <= observed) + 1) / (count(*) + 1), 6) AS p_le FROM m, s""")
def date_shuffle_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = M.lag_null(settled(_knn(spark, sf_dir), "knn"), T.dates(spark, sf_dir), 99)
    return _round(one, *one.columns)


def dated_pairs(spark: SparkSession, sf_dir: str, *metrics: str) -> P.Pairs:
    """d (cityblock), t (euclidean) and days of all pairs of vectors that have a date."""
    dates = T.dates(spark, sf_dir).select(F.col("node").alias("id"), F.unix_date("day").alias("days"))
    named = {"d": "cityblock", "t": "euclidean"}
    return P.Pairs(T.vectors(spark, sf_dir).join(dates, "id"), {m: named[m] for m in metrics}, {"days": None})


PAIR_DAYS = f"""{T.PAIRS}, {DATES}, pd AS (SELECT p.i, p.j, round(CAST(p.d AS DOUBLE), 3) AS d, round(CAST(CAST(sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))) AS FLOAT) AS DOUBLE), 3) AS t,
    CAST(abs(date_diff('day', a.day, b.day)) AS DOUBLE) AS days FROM pairs p JOIN nodes x ON x.id = i JOIN nodes y ON y.id = j JOIN dates a ON a.node = i JOIN dates b ON b.node = j)"""
RANKS = ", r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}" for c in ("d", "t", "days")) + " FROM pd)"


@query(f"WITH {PAIR_DAYS}{RANKS} SELECT count(*) AS n, round(corr(r_d, r_days), 6) AS rho FROM r")
def spearman_distance_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(P.spearman(dated_pairs(spark, sf_dir, "d"), "d", "days"), "rho")


@query(f"""WITH {PAIR_DAYS}{RANKS}, c AS (SELECT count(*) AS n, corr(r_d, r_days) AS xy, corr(r_d, r_t) AS xz, corr(r_days, r_t) AS yz FROM r)
    SELECT n, round((xy - xz * yz) / sqrt((1 - xz ** 2) * (1 - yz ** 2)), 6) AS rho, round(xy, 6) AS rho_xy, round(xz, 6) AS rho_xz, round(yz, 6) AS rho_yz FROM c""")
def partial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(P.partial_spearman(dated_pairs(spark, sf_dir, "d", "t"), "d", "days", "t"), "rho", "rho_xy", "rho_xz", "rho_yz")


@query(f"""WITH {PAIR_DAYS}, s AS (SELECT sqrt(sum((d - t) ** 2) / sum(d ** 2)) AS rsd, sum(d * t) / sum(t ** 2) AS scale FROM pd)
    SELECT round(any_value(rsd), 6) AS rsd, round(any_value(scale), 6) AS scale, count(*) AS n, round(max(greatest(d / (scale * t), scale * t / d)), 6) AS max_distortion, round(avg(abs(ln(d / (scale * t)))), 6) AS mean_log_distortion FROM pd, s WHERE d > 1e-12 AND t > 1e-12""")
def distance_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(P.distance_fit(dated_pairs(spark, sf_dir, "d", "t"), "d", "t"), "rsd", "scale", "max_distortion", "mean_log_distortion")


QUARTETS = """qs AS (SELECT a AS qid, a, b, c, d FROM (SELECT id AS a, (id * 7 + 1) % n AS b, (id * 13 + 2) % n AS c, (id * 29 + 3) % n AS d FROM nodes, (SELECT count(*) AS n FROM nodes)) WHERE a NOT IN (b, c, d) AND b NOT IN (c, d) AND c <> d)"""


def _quartet_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.vectors(spark, sf_dir)
    n = F.lit(nodes.count())
    ids = nodes.select("id", *(F.pmod(F.col("id") * k + o, n).alias(c) for c, k, o in (("b", 7, 1), ("c", 13, 2), ("d", 29, 3))))
    quartets = ids.select(F.col("id").alias("qid"), F.col("id").alias("a"), "b", "c", "d").where("a NOT IN (b, c, d) AND b NOT IN (c, d) AND c <> d")
    return S.quartet_sums_of(quartets, nodes)


SUMS = f"WITH {T.HALF}, {QUARTETS}, q AS (SELECT qid, " + ", ".join(f"(SELECT CAST(any_value(d) AS DOUBLE) FROM half WHERE i = qs.{x[0]} AND j = qs.{x[1]}) + (SELECT CAST(any_value(d) AS DOUBLE) FROM half WHERE i = qs.{y[0]} AND j = qs.{y[1]}) AS s{k}" for k, (x, y) in enumerate((("ab", "cd"), ("ac", "bd"), ("ad", "bc")))) + " FROM qs), o AS (SELECT *, list_sort([s0, s1, s2]) AS s FROM q)"


@query(SUMS + " SELECT qid, round((s[3] - s[2]) / (s[3] - s[1]), 4) AS delta_q, round((s[3] - s[2]) / 2, 4) AS half_gap, CAST(list_position([s0, s1, s2], s[1]) - 1 AS INTEGER) AS topology FROM o")
def four_point_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.four_point(_quartet_sums(spark, sf_dir)), "delta_q", "half_gap", places=4)


@query(SUMS + " SELECT count(*) AS n, round(max((s[3] - s[2]) / 2), 4) AS delta FROM o")
def gromov_hyperbolicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.gromov(_quartet_sums(spark, sf_dir)), "delta", places=4)


@query("""WITH x AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate) AS x, o_totalprice AS y FROM orders)
    SELECT count(*) AS n, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(corr(x, y), 7) AS r, round(regr_r2(y, x), 8) AS r2, round(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 2)), 2) AS residual_sd FROM x""")
def date_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "orders").select(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    one = S.regression(rows, "x", "y")
    return one.select("n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 7).alias("r"), F.round("r2", 8).alias("r2"), F.round("residual_sd", 2).alias("residual_sd"))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(value)), 6) AS se, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci95, min(value) AS min, max(value) AS max FROM events GROUP BY event_type""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.summary(T.table(spark, sf_dir, "events"), "value", "event_type"), "mean", "sd", "se", "ci95")


@query("SELECT event_type, quantile_cont(value, 0.0) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, quantile_cont(value, 1.0) AS max, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.five_numbers(T.table(spark, sf_dir, "events"), "value", "event_type"), "q1", "median", "q3", "mean")


@query("""WITH b AS (SELECT least(CAST(floor(value / 0.5) AS BIGINT), 199) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1), r AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS share FROM b)
    SELECT quantile, round((min(bin) + 0.5) * 0.5, 6) AS value FROM r, (SELECT unnest([0.25, 0.5, 0.9]) AS quantile) WHERE share >= quantile GROUP BY quantile""")
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.histogram_quantiles(T.table(spark, sf_dir, "events"), "value", 0.0, 100.0, [0.25, 0.5, 0.9]), "value")


@query("""WITH r AS (SELECT event_type = 'click' AS g, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r FROM events WHERE event_type IN ('click', 'view')),
    t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY value)), s AS (SELECT CAST(count(*) FILTER (g) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n2, sum(r) FILTER (g) AS r1, quantile_cont(value, 0.5) FILTER (g) AS median1, quantile_cont(value, 0.5) FILTER (NOT g) AS median2 FROM r),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s, t)
    SELECT n1, n2, round(median1, 6) AS median1, round(median2, 6) AS median2, u, round(2 * u / (n1 * n2) - 1, 8) AS rank_biserial, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""")
def rank_sum_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    one = S.rank_sum(events, "value", F.col("event_type") == "click").drop("p")
    return one.select("n1", "n2", F.round("median1", 6).alias("median1"), F.round("median2", 6).alias("median2"), "u", F.round("rank_biserial", 8).alias("rank_biserial"), F.round("z", 6).alias("z"))


@query("""WITH r AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS g, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS r FROM events),
    p AS (SELECT user_id, count(*) AS n, sum(g) AS m, sum(g * r) AS w, var_pop(r) AS v FROM r GROUP BY user_id HAVING sum(g) > 0 AND sum(g) < count(*))
    SELECT count(*) AS n_strata, round(sum((w - m * (n + 1) / 2) / (n + 1)) / sqrt(sum(m * (n - m) / (n - 1) * v / (n + 1) ** 2)), 6) AS z FROM p""")
def stratified_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events")
    return _round(S.stratified_rank_sum(events, "value", F.col("event_type") == "click", "user_id").drop("p"), "z")


@query("SELECT round((avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type <> 'click')) / sqrt((var_samp(value) FILTER (event_type = 'click') + var_samp(value) FILTER (event_type <> 'click')) / 2), 8) AS smd FROM events")
def standardized_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.standardized_difference(T.table(spark, sf_dir, "events"), "value", F.col("event_type") == "click"), "smd", places=8)


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contingency(T.table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("""WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY c_mktsegment, c_nationkey), a AS (SELECT sum(n * (n - 1) / 2) AS cells, sum(n) AS n FROM c),
    x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY c_mktsegment)), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY c_nationkey))
    SELECT CAST(n AS BIGINT) AS n, round((cells - x.v * y.v / (n * (n - 1) / 2)) / ((x.v + y.v) / 2 - x.v * y.v / (n * (n - 1) / 2)), 8) AS ari FROM a, x, y""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.adjusted_rand(T.table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey"), "ari", places=8)


@query("""WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT DISTINCT p FROM c), t AS (SELECT x.p AS f, y.p AS o, z.p AS q FROM l x JOIN l y ON x.p <> y.p JOIN l z ON z.p NOT IN (x.p, y.p)),
    v AS (SELECT t.*, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(d.n, 0) AS d FROM t LEFT JOIN c a ON a.s = 'F' AND a.p = f LEFT JOIN c b ON b.s = 'O' AND b.p = o LEFT JOIN c d ON d.s = 'P' AND d.p = q), w AS (SELECT * FROM v ORDER BY a + b + d DESC, f, o, q LIMIT 1)
    SELECT unnest(['F', 'O', 'P']) AS o_orderstatus, unnest([f, o, q]) AS o_orderpriority, unnest([a, b, d]) AS n FROM w""")
def cluster_label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    return S.best_mapping(rows, "o_orderstatus", "o_orderpriority")


@query("SELECT CAST(year(CAST(ts AS DATE)) AS INTEGER) AS year, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def yearly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").groupBy(F.year("ts").alias("year"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
    SELECT day, count(*) AS users, round(avg(coalesce(n, 0)), 6) AS mean, CAST(max(coalesce(n, 0)) AS BIGINT) AS most FROM (SELECT * FROM u CROSS JOIN d) LEFT JOIN c USING (user_id, day) GROUP BY day""")
def completed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without events on a day count as zero: the zeros are the users who are not there, so nothing is multiplied."""
    counted = T.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    users = counted.agg(F.count_distinct("user_id").alias("users"))
    return counted.groupBy("day").agg(F.sum("n").alias("s"), F.max("n").alias("most")).join(F.broadcast(users)).select("day", "users", F.round(F.col("s") / F.col("users"), 6).alias("mean"), "most")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["click", "view", "purchase"]
    return T.table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", names).count().fillna(0, names)


@query("""SELECT 'event_type' AS group_type, event_type AS group_value, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type
    UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*), round(avg(value), 6) FROM events GROUP BY user_id""")
def stacked_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").select("value", F.explode(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))).alias("group_type", "group_value"))
    return rows.groupBy("group_type", "group_value").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) SELECT a.event_type AS left_type, b.event_type AS right_type, count(*) AS n, round(avg(b.m - a.m), 6) AS delta FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = T.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    a, b = (means.select("user_id", F.col("event_type").alias(f"{p}_type"), F.col("m").alias(p)) for p in ("left", "right"))
    both = a.join(b, "user_id").where("left_type < right_type")
    return both.groupBy("left_type", "right_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("right") - F.col("left")), 6).alias("delta"))


@query("SELECT min(doc_id) AS representative, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY sha256(text)")
def duplicate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents")
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("representative"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(year(o_orderdate) + date_diff('day', date_trunc('year', o_orderdate), o_orderdate) / date_diff('day', date_trunc('year', o_orderdate), date_trunc('year', o_orderdate) + INTERVAL 1 YEAR), 8) AS decimal_year,
    year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, CASE WHEN o_custkey <= 5 THEN CAST(o_custkey AS VARCHAR) WHEN o_custkey <= 9 THEN '6-9' ELSE '10+' END AS degree_bin, CASE WHEN o_custkey <= 5 THEN CAST(o_custkey AS VARCHAR) WHEN o_custkey <= 9 THEN '6-9' WHEN o_custkey <= 24 THEN '10-24' WHEN o_custkey <= 49 THEN '25-49' WHEN o_custkey <= 99 THEN '50-99' ELSE '100+' END AS multiplicity_bin FROM orders""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return T.table(spark, sf_dir, "orders").select("o_orderkey", F.round(C.decimal_year(day), 8).alias("decimal_year"), C.quarter_label(day).alias("quarter"), C.degree_bin(F.col("o_custkey")).alias("degree_bin"), C.multiplicity_bin(F.col("o_custkey")).alias("multiplicity_bin"))


@query("""WITH q AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || o_orderpriority AS stratum, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER (PARTITION BY year(o_orderdate), o_orderpriority) AS n FROM orders)
    SELECT stratum, o_orderkey FROM q WHERE r <= ceil(n * 0.1)""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each stratum, in the order of a hash."""
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("_", F.year("o_orderdate").cast("string"), "o_orderpriority").alias("stratum"))
    w = Window.partitionBy("stratum")
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("r") <= F.ceil(F.col("n") * F.lit(0.1))).select("stratum", "o_orderkey")


@query("""SELECT CASE WHEN length(translate(text, ' -', '')) < 200 THEN 'short' WHEN (length(text) - length(translate(text, 'XBZJ', ''))) / length(text) > 0.05 THEN 'ambiguous' WHEN position('*' IN rtrim(text, '*')) > 0 THEN 'stop' ELSE 'pass' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that a text fails, as for sequences."""
    text = F.col("text")
    reason = F.when(F.length(F.translate(text, " -", "")) < 200, "short").when(C.ambiguous_count(text) / F.length(text) > 0.05, "ambiguous").when(F.instr(F.rtrim(text, F.lit("*")), "*") > 0, "stop").otherwise("pass")
    return T.table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
