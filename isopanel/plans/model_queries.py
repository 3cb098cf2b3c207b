"""Queries of clustering, trees, files and streams over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import cluster as K
from ..operators import flows
from ..operators import graphs as G
from ..operators import refine
from ..operators import stats as S
from ..operators import temporal as M
from ..operators import trees as R
from ..sources import fasta
from ..storage import settled, shared_dir
from ..streaming import moments
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


def _first_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest id of each label."""
    least = T.labels(spark, sf_dir).groupBy("label").agg(F.min("node").alias("node"))
    return least.select(F.lit(0).alias("repeat"), F.col("label").cast("int").alias("slot"), "node")


MEDOIDS = T.HALF + ", m AS (SELECT CAST(label AS INTEGER) AS slot, min(id) AS node FROM nodes GROUP BY 1), z AS (SELECT j AS node, min({'d': d, 's': slot}) AS b FROM half JOIN m ON m.node = i WHERE j NOT IN (SELECT node FROM m) GROUP BY j), a AS (SELECT node, b.s AS slot FROM z UNION ALL SELECT node, slot FROM m)"


@query(f"WITH {MEDOIDS} SELECT node, slot FROM a")
def medoid_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.assign_vectors(T.vectors(spark, sf_dir), _first_medoids(spark, sf_dir)).select("node", "slot")


@query(f"""WITH {MEDOIDS}, s AS (SELECT x.slot, x.node, sum(CAST(d AS DOUBLE)) AS s FROM half JOIN a x ON x.node = i JOIN a y ON y.node = j AND x.slot = y.slot GROUP BY ALL)
    SELECT slot, arg_min(node, {{'s': s, 'n': node}}) AS node FROM s GROUP BY slot""")
def medoid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.vectors(spark, sf_dir)
    return K.update_vectors(nodes, K.assign_vectors(nodes, _first_medoids(spark, sf_dir))).select("slot", "node")


@query()
def k_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three repeats from designed starts: steps, objective and agreement with the labels."""
    labels = T.labels(spark, sf_dir)
    assigned, runs = K.k_medoids_vectors(T.vectors(spark, sf_dir), K.design(labels, 3))
    agreed = [S.adjusted_rand(assigned.where(F.col("repeat") == r).join(labels, "node"), "slot", "label").select(F.lit(r).alias("repeat"), F.round("ari", 6).alias("ari")) for r in range(3)]
    return runs.join(agreed[0].unionAll(agreed[1]).unionAll(agreed[2]), "repeat").withColumn("objective", F.round("objective", 3))


@query("""WITH p AS (SELECT p_partkey AS node, CAST(p_size AS INTEGER) AS slot, rpad(p_brand || p_type, 24, '-') AS s FROM part),
    d AS (SELECT a.slot, a.node, CAST(sum(hamming(a.s, b.s)) AS BIGINT) AS s FROM p a JOIN p b USING (slot) GROUP BY ALL)
    SELECT CAST(0 AS INTEGER) AS repeat, slot, arg_min(node, {'s': s, 'n': node}) AS node, min(s) AS s FROM d GROUP BY slot""")
def hamming_profile_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medoids of brands and types as aligned strings, a cluster for each size of parts."""
    parts = T.table(spark, sf_dir, "part")
    strings = parts.select(F.col("p_partkey").alias("node"), F.rpad(F.concat("p_brand", "p_type"), 24, "-").alias("s"))
    return K.profile_medoids(strings, parts.select(F.lit(0).alias("repeat"), F.col("p_size").cast("int").alias("slot"), F.col("p_partkey").alias("node")))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of everything, regions, nations and customers; branches are keys of one digit."""
    region, nation, customer = (T.table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    one = lambda c: (F.col(c) % 7 + 1).cast("double").alias("branch")
    top = spark.range(1).select(F.lit("all").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("branch"))
    return (
        top.unionAll(region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("all"), one("r_regionkey")))
        .unionAll(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), one("n_nationkey")))
        .unionAll(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), one("c_custkey")))
    )


PLACES = "p AS (SELECT c_custkey AS k, n_nationkey AS n, r_regionkey AS r, c_custkey % 7 + 1 AS bc, n_nationkey % 7 + 1 AS bn, r_regionkey % 7 + 1 AS br FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {PLACES} SELECT 'c' || k AS node, 3 AS depth, CAST(bc + bn + br AS DOUBLE) AS root_dist FROM p UNION ALL SELECT DISTINCT 'n' || n, 2, CAST(bn + br AS DOUBLE) FROM p UNION ALL SELECT 'r' || r_regionkey, 1, CAST(r_regionkey % 7 + 1 AS DOUBLE) FROM region UNION ALL SELECT 'all', 0, 0.0")
def rooted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rooted(_places(spark, sf_dir)).select("node", "depth", "root_dist")


@query(f"""WITH {PLACES} SELECT 'c' || a.k AS i, 'c' || b.k AS j, CASE WHEN a.n = b.n THEN 'n' || a.n WHEN a.r = b.r THEN 'r' || a.r ELSE 'all' END AS lca,
    CAST(a.bc + b.bc + CASE WHEN a.n = b.n THEN 0 ELSE a.bn + b.bn END + CASE WHEN a.r = b.r THEN 0 ELSE a.br + b.br END AS DOUBLE) AS d FROM p a JOIN p b ON b.k = a.k + 1""")
def patristic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the next ones."""
    nodes = R.rooted(_places(spark, sf_dir))
    ids = T.table(spark, sf_dir, "customer").select("c_custkey")
    following = ids.select((F.col("c_custkey") - 1).alias("c_custkey"))
    pairs = ids.join(following, "c_custkey").select(F.concat(F.lit("c"), "c_custkey").alias("i"), F.concat(F.lit("c"), F.col("c_custkey") + 1).alias("j"))
    return R.patristic(nodes, pairs, nodes)


@query()
def neighbour_joining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each label, and how far its distances are from those given."""
    labels = T.labels(spark, sf_dir).select(F.col("node").alias("id"), F.col("label").alias("group"))
    return R.tree_fits(T.vectors(spark, sf_dir).join(labels, "id")).withColumn("rsd", F.round("rsd", 6))


@query("""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS stratum, count(*) AS size FROM orders GROUP BY 1), a AS (SELECT *, CASE WHEN size >= 3 THEN least(size, 100) ELSE size END AS start FROM s),
    m AS (SELECT *, (SELECT count(*) // 3 FROM orders) - sum(start) OVER () AS missing FROM a), r AS (SELECT *, CASE WHEN missing < 0 THEN start - least(size, 3, start) ELSE size - start END AS room FROM m),
    x AS (SELECT *, abs(missing) * room / sum(room) OVER () AS x FROM r), b AS (SELECT *, floor(x) AS base FROM x),
    l AS (SELECT *, abs(missing) - sum(base) OVER () AS spare, row_number() OVER (ORDER BY x - base DESC, stratum) AS r FROM b)
    SELECT stratum, size, CAST(start + sign(missing) * (base + CASE WHEN r <= spare THEN 1 ELSE 0 END) AS BIGINT) AS n FROM l""")
def exact_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all orders, dealt to months: a hundred of each at first, then more or fewer, three at least."""
    orders = T.table(spark, sf_dir, "orders")
    strata = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("stratum")).agg(F.count("*").alias("size"))
    return R.allocate(strata, orders.count() // 3, 3, 100)


@query("SELECT 'doc' || doc_id AS accession, 'doc' || doc_id || ' c.' || n_chars || 'G>A of ' || source AS header, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS length, md5(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS digest FROM documents")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of documents written as FASTA and read back."""
    rows = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(" c."), "n_chars", F.lit("G>A of "), "source").alias("header"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    path = shared_dir(spark, "fasta")
    fasta.write_fasta(rows, path)
    return fasta.read_fasta(spark, path).select("accession", "header", F.length("seq").cast("bigint").alias("length"), F.md5("seq").alias("digest"))


@query("""SELECT event_type AS graph, count(*) AS n, round(avg(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))), 6) AS mean, round(stddev_samp(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))), 6) AS sd, CAST(min(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS INTEGER) AS min, CAST(max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS INTEGER) AS max FROM events GROUP BY 1""")
def streamed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of lags; the last batch's moments."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern stands for a file as well as for a folder of files
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    lags = stream.select(F.col("event_type").alias("graph"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("lag_days"))
    out = shared_dir(spark, "moments")
    found = moments.keep_moments(lags, out, shared_dir(spark, "moments-checkpoint"))
    found.awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select("graph", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "min", "max")


@query()
def date_roles_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean days between the members of each label, without pairs."""
    rows = T.labels(spark, sf_dir).join(T.dates(spark, sf_dir), "node")
    return M.mean_pairwise_gap(rows, "label").withColumn("mean_gap", F.round("mean_gap", 6))


ORACLE_SQL["date_roles_by_label"] = """WITH x AS (SELECT CAST(label AS VARCHAR) AS label, vec_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS x FROM embeddings JOIN events ON event_id = vec_id)
    SELECT label, n, CAST(span AS INTEGER) AS span, round(mean_gap, 6) AS mean_gap FROM (SELECT label, count(*) AS n, max(x) - min(x) AS span FROM x GROUP BY label) JOIN (SELECT a.label, avg(abs(a.x - b.x)) AS mean_gap FROM x a JOIN x b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label) USING (label)"""


@query()
def directional_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.vectors(spark, sf_dir)
    kept = refine.directional_refinement(nodes, settled(G.knn_graph(nodes, 10), "knn"))
    return kept.select("source", "target", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query()
def spectral_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.vectors(spark, sf_dir)
    found = refine.spectral_layout(nodes.select(F.col("id").alias("node")), settled(G.knn_graph(nodes, 5), "knn"))
    return found.select("node", F.round(F.abs("x"), 5).alias("x"))


@query()
def local_shuffle_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean days between ends of edges by shuffle, dates moved by two days at most."""
    edges, dates = settled(G.knn_graph(T.vectors(spark, sf_dir), 5), "knn"), T.dates(spark, sf_dir)
    dealt = settled(M.locally_shuffled(dates, 20, 2), "dealt")
    a, b = (dealt.select("shuffle", F.col("node").alias(c), F.col("day").alias(d)) for c, d in (("source", "a"), ("target", "b")))
    return edges.join(a, "source").join(b, ["shuffle", "target"]).groupBy("shuffle").agg(F.round(F.avg(F.abs(F.datediff("a", "b"))), 6).alias("mean"))


@query(f"""WITH RECURSIVE {T.knn_sql(5)}{T.paths_sql('knn')}, x AS (SELECT root, distance, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) AS x FROM geo JOIN events ON event_id = node WHERE root <> node),
    f AS (SELECT root, corr(distance, x) AS r FROM x GROUP BY root) SELECT root, round(r, 6) AS r FROM f WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY f.r DESC, root LIMIT 1""")
def best_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.vectors(spark, sf_dir)
    fits = A.date_fits(settled(G.knn_graph(nodes, 5), "knn"), nodes.select(F.col("id").alias("node")), T.dates(spark, sf_dir))
    return M.best_fit(fits).withColumn("r", F.round("r", 6))


@query("""WITH x AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS x, avg(value) FILTER (event_type = 'view') AS y FROM events GROUP BY user_id), d AS (SELECT round(y - x, 6) AS delta FROM x WHERE x IS NOT NULL AND y IS NOT NULL),
    s AS (SELECT delta, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2 AS r FROM d WHERE delta <> 0), t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM s GROUP BY abs(delta))),
    w AS (SELECT CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (delta > 0) AS DOUBLE) AS up, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w FROM s)
    SELECT (SELECT count(*) FROM d) AS n, round((SELECT quantile_cont(delta, 0.5) FROM d), 6) AS median, m, up, round((2 * up - m) / sqrt(m), 6) AS sign_z, w, round((w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 6) AS z FROM w, t""")
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    rows = T.table(spark, sf_dir, "events").groupBy("user_id").agg(of("click").alias("x"), of("view").alias("y")).select(F.lit(0.0).alias("x"), F.round(F.col("y") - F.col("x"), 6).alias("y"))
    return S.paired_summary(rows, "x", "y").withColumns({c: F.round(c, 6) for c in ("median", "sign_z", "z")})


@query("""WITH q AS (SELECT quantile_cont(l_discount, 0.25) AS a, quantile_cont(l_discount, 0.5) AS b, quantile_cont(l_discount, 0.75) AS c FROM lineitem WHERE l_discount > 0)
    SELECT CASE WHEN l_discount = 0 THEN 0 ELSE 1 + CAST(l_discount > a AS INTEGER) + CAST(l_discount > b AS INTEGER) + CAST(l_discount > c AS INTEGER) END AS stratum, count(*) AS n FROM lineitem, q GROUP BY 1""")
def quantile_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quantile_strata(T.table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("double").alias("x")), "x", 4).groupBy("stratum").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(count(*)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS n FROM events GROUP BY 1, 2), l AS (SELECT user_id, arg_max(n, day) AS last FROM c GROUP BY user_id)
    SELECT user_id, CAST(any_value(last) AS BIGINT) AS last, min(day) FILTER (n >= 0.95 * last) AS x_at FROM c JOIN l USING (user_id) GROUP BY user_id""")
def saturation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day by which a user has 95 % of its events."""
    daily = T.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    running = daily.select("user_id", "day", F.sum("c").over(Window.partitionBy("user_id").orderBy("day")).alias("n"))
    return S.saturation(running, "day", "n", "user_id")


@query()
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the nearest other event of the same user by value."""
    rows = T.table(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.col("event_type") == "click").alias("first"))
    return S.nearest_match(rows, "value", "first", "event_id", "user_id").withColumn("gap", F.round("gap", 6))


@query()
def exact_densest_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.exact_densest(G.knn_graph(T.vectors(spark, sf_dir), 5)).select("node")


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.bootstrap_means(T.table(spark, sf_dir, "events"), "value", "event_id", 50, "event_type")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query("""WITH s AS (SELECT c_custkey AS node, c_nationkey AS p FROM customer), e AS (SELECT least(node, 1000000 + p) AS source, greatest(node, 1000000 + p) AS target FROM s),
    d AS (SELECT n AS node, count(*) AS degree FROM (SELECT source AS n FROM e UNION ALL SELECT target FROM e) GROUP BY n), f AS (SELECT o_custkey AS node, min(o_orderdate) AS first FROM orders GROUP BY 1 UNION ALL SELECT 1000000 + c_nationkey, min(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT source AS leaf, target AS inner, CASE WHEN x.first < y.first THEN 'leaf first' WHEN x.first > y.first THEN 'inner first' ELSE 'together' END AS relation FROM e JOIN d a ON a.node = source AND a.degree = 1 JOIN d b ON b.node = target AND b.degree > 1 JOIN f x ON x.node = source JOIN f y ON y.node = target""")
def leaf_edge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers hang on their nation; whose first order was earlier."""
    customer, orders = T.table(spark, sf_dir, "customer"), T.table(spark, sf_dir, "orders")
    nation = (F.lit(1_000_000) + F.col("c_nationkey")).cast("bigint")
    edges = customer.select(F.col("c_custkey").alias("source"), nation.alias("target"), F.lit(1.0).alias("weight"))
    own = orders.groupBy(F.col("o_custkey").alias("node")).agg(F.min("o_orderdate").alias("first"))
    theirs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(nation.alias("node")).agg(F.min("o_orderdate").alias("first"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return M.leaf_edges(edges, own.unionByName(theirs), A.degrees(nodes, edges))
