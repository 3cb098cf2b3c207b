"""Queries of files, metadata filters and keys over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metadata as M
from ..operators import pairs as P
from ..sources import delimited
from ..storage import shared_dir
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders WHERE o_orderstatus <> 'O'")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as gz CSV and read back, three of the columns."""
    orders = T.table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey").cast("bigint"))
    path = shared_dir(spark, "orders.csv")
    delimited.write_delimited(orders, f"{path}.gz", gz=True)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema)
    found = delimited.read_delimited(spark, delimited.plain_or_gz(spark, path), schema, ["o_orderkey", "o_orderstatus", "o_custkey"])
    return found.where("o_orderstatus <> 'O'")


#: Orders as records of sequences: keys as accessions, nations as places.
RECORDS = """records AS (SELECT 'EPI_ISL_' || (o_orderkey // 2) AS accession, CASE WHEN n_regionkey = 1 THEN 'America / usa / ' ELSE 'Elsewhere / ' END || n_name AS location, o_orderstatus <> 'P' AS complete, o_totalprice > 20000 AS high_coverage,
    CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 13 = 0 THEN 'Unassigned' ELSE o_orderpriority END AS lineage
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (T.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.when(F.col("o_orderkey") % 11 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format(F.add_months("o_orderdate", 300), "yyyy-MM-dd"))
    return rows.select(
        F.concat(F.lit("EPI_ISL_"), F.floor(F.col("o_orderkey") / 2)).alias("accession"),
        F.concat(F.when(F.col("n_regionkey") == 1, "America / usa / ").otherwise("Elsewhere / "), "n_name").alias("location"),
        (F.col("o_orderstatus") != "P").alias("complete"),
        (F.col("o_totalprice") > 20000).alias("high_coverage"),
        day.alias("day"),
        F.when(F.col("o_orderkey") % 13 == 0, "Unassigned").otherwise(F.col("o_orderpriority")).alias("lineage"),
    )


@query(f"""WITH {RECORDS}, fine AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY day, lineage) AS n FROM records WHERE location ILIKE '%USA%' AND complete AND high_coverage AND regexp_full_match(day, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
    AND day BETWEEN '2019-01-01' AND '2024-12-31' AND lineage <> 'Unassigned' AND accession IN (SELECT 'EPI_ISL_' || l_orderkey FROM lineitem))
    SELECT accession, location, complete, high_coverage, day, lineage FROM fine WHERE n = 1""")
def usable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as TSV, read back and filtered; lines of orders stand for sequences."""
    path = shared_dir(spark, "records")
    delimited.write_delimited(_records(spark, sf_dir), path, "\t")
    found = delimited.read_delimited(spark, path, "accession string, location string, complete boolean, high_coverage boolean, day string, lineage string", sep="\t")
    sequences = T.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("EPI_ISL_"), "l_orderkey").alias("accession"))
    return M.usable_records(found, sequences)


@query("SELECT o_orderpriority AS lineage, strftime(o_orderdate, '%Y-%m-%d') AS day, 'K' || o_orderkey AS accession FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT '', '', 'K' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of an id list, some with the accession alone."""
    key = F.concat(F.lit("K"), "o_orderkey")
    line = F.when(F.col("o_orderkey") % 5 == 0, key).otherwise(F.concat_ws("|", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), key))
    path = shared_dir(spark, "ids")
    T.table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return delimited.read_ids(spark, path)


@query("SELECT CAST(user_id % 4 AS INTEGER) AS seed, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def seeds_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV by seed, and all seeds read as one table."""
    path = shared_dir(spark, "seeds")
    events = T.table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 4).cast("int").alias("seed"))
    events.write.partitionBy("seed").options(header=True).csv(path)
    found = delimited.read_seeds(spark, f"{path}/seed=*", "event_type string, value double")
    return found.groupBy("seed", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


HEADERS = """h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x|EPI_ISL_' || doc_id || '|' || source || ' of ' || lang WHEN 1 THEN 'NC_' || doc_id || ' | ' || source WHEN 2 THEN 'hCoV|MT' || doc_id || '|d ' || lang ELSE 'Spike|hCoV-19/' || lang || ' / ' || doc_id || '/2021|' || source END AS h FROM documents)"""


@query(f"""WITH {HEADERS}, t AS (SELECT doc_id, h, regexp_split_to_array(trim(h), '\\s+')[1] AS token FROM h)
    SELECT doc_id, CASE WHEN regexp_matches(h, 'EPI_ISL_[0-9]+') THEN regexp_extract(h, 'EPI_ISL_[0-9]+') ELSE token END AS by_accession, coalesce(TRY_CAST(regexp_extract(h, 'EPI_ISL_([0-9]+)', 1) AS BIGINT), -1) AS by_number, token AS by_token,
    trim(string_split(trim(h), '|')[-1]) AS by_last, coalesce(list_filter(string_split(token, '|'), lambda p: regexp_matches(p, '^(NC_|EPI_ISL_|OP|ON|OM|MZ|MW|MT)'))[1], token) AS by_archive,
    regexp_replace(regexp_replace(CASE WHEN contains(h, 'Spike|') THEN regexp_extract(h, 'Spike\\|([^|]*)', 1) ELSE h END, '\\s', '', 'g'), '/[0-9]{{4}}$', '') AS virus FROM t""")
def header_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of headers by each rule."""
    d, source, lang = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    kinds = [F.concat(F.lit("x|EPI_ISL_"), d, F.lit("|"), source, F.lit(" of "), lang), F.concat(F.lit("NC_"), d, F.lit(" | "), source), F.concat(F.lit("hCoV|MT"), d, F.lit("|d "), lang), F.concat(F.lit("Spike|hCoV-19/"), lang, F.lit(" / "), d, F.lit("/2021|"), source)]
    h = F.get(F.array(*kinds), (F.col("doc_id") % 4).cast("int"))
    rules = [scalars.header_id(h, rule).alias(f"by_{rule}") for rule in ("accession", "token", "last", "archive")]
    number = F.coalesce(scalars.header_id(h, "number"), F.lit(-1)).alias("by_number")
    return T.table(spark, sf_dir, "documents").select("doc_id", *rules, number, scalars.virus_name_key(h).alias("virus"))


@query("SELECT p_partkey, p_brand FROM part WHERE lower(trim(p_brand)) = 'brand#11' OR p_partkey IN (1, 7, 19)")
def labelled_or_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").cast("string").alias("key"))
    return M.labelled_or_included(parts, "p_brand", "BRAND#11", "key", ["1", "7", "19"]).drop("key")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return M.many_to_one(lines, orders, ["l_orderkey"])


@query("SELECT doc_id AS accession, min(length(text)) AS position FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT vec_id FROM embeddings) AND text IS NOT NULL GROUP BY doc_id")
def shared_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("accession"), F.length("text").cast("bigint").alias("position"))
    others = (T.table(spark, sf_dir, t).select(F.col(c).alias("accession")) for t, c in (("labels", "doc_id"), ("embeddings", "vec_id")))
    return M.in_order(docs, *others)


@query("SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS representative FROM documents")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.represented(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "representative")


@query("SELECT DISTINCT p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM part")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_codes(T.table(spark, sf_dir, "part"), "p_type")


@query("""WITH x AS (SELECT event_type, value AS v, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS DOUBLE) AS day FROM events WHERE value IS NOT NULL),
    r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2 AS a, rank() OVER (PARTITION BY event_type ORDER BY day) + (count(*) OVER (PARTITION BY event_type, day) - 1) / 2 AS b FROM x)
    SELECT event_type, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN corr(a, b) END, 6) AS rho FROM r GROUP BY event_type""")
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do values of a type of event grow with time?"""
    events = T.table(spark, sf_dir, "events").select("event_type", "value", F.datediff("ts", F.lit("2020-01-01").cast("date")).cast("double").alias("day"))
    return M.grouped_spearman(events, "event_type", "value", "day").withColumn("rho", F.round("rho", 6))


@query("""WITH x AS (SELECT o_orderpriority, unnest([{'metric': 'price', 'x': CAST(o_totalprice AS DOUBLE)}, {'metric': 'customer', 'x': CAST(o_custkey AS DOUBLE)}, {'metric': 'month', 'x': CAST(month(o_orderdate) AS DOUBLE)}]) AS m FROM orders)
    SELECT o_orderpriority, m.metric AS metric, count(*) AS n, round(avg(m.x), 4) AS mean, round(stddev_samp(m.x), 4) AS sd, min(m.x) AS least, round(quantile_cont(m.x, 0.25), 4) AS q1, round(quantile_cont(m.x, 0.5), 4) AS median, round(quantile_cont(m.x, 0.75), 4) AS q3, max(m.x) AS most FROM x GROUP BY 1, 2""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), F.month("o_orderdate").alias("month"))
    return M.metric_summary(orders, "o_orderpriority", "price", "customer", "month").withColumns({c: F.round(c, 4) for c in ("mean", "sd", "q1", "median", "q3")})


@query("""WITH x AS (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS pc FROM embeddings)
    SELECT CAST(pc AS INTEGER) AS pc, count(*) AS n, round(quantile_cont(CAST(x AS DOUBLE), 0.25), 5) AS q1, round(quantile_cont(CAST(x AS DOUBLE), 0.5), 5) AS median, round(quantile_cont(CAST(x AS DOUBLE), 0.75), 5) AS q3 FROM x GROUP BY 1""")
def spectrum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of each component over all vectors."""
    x = T.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pc", "x"))
    found = M.metric_summary(x.withColumn("x", F.col("x").cast("double")), "pc", "x")
    return found.select("pc", "n", *(F.round(c, 5).alias(c) for c in ("q1", "median", "q3")))


@query("""WITH t AS (SELECT source, md5(coalesce(text, '')) AS c, count(*) AS times FROM documents GROUP BY 1, 2)
    SELECT source, CAST(sum(times) AS BIGINT) AS n, count(*) AS n_distinct, CAST(sum(CASE WHEN times > 1 THEN times ELSE 0 END) AS BIGINT) AS n_repeated, quantile_cont(CAST(times AS DOUBLE), 0.5) AS median_multiplicity, max(times) AS most FROM t GROUP BY source""")
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select("source", F.md5(F.coalesce("text", F.lit(""))).alias("c"))
    return M.duplicate_audit(docs, "source", "c")


@query(f"""WITH {T.PAIRS}, y AS (SELECT event_id AS node, year(ts) + (dayofyear(ts) - 1) / (CASE WHEN (year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 THEN 366 ELSE 365 END) AS y FROM events),
    p AS (SELECT round(CAST(d AS DOUBLE), 3) AS d, round(abs(a.y - b.y), 6) AS t FROM pairs JOIN y a ON a.node = i JOIN y b ON b.node = j),
    r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS x, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS y FROM p) SELECT count(*) AS n, round(corr(x, y), 5) AS rho FROM r""")
def time_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far distances follow years between dates."""
    years = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("node"), scalars.decimal_year(F.to_date("ts")).alias("y"))
    dated = T.vectors(spark, sf_dir).join(years.select(F.col("node").alias("id"), F.col("y").alias("t")), "id")
    return P.spearman(P.Pairs(dated, {"d": "cityblock"}, {"t": 6}), "d", "t").withColumn("rho", F.round("rho", 5))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 1000 + l_linenumber AS BIGINT) AS edge, len(list_distinct(flatten([range(l_linenumber, l_linenumber + 3), [l_linenumber + 7]]))) AS n_seeds,
    CASE l_linenumber % 5 WHEN 0 THEN 'MST' WHEN 1 THEN 'RNG' WHEN 2 THEN 'kNN' WHEN 3 THEN 'tau' ELSE 'a_other' END AS family FROM lineitem""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge keys, seed lists and graph families."""
    n = F.col("l_linenumber")
    seeds = scalars.seed_list(F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit(", "), (n + 7).cast("string")))
    name = F.get(F.array(*map(F.lit, ("a_mst", "b_RNG", "c_knn10", "d_tau0.5", "a_other"))), (n % 5).cast("int"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", n, scalars.edge_key(F.col("l_orderkey"), n, F.lit(1000)).cast("bigint").alias("edge"), F.size(seeds).cast("bigint").alias("n_seeds"), scalars.graph_family(name).alias("family"))


_ORDER = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-00-00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-00') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END"
_LINEAGE = "list_extract(['B.1.1.7', 'Q.4', 'BA.2.86.1', 'BA.2.75', 'JN.1.4', 'XBB.1.5', 'B.1.1', 'KP.3'], CAST(o_orderkey % 8 + 1 AS INTEGER))"


@query(f"""WITH o AS (SELECT *, {_ORDER} AS text, {_LINEAGE} AS lineage FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-06-15') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-15') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
        CASE WHEN lineage LIKE 'B.1.1.7%' OR lineage LIKE 'Q.%' THEN 'Alpha' WHEN lineage LIKE 'BA.2.86%' THEN 'BA.2.86' WHEN lineage LIKE 'BA.2%' THEN 'BA.2' WHEN lineage LIKE 'JN.1%' OR lineage LIKE 'KP.%' THEN 'JN.1' WHEN lineage LIKE 'XBB%' THEN 'XBB' ELSE 'Other' END AS bucket,
        CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'soon' ELSE o_orderpriority END AS label, CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE format('{{:,.2f}}', o_totalprice) END AS price,
        xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(lineage || '|' || o_orderkey, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS seed FROM o""")
def record_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in part, lineage buckets, new names of labels, numbers as text and seeds, of orders."""
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.when(key % 4 == 0, F.date_format(date, "yyyy-00-00")).when(key % 4 == 1, F.date_format(date, "yyyy-MM-00")).when(key % 4 == 2, F.date_format(date, "yyyy-MM-dd")).otherwise("unknown")
    lineage = F.element_at(F.array(*map(F.lit, ("B.1.1.7", "Q.4", "BA.2.86.1", "BA.2.75", "JN.1.4", "XBB.1.5", "B.1.1", "KP.3"))), (key % 8 + 1).cast("int"))
    columns = {
        "day": scalars.repaired_date(text).cast("string"),
        "bucket": scalars.prefix_bucket(lineage, scalars.LINEAGES),
        "label": scalars.regrouped(F.col("o_orderpriority"), {"soon": ["1-URGENT", "2-HIGH"]}),
        "price": scalars.ratio_text(F.when(key % 11 != 0, F.col("o_totalprice"))),
        "seed": M.stable_seed(lineage, key.cast("string")),
    }
    return T.table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in columns.items()))


@query("""WITH p AS (SELECT p_partkey, p_brand || '-' || replace(p_name, ' ', repeat('-', CAST(p_size % 4 AS INTEGER))) || '.' || p_type || CASE WHEN p_size % 2 = 0 THEN '--' ELSE '**' END AS s FROM part),
    g AS (SELECT p_partkey, s, list_filter(range(1, length(s) + 1), lambda i: s[i] = '-' AND (i = 1 OR s[i - 1] <> '-')) AS a, list_filter(range(1, length(s) + 1), lambda i: s[i] = '-' AND (i = length(s) OR s[i + 1] <> '-')) AS z FROM p)
    SELECT p_partkey, rtrim(translate(translate(upper(s), '-.', ''), 'UZOB', 'XXXX'), '*') AS clean, length(replace(s, '-', '')) AS ungapped, length(s) - length(translate(s, 'XBZJ', '')) AS ambiguous,
        array_to_string(list_transform(list_zip(a, z), lambda x: CASE WHEN x[1] = x[2] THEN CAST(x[1] AS VARCHAR) ELSE x[1] || '-' || x[2] END), ';') AS gaps FROM g""")
def sequence_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean sequences, lengths and runs of gaps, of names of parts as aligned sequences."""
    size = F.col("p_size")
    gap = F.expr("repeat('-', p_size % 4)")
    text = F.concat("p_brand", F.lit("-"), F.replace("p_name", F.lit(" "), gap), F.lit("."), "p_type", F.when(size % 2 == 0, "--").otherwise("**"))
    parts = T.table(spark, sf_dir, "part").select("p_partkey", text.alias("s"))
    s = F.col("s")
    return parts.select("p_partkey", scalars.clean_sequence(s).alias("clean"), scalars.ungapped_length(s).cast("bigint").alias("ungapped"), scalars.ambiguous_count(s).cast("bigint").alias("ambiguous"), scalars.gap_ranges(s).alias("gaps"))
