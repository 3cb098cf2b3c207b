"""Queries of NumPy files, of row positions and of batches by size over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import accession
from ..operators import graphs as G
from ..operators import positions as P
from ..sources import arrays, delimited, fasta, tree_files
from ..storage import shared_dir
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id AS id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last,
    round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""")
def npy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and their ids written as two .npy arrays in order of id, read back in partitions and put together by row."""
    ordered = T.vectors(spark, sf_dir).repartitionByRange(4, "id").sortWithinPartitions("id")
    path = shared_dir(spark, "npy")
    arrays.write_npy(ordered, f"{path}/vectors", file_bytes=1 << 20)
    arrays.write_npy(ordered.select(F.array("id").alias("v")), f"{path}/ids", dtype="<i8")
    vectors = arrays.read_npy(spark, f"{path}/vectors", split_bytes=1 << 16)
    ids = arrays.read_npy(spark, f"{path}/ids").select("row", F.get("v", F.lit(0)).cast("bigint").alias("id"))
    total = F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6)
    return ids.join(vectors, "row").select("row", "id", F.size("v").cast("bigint").alias("n"), F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"), total.alias("total"))


@query(f"WITH {T.knn_sql(5)} SELECT source, target, CAST(weight AS DOUBLE) AS weight FROM knn")
def sparse_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5-nearest graph written as a symmetric CSR matrix and read back along indptr, checked for symmetry."""
    edges = G.knn_graph(T.vectors(spark, sf_dir), 5)
    size = T.table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"]
    path = shared_dir(spark, "csr")
    arrays.write_csr(arrays.adjacency(edges), path, (size or 0) + 1, 4)
    return arrays.edges_of_adjacency(arrays.read_csr(spark, path, split_bytes=1 << 14))


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders)
    SELECT row, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'unnamed' || o_orderkey ELSE 'EPI_ISL_' || o_orderkey END AS accession FROM o""")
def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id list in which a third of the accessions is lost, filled from the headers of a FASTA file in the same order.

    Both are files of several parts and blocks; accessions that no metadata knows stay as they are.
    """
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey")
    name = F.concat(F.lit("EPI_ISL_"), "o_orderkey")
    path = shared_dir(spark, "positions")
    listed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("unnamed"), "o_orderkey")).otherwise(F.concat(F.lit("B.1|2021-01-01|"), name))
    orders.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey").select(listed.alias("value")).write.text(f"{path}/ids")
    fasta.write_fasta(orders.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.concat(F.lit("hCoV|"), name, F.lit(" c.5G>A")).alias("header"), F.lit("ACGT").alias("seq")), f"{path}/fasta")
    ids = P.file_rows(spark.read.text(f"{path}/ids").where(F.trim("value") != ""), delimited.id_parts(F.col("value"))["accession"].alias("accession"))
    headers = P.file_rows(fasta.records(spark, f"{path}/fasta"), accession(fasta.header()).alias("accession"))
    known = orders.where("o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0").select(name.alias("accession"))
    return P.filled_by_position(ids, headers, known).rows


@query("""WITH RECURSIVE c AS (SELECT doc_id, n_chars + 2 AS cost, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS row FROM documents),
    b AS (SELECT doc_id, row, cost AS used, CAST(0 AS BIGINT) AS batch FROM c WHERE row = 1 UNION ALL
        SELECT c.doc_id, c.row, CASE WHEN used + cost > 30000 THEN cost ELSE used + cost END, CASE WHEN used + cost > 30000 THEN batch + 1 ELSE batch END FROM b JOIN c ON c.row = b.row + 1)
    SELECT doc_id, batch FROM b""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of 30,000 characters, longest first."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return P.token_batches(docs, "n_chars", "doc_id", 30_000).select("doc_id", "batch")


@query("""WITH c AS (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey),
    e AS (SELECT CAST(NULL AS INTEGER) AS r, CAST(NULL AS INTEGER) AS n, CAST(NULL AS BIGINT) AS c, NULL AS branch, '' AS name UNION ALL SELECT DISTINCT r, NULL, NULL, 2.0, 'r' || r FROM c
        UNION ALL SELECT DISTINCT r, n, NULL, 0.5, 'nation, ' || n FROM c UNION ALL SELECT r, n, c, c % 100 / 4, 'c' || c FROM c),
    p AS (SELECT *, row_number() OVER (ORDER BY r NULLS FIRST, n NULLS FIRST, c NULLS FIRST) - 1 AS node FROM e)
    SELECT p.node, CASE WHEN p.c IS NOT NULL THEN a.node WHEN p.n IS NOT NULL THEN b.node WHEN p.r IS NOT NULL THEN 0 ELSE -1 END AS parent, CAST(p.branch AS DOUBLE) AS branch, p.name
    FROM p LEFT JOIN p a ON a.n = p.n AND a.c IS NULL LEFT JOIN p b ON b.r = p.r AND b.n IS NULL""")
def large_newick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below their nations and regions as one Newick tree in files of several blocks, read by many tasks."""
    nations = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n")).join(nations, "n")
    ends = rows.groupBy("r", "n").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    # a row for each nation
    region, every = Window.partitionBy("r"), Window.partitionBy()
    ends = ends.withColumns({"n0": F.min("n").over(region), "n1": F.max("n").over(region), "r0": F.min("r").over(every), "r1": F.max("r").over(every)})
    both = rows.join(ends, ["r", "n"])
    opens, closes = F.col("c") == F.col("first"), F.col("c") == F.col("last")
    after = F.concat(F.lit(")'nation, "), F.col("n").cast("string"), F.lit("':0.5"))
    token = F.concat(
        F.when(opens & (F.col("n") == F.col("n0")) & (F.col("r") == F.col("r0")), "(").otherwise(""), F.when(opens & (F.col("n") == F.col("n0")), "(").otherwise(""), F.when(opens, "(").otherwise(""),
        F.lit("c"), F.col("c").cast("string"), F.lit(":"), (F.col("c") % 100 / 4).cast("string"), F.lit("[&d="), (F.col("c") % 7).cast("string"), F.lit("]"),
        F.when(closes, after).otherwise(""), F.when(closes & (F.col("n") == F.col("n1")), F.concat(F.lit(")r"), F.col("r").cast("string"), F.lit(":2"))).otherwise(""),
        F.when(closes & (F.col("n") == F.col("n1")) & (F.col("r") == F.col("r1")), ");").otherwise(""),
    )
    path = shared_dir(spark, "newick")
    both.select("r", "n", "c", token.alias("value")).repartitionByRange(4, "r", "n", "c").sortWithinPartitions("r", "n", "c").select("value").write.option("lineSep", ",").text(path)
    return tree_files.read_large_newick(spark, path).fillna(-1, ["parent"])
