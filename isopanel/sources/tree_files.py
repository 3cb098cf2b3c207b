"""Trees of any size from Newick text, and trees of Nexus files.

A Newick text of any length is read in pieces between commas, by as many tasks as the file has blocks. What a parser
keeps on a stack are sums here: the depth of a piece is how many brackets opened and did not close before it, a node's
number is how many brackets and commas came before, and the parent of a node is the last node before it that is less
deep by one. Each of these is a running sum or maximum over ranges of pieces; no task reads the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.positions import file_rows
from ..operators.sampling import running
from ..storage import settled
from .fasta import parse_newick

_QUOTED = r"(?=(?:[^']*'[^']*')*[^']*$)"


def _times(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letter, ""))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(row, text) between the commas of a tree: those within quotes or comments are put together again."""
    pieces = file_rows(spark.read.option("lineSep", ",").text(path), F.col("value"))
    counted = pieces.withColumns({"quotes": _times(F.col("value"), "'"), "comments": _times(F.col("value"), "[") - _times(F.col("value"), "]"), "one": F.lit(1)})
    summed = running(counted, "row", "quotes", "comments")
    cut = summed.withColumn("ends", ((F.col("run_quotes") % 2 == 0) & (F.col("run_comments") <= 0)).cast("int"))
    # a piece belongs to the token after all commas before it
    numbered = running(cut.select("row", "value", "ends"), "row", "ends").withColumn("token", F.col("run_ends") - F.col("ends"))
    parts = F.array_sort(F.collect_list(F.struct("row", "value")))  # of one label or comment
    return numbered.groupBy("token").agg(F.array_join(F.transform(parts, lambda p: p["value"]), ",").alias("text")).select(F.col("token").alias("row"), "text")


def _label(part: Column) -> Column:
    quoted = F.regexp_extract(part, r"^\s*'([^']*)'", 1)
    return F.when(part.rlike(r"^\s*'"), quoted).otherwise(F.regexp_extract(part, r"^\s*([^:;\s]*)", 1))


def _branch(part: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(part, r"'[^']*'", ""), r":\s*([^;\s]+)", 1).try_cast("double")


def read_large_newick(spark: SparkSession, path: str) -> DataFrame:
    """(node, parent, branch, name) of the one tree in a file, as read_newick gives them, by tasks that each read a part."""
    plain = F.regexp_replace("text", r"\[[^\]]*\]", "")
    opened = F.length(F.translate(F.regexp_extract(plain, r"^[\s(]*", 0), " \t\r\n", ""))
    # the label after the brackets that open, then one for each that closes
    parts = F.split(F.regexp_replace(F.regexp_replace(plain, r"^[\s(]*", ""), f";{_QUOTED}[\\s\\S]*$", ""), rf"\){_QUOTED}", -1)
    tokens = _tokens(spark, path).select("row", opened.cast("bigint").alias("opens"), parts.alias("parts")).withColumn("net", F.col("opens") - F.size("parts") + 1)
    runs = settled(running(tokens, "row", "opens", "net"), "tree-tokens")
    depth, first = F.col("run_net") - F.col("net"), F.col("row") + F.col("run_opens") - F.col("opens")
    # a token's nodes: that of its comma (or the root), and one for each bracket that opens; all but the first have the one before as parent
    made = runs.select("row", "parts", "opens", depth.alias("depth"), first.alias("first"))
    nodes = made.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "opens")).alias("k"), "first", "depth", "opens", "parts")
    nodes = nodes.select((F.col("first") + F.col("k")).alias("node"), (F.col("depth") + F.col("k")).alias("depth"), F.when(F.col("k") > 0, F.col("first") + F.col("k") - 1).alias("known"), F.when(F.col("k") == F.col("opens"), F.col("parts")[0]).alias("text"))
    leaf = (F.col("first") + F.col("opens")).alias("at")
    closed = made.select(leaf, F.posexplode("parts").alias("k", "text"), (F.col("depth") + F.col("opens")).alias("deep")).where("k > 0")
    # questions for the last node of a depth: parents of the nodes of commas, and the nodes that closing brackets name
    asked = nodes.where("known IS NULL AND node > 0").select("node", F.lit(None).cast("string").alias("text"), F.col("node").alias("at"), (F.col("depth") - 1).alias("depth"))
    asked = asked.unionAll(closed.select(F.lit(None).cast("bigint").alias("node"), "text", "at", (F.col("deep") - F.col("k")).alias("depth")))
    answered = settled(_last_of_depth(nodes.select("node", "depth"), asked), "tree-answers")
    parents = answered.where("node IS NOT NULL").select("node", F.col("last").alias("parent"))
    texts = answered.where("node IS NULL").select(F.col("last").alias("node"), F.col("text").alias("closing"))
    found = nodes.join(parents, "node", "left").join(texts, "node", "left").withColumn("own", F.coalesce("closing", "text", F.lit("")))
    return found.select("node", F.coalesce("known", "parent").alias("parent"), _branch(F.col("own")).alias("branch"), _label(F.col("own")).alias("name"))


def _last_of_depth(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (node, text, at, depth) with last: the largest node of that depth up to `at`."""
    events = nodes.select(F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("string").alias("text"), F.col("node").alias("at"), "depth", F.col("node").alias("is"))
    both = events.unionAll(asked.withColumn("is", F.lit(None).cast("bigint")))
    parted = settled(both.repartitionByRange("at").withColumn("_p", F.spark_partition_id()), "tree-events")
    most = parted.groupBy("depth", "_p").agg(F.max("is").alias("_m"))  # a row for each depth in each range
    before = most.select("depth", "_p", F.max("_m").over(Window.partitionBy("depth").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    here = Window.partitionBy("_p", "depth").orderBy("at", F.col("is").isNull())
    joined = parted.join(before, ["depth", "_p"]).withColumn("last", F.greatest(F.max("is").over(here.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before")))
    return joined.where("is IS NULL").select("node", "text", "last")


def read_nexus(spark: SparkSession, path: str) -> DataFrame:
    """(file, tree, node, parent, branch, name) of the trees in Nexus files; names go through the file's translate table.

    Statements, which end with a semicolon, are read by different tasks; a tree is one statement and parsed by one.
    """
    statements = spark.read.option("lineSep", ";").text(path).select(F.col("_metadata.file_path").alias("file"), F.trim(F.regexp_replace("value", r"^\s+", "")).alias("text"))
    tree = r"(?is)^u?tree\s+\*?\s*([^\s=]+)\s*=\s*(.*)$"
    trees = statements.where(F.col("text").rlike(tree)).select("file", F.regexp_extract("text", tree, 1).alias("tree"), F.regexp_extract("text", tree, 2).alias("newick"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "tree", "node", "parent", "branch", "name"]
        for batch in batches:
            for row in batch.to_pylist():
                columns = list(zip(*parse_newick(row["newick"]), strict=True))
                arrays = [pa.array([row[c]] * len(columns[0]), pa.string()) for c in ("file", "tree")]
                arrays += [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    nodes = trees.mapInArrow(parsed, "file string, tree string, node bigint, parent bigint, branch double, name string")
    table = statements.where(F.col("text").rlike(r"(?i)^translate\s")).select("file", F.explode(F.split(F.regexp_replace("text", r"(?i)^translate\s+", ""), rf",{_QUOTED}")).alias("pair"))
    pairs = table.select("file", F.regexp_extract("pair", r"^\s*(\S+)\s+([\s\S]+?)\s*$", 1).alias("name"), F.regexp_replace(F.regexp_extract("pair", r"^\s*(\S+)\s+([\s\S]+?)\s*$", 2), r"^'|'$", "").alias("long"))
    return nodes.join(pairs, ["file", "name"], "left").select("file", "tree", "node", "parent", "branch", F.coalesce("long", "name").alias("name"))
