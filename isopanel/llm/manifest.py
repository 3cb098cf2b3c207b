"""Merkle manifest of a table: a tree of digests for each language, and one over these.

Rows become leaves; those of a language stand in order of id, and runs of FAN consecutive nodes become their parents
until one node is left, the language's subroot. Subroots in order of language become the root the same way. On each
level lag and lead columns at the fixed offsets 1 to FAN - 1, masked by a node's slot in its run and by the run's
length, give its siblings, and the first node of each run hashes the run as its parent. A proof is the siblings of a
leaf and of all nodes above it; folding a leaf with its proof gives the root again if the row is what it was.

No language meets in one task: places come from a split by ranges of (language, id) whose counts are added up, and
windows are as small as a run. All levels above the leaves hold a seventh of their number; paths grow from the root
down by joins on the run, where the windows are too. It is all columns and windows, without Python.

Defined cases: a null field is hashed as `-`; a null language is the first one; a null id comes first in its language,
and is not tampered; rows with one id stand in order of their leaf, and equal rows are leaves each; a lone leaf is its
language's subroot, and a lone subroot is the root; an empty table has no root and gives no rows; further columns are
neither hashed nor kept.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, shared_dir, written

FAN = 8
#: Rows of a range when places are counted.
RANGE_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVEL = "struct<slot: int, siblings: string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-`, or the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(*(field(text if name == "text" else F.col(name)) for name in FIELDS))


def group_of(name: str) -> Column:
    """A value as a key that is never null and has the order of the value, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def is_tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


class Tree(NamedTuple):
    """levels[k] has (tree, place, size, node): a tree's nodes of that level, size of them; roots has (tree, node)."""

    levels: list[DataFrame]
    roots: DataFrame


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (tree, ...) with place, from 0 in each tree by `order`, and size: how many rows the tree has.

    Rows are split by ranges; a row's number within its part, and the sizes of the parts before it, give its place.
    """
    parts = max(1, -(-rows.count() // RANGE_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    columns = ["tree", *order]
    split = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *columns, "_row").sortWithinPartitions(*columns, "_row").drop("_row")
    # a row's number as Spark gives it: the part above bit 33, its place in the part below
    kept = written(split.withColumn("_at", F.monotonically_increasing_id()), f"{name}-placed")
    part = F.shiftright("_at", 33)
    spans = kept.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    every = Window.partitionBy("tree")  # a row for each part that the tree reaches into
    before = F.coalesce(F.sum("n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "_part", "_first", before.alias("_before"), F.sum("n").over(every).alias("size"))
    joined = kept.withColumn("_part", part).join(spans, ["tree", "_part"])
    return joined.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _neighbours(step: int, offset: int) -> Column:
    """The node at an offset within its run, else null: lag or lead, masked by the slot and the run's length."""
    slot, run = F.col("place") % FAN, Window.partitionBy("tree", "run").orderBy("place")
    length = F.least(F.lit(FAN), F.col("size") - F.col("run") * FAN)
    if step < 0:
        return F.when(slot >= offset, F.lag("node", offset).over(run))
    return F.when(slot + offset < length, F.lead("node", offset).over(run))


def _in_runs(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("run", F.floor(F.col("place") / FAN))


def _siblings() -> Column:
    """Digests of the run's other nodes, left to right."""
    return F.concat_ws("", *(_neighbours(-1, i) for i in range(FAN - 1, 0, -1)), *(_neighbours(1, i) for i in range(1, FAN)))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of trees that have more than one node: the first of each run hashes the run."""
    run = _in_runs(nodes.where("size > 1").select("tree", "place", "size", "node"))
    hashed = F.sha2(F.concat_ws("", "node", *(_neighbours(1, i) for i in range(1, FAN))), 256)
    marked = run.select("tree", "run", (F.col("place") % FAN).alias("slot"), F.ceil(F.col("size") / FAN).alias("size"), hashed.alias("parent"))
    return marked.where("slot = 0").select("tree", F.col("run").alias("place"), "size", F.col("parent").alias("node"))


def grown(leaves: DataFrame, name: str) -> Tree:
    """The tree over leaves (tree, place, size, node); each level is a table of its own."""
    levels = [leaves]
    largest = leaves.agg(F.max("size").alias("n")).first()["n"] or 0
    while largest > 1:
        levels.append(written(parents(levels[-1]), f"{name}-level"))
        largest = -(-largest // FAN)
    return Tree(levels, reduce(DataFrame.unionAll, [x.where("size = 1").select("tree", "node") for x in levels]))


def with_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The leaves with path, slots and siblings from the leaf's level up, going on with what `above` (tree, path, ...)
    has for its tree; further columns of `above` come along."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    found: DataFrame | None = None
    for level in reversed(tree.levels):
        known = level.where("size = 1").join(above, "tree")
        if found is not None:
            run = _in_runs(level.where("size > 1"))
            upper = found.select("tree", F.col("place").alias("run"), F.col("path").alias("_upper"), *more)
            own = F.struct((F.col("place") % FAN).cast("int").alias("slot"), F.col("siblings"))
            joined = run.join(upper, ["tree", "run"]).withColumn("siblings", _siblings())
            known = joined.withColumn("path", F.concat(F.array(own), "_upper")).select(*known.columns).unionAll(known)
        found = known
    assert found is not None
    return found


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    width = 64
    return F.aggregate(path, node, lambda a, x: digest(F.substring(x["siblings"], F.lit(1), x["slot"] * width), a, F.substring(x["siblings"], x["slot"] * width + 1, F.lit(FAN * width))))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered_leaf, subroot, root, path of each row."""
    plain = leaf(F.col("text"))
    changed = F.when(is_tampered(), leaf(F.translate("text", UPPER, LOWER))).otherwise(plain)
    rows = written(docs.select(group_of("lang").alias("tree"), "doc_id", plain.alias("node"), changed.alias("tampered_leaf")), "manifest-leaves")
    leaves = placed(rows, ["doc_id", "node"], "manifest")
    forget(rows)
    tree = grown(leaves, "manifest")
    groups = tree.roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node")
    top = grown(placed(groups, ["group"], "manifest-roots"), "manifest-roots")
    root = top.roots.first()
    start = top.roots.select("tree", F.array().cast(f"array<{_LEVEL}>").alias("path"))
    # a row for each language, which every level of the leaves' tree asks for
    above = written(with_paths(top, start).select(F.col("group").alias("tree"), F.col("node").alias("subroot"), "path"), "manifest-subroots")
    rooted = F.lit(root["node"] if root else None).cast("string")
    return with_paths(tree, above).select("doc_id", F.col("node").alias("leaf"), "tampered_leaf", "subroot", rooted.alias("root"), "path")


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: x["siblings"]), ""), 256)


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: rows as they might come back are held against the manifest."""
    again = folded(F.col("tampered_leaf"), F.col("path"))
    rows = manifest(docs).select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def write_manifest(docs: DataFrame, path: str | None = None) -> str:
    """The manifest as a Parquet table (path of a proof as slots and siblings); returns where it is."""
    where = path or shared_dir(docs.sparkSession, "manifest")
    manifest(docs).drop("tampered_leaf").write.parquet(where)
    return where
