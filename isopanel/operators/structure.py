"""Structural audits of a graph: dense parts by whole batches, its stages, duplicates by degree, records behind hubs."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from .analytics import core, degrees, density, density_of, without_leaves
from .graphs import half_edges, induced
from .within import Within


class Dense(NamedTuple):
    #: (round, n_nodes, n_edges, edges_per_node): what each round began with.
    trace: DataFrame
    #: (node) of the first round with the most edges per node.
    nodes: DataFrame


def densest_by_batches(edges: DataFrame, slack: int = 10) -> Dense:
    """A dense part of a graph of any size: its edges per node are at least a share of 1 / (2 + 2 * slack / 100) of the most
    that any part has.

    Each round takes away all nodes whose degree is at most 1 + slack / 100 times the mean degree, which leaves less than
    a share of 1 / (1 + slack / 100) of the nodes; so there are few rounds, and the driver has a row for each. Compared are
    whole numbers. Nodes that are left without edges go with the rest. `peel` takes one node after the other, in one task.

    Loops and repeated edges are left out; without edges there is no round and no node.
    """
    left = settled(edges.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct(), "batches")
    rows: list[tuple[int, int, int, float]] = []
    best: DataFrame | None = None
    while True:
        of = settled(half_edges(left.withColumn("weight", F.lit(1))).groupBy("node").agg(F.count("*").alias("degree")), "batch-degrees")
        now = of.agg(F.count("*").alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("d")).first()
        n, m = now["n"], now["d"] // 2
        if best is None or m * top[0] > top[1] * n:
            best, top = of.select("node"), (n, m)
        if not n:
            break
        rows.append((len(rows), n, m, m / n))
        left = settled(induced(left, of.where(F.col("degree") * (100 * n) > (100 + slack) * 2 * m)), "batches")
    trace = edges.sparkSession.createDataFrame(rows, "round bigint, n_nodes bigint, n_edges bigint, edges_per_node double")
    return Dense(trace, best)


def batches_within(graph: Within, of: DataFrame, slack: int = 10) -> tuple[list[tuple[int, int, int, float]], DataFrame]:
    """densest_by_batches() of a graph without a table of edges, from its degrees (node, degree): the trace's rows, and
    (node, degree) of the dense part. A round counts anew among the nodes that stay."""
    rows: list[tuple[int, int, int, float]] = []
    best, left = of.where("degree > 0"), of.where("degree > 0")
    top = (0, 0)
    while True:
        now = left.agg(F.count("*").alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("d")).first()
        n, m = now["n"], now["d"] // 2
        if not rows or m * top[0] > top[1] * n:
            best, top = left, (n, m)
        if not n:
            return rows, best
        rows.append((len(rows), n, m, m / n))
        graph = graph.among(left.where(F.col("degree") * (100 * n) > (100 + slack) * 2 * m))
        left = settled(graph.degrees().where("degree > 0"), "batch-degrees")


def stages_within(graph: Within, slack: int = 10) -> DataFrame:
    """stages() of a graph without a table of edges."""
    of = settled(graph.degrees(), "stage-degrees")
    bare = graph.without(of, settled(of.where("degree = 1").select("node"), "leaves"))
    parts = {"original_graph": of, "one_round_degree_1_removed": bare, "recursive_2_core": graph.peeled(of), "densest_by_batches": batches_within(graph, of, slack)[1]}
    return reduce(DataFrame.unionByName, [density_of(part).select(F.lit(name).alias("stage"), "*") for name, part in parts.items()])


def stages(nodes: DataFrame, edges: DataFrame, slack: int = 10) -> DataFrame:
    """(stage, n, m, edges_per_node, mean_degree, ...) of the whole graph, without its leaves, its 2-core and its dense part.

    A stage that nothing is left of has n = 0 and nulls.
    """
    parts = {"original_graph": nodes.select("node"), "one_round_degree_1_removed": without_leaves(nodes, edges), "recursive_2_core": core(nodes, edges), "densest_by_batches": densest_by_batches(edges, slack).nodes}
    settled_parts = {name: settled(part, "stage") for name, part in parts.items()}
    rows = [density(part, induced(edges, part)).select(F.lit(name).alias("stage"), "*") for name, part in settled_parts.items()]
    return reduce(DataFrame.unionByName, rows)


def multiplicity_by_degree(degree: DataFrame, records: DataFrame) -> DataFrame:
    """(node_group, n_nodes, n_records, mean, median, n_repeated, share_repeated, most): how many records (node) stand behind
    nodes of a degree, for degree_1, degree_2, degree_ge_2, all_nodes and every single degree (named =d).

    Counted by (degree, multiplicity) first, so a group's median needs a row for each number only. Nodes without records
    have multiplicity 0; records of other nodes are not counted.
    """
    times = records.groupBy("node").agg(F.count("*").alias("times"))
    counted = degree.join(times, "node", "left").groupBy("degree", F.coalesce("times", F.lit(0)).alias("times")).agg(F.count("*").alias("k"))
    d = F.col("degree")
    names = F.array(F.lit("all_nodes"), F.concat(F.lit("="), d.cast("string")), F.when(d == 1, "degree_1"), F.when(d == 2, "degree_2"), F.when(d >= 2, "degree_ge_2"))
    named = counted.select(F.explode(F.array_compact(names)).alias("node_group"), "times", "k").groupBy("node_group", "times").agg(F.sum("k").alias("k"))
    n, of = F.sum("k"), F.sum(F.col("times") * F.col("k"))
    repeated = F.sum(F.when(F.col("times") > 1, F.col("k")).otherwise(0))
    return named.groupBy("node_group").agg(n.alias("n_nodes"), of.alias("n_records"), (of / n).alias("mean"), F.percentile("times", F.lit(0.5), F.col("k")).alias("median"), repeated.alias("n_repeated"), (repeated / n).alias("share_repeated"), F.max("times").alias("most"))


def hub_records(nodes: DataFrame, edges: DataFrame | Within, records: DataFrame, top: int = 4) -> DataFrame:
    """The top nodes by degree (ties: the smaller node), what pruning leaves of them, and their records (node, record,
    lineage, day): node, degree, n_records, leaf_neighbours, degree_without_leaves, in_core, degree_in_core, representative
    (the smallest record), lineages (different ones in order, joined by |), earliest, latest.

    A hub without records has 0 of them, no representative, empty lineages and no days.
    """
    whole = isinstance(edges, Within)
    of = settled(edges.degrees() if whole else degrees(nodes, edges), "hub-degrees")
    inner = (edges.peeled(of) if whole else core(nodes, edges)).select("node", F.lit(True).alias("in_core"))
    best = of.orderBy(F.desc("degree"), "node").limit(top)
    around = settled(edges.edges_at(best), "hub-edges") if whole else half_edges(edges).join(F.broadcast(best.select("node")), "node", "left_semi")
    near = around.join(of.select(F.col("node").alias("neighbour"), F.col("degree").alias("_d")), "neighbour").join(inner.select(F.col("node").alias("neighbour"), F.col("in_core").alias("_c")), "neighbour", "left")
    counts = near.groupBy("node").agg(F.count_if(F.col("_d") == 1).alias("leaf_neighbours"), F.count_if(F.col("_d") != 1).alias("degree_without_leaves"), F.count_if(F.col("_c")).alias("_kept"))
    theirs = records.join(F.broadcast(best.select("node")), "node", "left_semi").groupBy("node")
    told = theirs.agg(F.count("*").alias("n_records"), F.min("record").alias("representative"), F.array_join(F.array_sort(F.collect_set("lineage")), "|").alias("lineages"), F.min("day").alias("earliest"), F.max("day").alias("latest"))
    joined = best.join(counts, "node", "left").join(inner, "node", "left").join(told, "node", "left").fillna(0, ["leaf_neighbours", "degree_without_leaves", "n_records"])
    inside = F.coalesce("in_core", F.lit(False))
    return joined.select("node", "degree", "n_records", "leaf_neighbours", "degree_without_leaves", inside.alias("in_core"), F.when(inside, F.coalesce("_kept", F.lit(0))).otherwise(0).alias("degree_in_core"), "representative", F.coalesce("lineages", F.lit("")).alias("lineages"), "earliest", "latest")


def grid_check(runs: DataFrame, axes: dict[str, DataFrame]) -> DataFrame:
    """(axes, n_runs, state): every cell of the grid of all axes' values, and runs outside: missing, once, repeated or
    unexpected. Axes are short lists of names, one column each; a run with a null on an axis is unexpected."""
    names = list(axes)
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [df.select(name).where(F.col(name).isNotNull()).distinct() for name, df in axes.items()])
    marked = grid.withColumn("_grid", F.lit(1)).unionByName(runs.select(*names).withColumn("_run", F.lit(1)), allowMissingColumns=True)
    counted = marked.groupBy(*names).agg(F.count("_grid").alias("_grid"), F.count("_run").alias("n_runs"))
    n = F.col("n_runs")
    return counted.select(*names, "n_runs", F.when(F.col("_grid") == 0, "unexpected").when(n == 0, "missing").when(n == 1, "once").otherwise("repeated").alias("state"))
