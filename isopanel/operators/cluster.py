"""k-medoids on distance tables and on aligned strings, with designs as tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled
from .distance import both_ways
from .pairs import sums_within
from .stats import vector_distance

Step = Callable[[DataFrame], DataFrame]


def design(labels: DataFrame, repeats: int) -> DataFrame:
    """(repeat, slot, label, node): one member of each label for each repeat, by hash order."""
    each = labels.where("label IS NOT NULL").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = Window.partitionBy("repeat", "label").orderBy(F.xxhash64("repeat", "node"), "node")
    picked = each.withColumn("r", F.row_number().over(order)).where("r = 1")
    slot = F.dense_rank().over(Window.partitionBy("repeat").orderBy("label")) - 1  # one row for each label
    return picked.select("repeat", slot.alias("slot"), "label", "node")


def assign(pairs: DataFrame, medoids: DataFrame) -> DataFrame:
    """(repeat, node, slot, d): the nearest medoid (repeat, slot, node), ties to the lower slot; a medoid owns itself."""
    to = medoids.select("repeat", "slot", F.col("node").alias("i"))
    near = both_ways(pairs.select("i", "j", "d")).join(F.broadcast(to), "i").groupBy("repeat", F.col("j").alias("node")).agg(F.min(F.struct("d", "slot")).alias("m"))
    others = near.select("repeat", "node", F.col("m.slot").alias("slot"), F.col("m.d").cast("double").alias("d")).join(medoids.select("repeat", "node"), ["repeat", "node"], "left_anti")
    return others.unionByName(medoids.select("repeat", "node", "slot", F.lit(0.0).alias("d")))


def assign_vectors(nodes: DataFrame, medoids: DataFrame, metric: str = "cityblock") -> DataFrame:
    """assign() from vectors (id, v): each node meets the medoids only, which go to all tasks, a row each."""
    to = medoids.join(nodes, F.col("node") == F.col("id")).select("repeat", "slot", F.col("node").alias("_m"), F.col("v").alias("_w"))
    apart = nodes.join(F.broadcast(to)).where("id <> _m").select("repeat", F.col("id").alias("node"), "slot", vector_distance("v", "_w", metric).alias("d"))
    near = apart.groupBy("repeat", "node").agg(F.min(F.struct("d", "slot")).alias("m"))
    others = near.select("repeat", "node", F.col("m.slot").alias("slot"), F.col("m.d").cast("double").alias("d")).join(medoids.select("repeat", "node"), ["repeat", "node"], "left_anti")
    return others.unionByName(medoids.select("repeat", "node", "slot", F.lit(0.0).alias("d")))


def update_vectors(nodes: DataFrame, assigned: DataFrame, metric: str = "cityblock") -> DataFrame:
    """update() from vectors (id, v): sums within clusters, block by block; distances are made in memory and between clusters
    not at all. A cluster of each repeat is one of its own."""
    kinds = dict(assigned.dtypes)
    assigned = settled(assigned.select("repeat", "slot", "node"), "assigned")
    slots = (assigned.agg(F.max("slot").alias("n")).first()["n"] or 0) + 1
    group = F.col("repeat").cast("bigint") * slots + F.col("slot")
    members = nodes.join(assigned.select(F.col("node").alias("id"), group.alias("group")), "id")
    sums = sums_within(members, "group", metric).select((F.col("group") / slots).cast(kinds["repeat"]).alias("repeat"), (F.col("group") % slots).cast(kinds["slot"]).alias("slot"), "node", "s")
    every = assigned.join(sums, ["repeat", "slot", "node"], "left").fillna(0.0, ["s"])
    return every.groupBy("repeat", "slot").agg(F.min(F.struct("s", "node")).alias("m")).select("repeat", "slot", F.col("m.node").alias("node"))


def objectives(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("repeat").agg(F.sum("d").alias("objective"))


def update(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """(repeat, slot, node): the member with the least sum of distances to its cluster, ties to the smaller node."""
    a, b = (assigned.select("repeat", "slot", F.col("node").alias(c)) for c in ("i", "j"))
    inside = both_ways(pairs.select("i", "j", "d")).join(a, "i").join(b, ["repeat", "slot", "j"])
    sums = inside.groupBy("repeat", "slot", F.col("i").alias("node")).agg(F.sum(F.col("d").cast("double")).alias("s"))
    every = assigned.select("repeat", "slot", "node").join(sums, ["repeat", "slot", "node"], "left").fillna(0.0, ["s"])  # alone in its cluster
    return every.groupBy("repeat", "slot").agg(F.min(F.struct("s", "node")).alias("m")).select("repeat", "slot", F.col("m.node").alias("node"))


def k_medoids(pairs: DataFrame, medoids: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Assignments and (repeat, iterations, objective, converged): assign and update until no objective falls.

    Objectives fall among finitely many choices, so this ends; with a number of rounds, a repeat that still moves after
    them comes out as not converged.
    """
    return _moved(lambda m: assign(pairs, m), lambda a: update(pairs, a), medoids, rounds)


def k_medoids_vectors(nodes: DataFrame, medoids: DataFrame, metric: str = "cityblock", rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """k_medoids() from vectors (id, v), without a table of pairs: each round makes the distances within clusters anew."""
    return _moved(lambda m: assign_vectors(nodes, m, metric), lambda a: update_vectors(nodes, a, metric), medoids, rounds)


def _moved(assign: Step, update: Step, medoids: DataFrame, rounds: int | None) -> tuple[DataFrame, DataFrame]:
    medoids = settled(medoids.select("repeat", "slot", "node"), "medoids")
    assigned = settled(assign(medoids), "assigned")
    values = {r["repeat"]: r["objective"] for r in objectives(assigned).collect()}  # a row for each repeat
    steps = dict.fromkeys(values, 1)
    moving: set[int] = set(values)
    for _ in count() if rounds is None else range(rounds):
        # a repeat that rests would only find the same again
        after = settled(update(assigned.where(F.col("repeat").isin(sorted(moving)))), "medoids")
        found = settled(assign(after), "assigned")
        fallen = {r["repeat"]: r["objective"] for r in objectives(found).collect()}
        better = {k for k, v in fallen.items() if v < values[k] - 1e-9}
        moving = better
        if not better:
            break
        for k in better:
            values[k], steps[k] = fallen[k], steps[k] + 1
        moved = F.col("repeat").isin(sorted(better))
        assigned = settled(found.where(moved).unionByName(assigned.where(~moved)), "assigned")
    rows = [(k, steps[k], values[k], k not in moving) for k in sorted(values)]
    return assigned, medoids.sparkSession.createDataFrame(rows, "repeat int, iterations int, objective double, converged boolean")


def profile_medoids(strings: DataFrame, assigned: DataFrame) -> DataFrame:
    """(repeat, slot, node, s): Hamming medoids of aligned strings (node, s) from counts by place, without pairs.

    A member's sum of distances is n * length less how often the cluster has its letter at each place.
    """
    letters = assigned.join(strings, "node").select("repeat", "slot", "node", F.posexplode(F.split("s", "")).alias("place", "letter"))
    counts = letters.groupBy("repeat", "slot", "place", "letter").agg(F.count("*").alias("c"))
    n = assigned.groupBy("repeat", "slot").agg(F.count("*").alias("n"))
    sums = letters.join(counts, ["repeat", "slot", "place", "letter"]).groupBy("repeat", "slot", "node").agg(F.count("*").alias("length"), F.sum("c").alias("same"))
    scored = sums.join(n, ["repeat", "slot"]).select("repeat", "slot", "node", (F.col("n") * F.col("length") - F.col("same")).alias("s"))
    return scored.groupBy("repeat", "slot").agg(F.min(F.struct("s", "node")).alias("m")).select("repeat", "slot", F.col("m.node").alias("node"), F.col("m.s").alias("s"))
