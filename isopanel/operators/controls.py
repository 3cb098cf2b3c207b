"""Controls of removed edges: kept edges at the same node, of nearly the same weight, each used once; and tables of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from .graphs import half_edges
from .positions import numbered

#: How many places on either side of an edge's weight are looked at first, for each control wanted, and how fast that grows.
FIRST_WIDTH, WIDER = 4, 4
_EDGE = ["c_source", "c_target"]


def within_caliper(weight: Column, control: Column, share: float) -> Column:
    """Weights are alike: zero is like zero only, others up to a share of the first."""
    none = (weight == 0) | (control == 0)
    return F.when(none, weight == control).otherwise(F.abs(control - weight) <= share * weight)


def _places(kept: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kept half edges with their place at a node by (weight, partner); turns with q, how many of them weigh less, and n, all."""
    placed = settled(numbered(kept, ["node"], ["weight", "partner"]), "kept-places")
    mixed = placed.select("node", "weight", F.lit(1).alias("kind"), "place").unionByName(turns.select("node", "weight", F.lit(0).alias("kind"), F.col("turn").alias("place")))
    among = numbered(mixed, ["node"], ["weight", "kind", "place"], "_all").where("kind = 0").select("node", F.col("place").alias("turn"), "_all")
    own = numbered(turns, ["node"], ["weight", "turn"], "_own")
    sizes = placed.groupBy("node").agg(F.count("*").alias("n"))
    asked = own.join(among, ["node", "turn"]).join(sizes, "node").select("turn", "node", "weight", (F.col("_all") - F.col("_own")).alias("q"), "n")
    return placed, asked


def _seen(asked: DataFrame, placed: DataFrame, before: Column, width: Column) -> tuple[DataFrame, DataFrame]:
    """Candidates at places that the window has with `width` and had not with `before`; and for each turn the gap below
    which none is missing."""
    low, high = F.greatest(F.lit(0), F.col("q") - width), F.least(F.col("n"), F.col("q") + width) - 1
    wide = asked.select("turn", "node", F.col("weight").alias("w"), "q", "n", low.alias("low"), high.alias("high"), before.alias("before"), F.explode(F.sequence(low, high)).alias("place"))
    new = wide.where("place < q - before OR place >= q + before").join(placed.withColumnRenamed("weight", "c_weight"), ["node", "place"])
    found = settled(new.withColumn("gap", F.abs(F.col("c_weight") - F.col("w"))), "candidates")
    inf = F.lit(float("inf"))
    side = lambda inside, open_: F.coalesce(F.max(F.when(inside & open_, F.col("gap"))), inf)
    bounds = found.groupBy("turn").agg(F.least(side(F.col("place") < F.col("q"), F.col("low") > 0), side(F.col("place") >= F.col("q"), F.col("high") < F.col("n") - 1)).alias("bound"))
    ends = (F.least("node", "partner").alias("c_source"), F.greatest("node", "partner").alias("c_target"))
    return found.select("turn", "gap", "partner", "c_weight", *ends), bounds


def _foremost(candidates: DataFrame, state: DataFrame, per_end: int) -> DataFrame:
    """The nearest candidates of each turn, as far as no nearer one can be missing; an aggregate that keeps few of them."""
    sure = candidates.join(state.select("turn", "bound"), "turn").where("gap < bound")
    order = F.array_sort(F.collect_list(F.struct("gap", "partner", "c_weight", *_EDGE)))
    return sure.groupBy("turn").agg(F.slice(order, 1, per_end).alias("e")).select("turn", F.explode("e").alias("e")).select("turn", "e.*")


def control_edges(edges: DataFrame, rejected: DataFrame, removed: DataFrame, per_end: int = 1, caliper: float = 0.1, seed: int = 0) -> DataFrame:
    """Controls of removed edges (source, target): edges that are neither removed nor rejected and share an end.

    Removed edges come in turn, by a hash of their ends; each takes at its source, then at its target, the per_end
    nearest by weight (ties: the smaller partner) that no turn before took. Returns source, target, turn, role (source or
    target), shared, partner, c_source, c_target, weight, c_weight, gap, within (the caliper).

    Turns are not played one by one. All ask for their nearest at once, an edge goes to the first turn that asks, and
    those behind it ask again without it, until nobody is turned away: as all edges prefer the earlier turn, that is
    what playing the turns gives. A turn sees some places on both sides of its weight in the sorted edges of its node
    and more only when these are gone, so the pairs of removed and kept edges at a node with very many of them are
    not formed, unless so many weights are alike that the turns must step over one another.

    Edges without a weight, or with one that is no number, are neither removed nor controls; removed edges that are not
    among the edges have no controls; repeated rows count once.
    """
    known = edges.select("source", "target", F.col("weight").cast("double").alias("weight")).where("weight IS NOT NULL AND NOT isnan(weight)").dropDuplicates(["source", "target"])
    gone = settled(known.join(removed.select("source", "target").distinct(), ["source", "target"], "left_semi"), "removed")
    out = rejected.select("source", "target").unionByName(removed.select("source", "target")).distinct()
    kept = half_edges(known.join(out, ["source", "target"], "left_anti")).withColumnRenamed("neighbour", "partner")
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("source").cast("string"), F.col("target").cast("string")))
    at = settled(numbered(gone.withColumn("_order", order), [], ["_order", "source", "target"], "_place").drop("_order"), "removed-turns")
    turn = lambda end: (F.col("_place") * 2 + int(end == "target")).alias("turn")
    heads = reduce(DataFrame.unionByName, [at.select(turn(e), F.col(e).alias("node"), "weight", "source", "target", F.lit(e).alias("role")) for e in ("source", "target")])
    placed, asked = _places(kept, heads.select("turn", "node", "weight"))
    width = FIRST_WIDTH * per_end
    asked = settled(asked.withColumn("width", F.lit(width).cast("bigint")), "turns")
    candidates, bounds = _seen(asked, placed, F.lit(0), F.col("width"))
    candidates, state = settled(candidates, "live"), settled(asked.join(bounds, "turn"), "turns")
    n = candidates.count()
    while True:
        first = _foremost(candidates, state, per_end).groupBy(*_EDGE).agg(F.min("turn").alias("_holder"))
        left = settled(candidates.join(first, _EDGE, "left").where("_holder IS NULL OR turn <= _holder").drop("_holder"), "live")
        sure = left.join(state.select("turn", "bound"), "turn").where("gap < bound").groupBy("turn").agg(F.count("*").alias("_sure"))
        short = (F.coalesce("_sure", F.lit(0)) < per_end) & ((F.col("q") > F.col("width")) | (F.col("q") + F.col("width") < F.col("n")))
        state = settled(state.join(sure, "turn", "left").withColumn("_short", short).drop("_sure"), "turns")
        hungry = state.where("_short").drop("_short", "bound")
        after, n_hungry = left.count(), hungry.count()
        candidates = left
        if not n_hungry and after == n:
            break
        if n_hungry:
            new, bounds = _seen(hungry, placed, F.col("width"), F.col("width") * WIDER)
            candidates = settled(left.unionByName(new), "live")
            grown = hungry.withColumn("width", F.col("width") * WIDER).join(bounds, "turn")
            state = settled(state.where("NOT _short").drop("_short").unionByName(grown), "turns")
            after = candidates.count()
        else:
            state = state.drop("_short")
        n = after
    won = _foremost(candidates, state, per_end).join(heads, "turn")
    fine = within_caliper(F.col("weight"), F.col("c_weight"), caliper).alias("within")
    return won.select("source", "target", "turn", "role", F.col("node").alias("shared"), "partner", *_EDGE, "weight", "c_weight", "gap", fine)


def edge_table(edges: DataFrame, rejected: DataFrame, removed: DataFrame, controls: DataFrame, labels: DataFrame, dates: DataFrame, other: DataFrame) -> DataFrame:
    """One row for each edge: what became of it, its part in the design, and what is compared between parts.

    status: removed, kept_for_connection (rejected but not removed) or retained. role: removed (with controls),
    control, or none. other (i, j, d) is a second distance. day_gap is null where a date is missing, same_label where a
    label is; low_degree and high_degree are those of the edge's ends in the whole graph.
    """
    ends = ["source", "target"]
    degrees = half_edges(edges).groupBy("node").agg(F.count("*").alias("degree"))
    facts = labels.join(dates, "node", "full").join(degrees, "node", "full")
    sides = [facts.select(F.col("node").alias(e), F.struct("label", "day", "degree").alias(s)) for e, s in zip(ends, "ab", strict=True)]
    mark = lambda df, name: df.select(*ends).distinct().withColumn(name, F.lit(True))
    parts = [mark(rejected, "_rejected"), mark(removed, "_removed"), mark(controls, "_matched"), mark(controls.select(F.col("c_source").alias("source"), F.col("c_target").alias("target")), "_control")]
    second = other.select(F.least("i", "j").alias("source"), F.greatest("i", "j").alias("target"), F.col("d").alias("other"))
    whole = reduce(lambda df, part: df.join(part, ends, "left"), [*parts, second], edges).join(sides[0], "source", "left").join(sides[1], "target", "left")
    status = F.when(F.col("_removed"), "removed").when(F.col("_rejected"), "kept_for_connection").otherwise("retained").alias("status")
    role = F.when(F.col("_matched"), "removed").when(F.col("_control"), "control").otherwise("none").alias("role")
    gap = F.abs(F.datediff("a.day", "b.day")).alias("day_gap")
    degree = [f("a.degree", "b.degree").alias(name) for f, name in ((F.least, "low_degree"), (F.greatest, "high_degree"))]
    return whole.select(*ends, "weight", status, role, "other", gap, (F.col("a.label") == F.col("b.label")).alias("same_label"), *degree)


def matched_contrasts(table: DataFrame, controls: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n_groups, mean_removed, mean_controls, mean_delta, n_higher, n_lower, n_equal): each removed edge
    against the mean of its controls. Groups without a value on one side are left out of that metric."""
    names = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    long = table.select("source", "target", F.explode(names).alias("m")).select("source", "target", "m.*").where("value IS NOT NULL")
    theirs = controls.select(F.col("source").alias("r_source"), F.col("target").alias("r_target"), F.col("c_source").alias("source"), F.col("c_target").alias("target"))
    means = theirs.join(long, ["source", "target"]).groupBy(F.col("r_source").alias("source"), F.col("r_target").alias("target"), "metric").agg(F.avg("value").alias("control"))
    both = means.join(long, ["source", "target", "metric"]).withColumn("delta", F.col("value") - F.col("control"))
    counts = [F.count_if(test).alias(n) for n, test in (("n_higher", F.col("delta") > 0), ("n_lower", F.col("delta") < 0), ("n_equal", F.col("delta") == 0))]
    return both.groupBy("metric").agg(F.count("*").alias("n_groups"), F.avg("value").alias("mean_removed"), F.avg("control").alias("mean_controls"), F.avg("delta").alias("mean_delta"), *counts)
