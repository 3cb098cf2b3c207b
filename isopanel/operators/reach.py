"""Quantiles of all geodesic distances and dates in balls of these radii, without a table of distances.

How many positive distances there are is known from the components, so small quantiles need the nearest nodes of each root
only. Some roots show about where a quantile lies; then all roots are walked up to there, and distances are counted: those before
that interval, and those in each of its bins. The next walk gives the distances in the bins that hold the quantile and all balls
that these distances leave as they are; the others, of few roots, are walked once more. If an interval turns out to miss its
quantile, it moves: the sample changes the time, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from .analytics import Csr, broadcast_graph, membership
from .distance import finite

#: Roots that are walked first, bins of an interval, distances a task holds at once and has at least, and tasks at most.
SAMPLE, BINS, CELLS, CELLS_A_TASK, TASKS = 1000, 1 << 14, 1_000_000, 500_000, 192
#: How far beyond the sample's quantiles an interval goes, as a share of the quantile, and at least so many distances of the sample.
MARGIN, FEW = 0.1, 50
FOUND = "kind string, step int, center bigint, value double, n bigint"


class Reach:
    """Walks over a graph's edges from all nodes (node)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.spark = edges.sparkSession
        names, edges = nodes.select("node").distinct(), edges.where(finite("weight"))
        self.graph = broadcast_graph(edges, names.toPandas()["node"].to_numpy(np.int64))
        self.shared = self.spark.sparkContext.broadcast(self.graph)
        sizes = membership(names, edges).groupBy("component").count()
        self.pairs = sizes.agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1)), F.lit(0)).alias("n")).first()["n"]

    def walk(self, roots: np.ndarray, most: float, each: Callable[[Csr], Any], schema: str = FOUND) -> DataFrame:
        """The tables of notes, one for each task: what each(graph) adds of roots (by their places) and the distances of all nodes."""
        shared, tasks = self.shared, max(1, min(TASKS, len(roots), len(roots) * len(self.graph.ids) // CELLS_A_TASK))
        dealt = self.spark.sparkContext.broadcast(roots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph: Csr = shared.value
            step = max(1, CELLS // max(1, len(graph.ids)))
            for batch in batches:
                for task in batch.column("id").to_pylist():
                    own, notes = dealt.value[task::tasks], each(graph)
                    for low in range(0, len(own), step):
                        for root, d in zip(own[low : low + step], graph.within(own[low : low + step], most), strict=True):
                            notes.add(int(root), d)
                    yield from notes.table().to_batches()

        return self.spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)

    def intervals(self, quantiles: list[float]) -> list[tuple[float, float]]:
        """About where the quantiles of the positive distances lie."""
        n = len(self.graph.ids)
        some = np.arange(0, n, max(1, n // SAMPLE))
        found = settled(self.walk(some, np.inf, lambda graph: Sampled()), "distance-sample")
        counts = found.groupBy("value").agg(F.sum("n").alias("n")).toPandas().sort_values("value")
        value, run = counts["value"].to_numpy(), np.cumsum(counts["n"].to_numpy())
        if not len(value):
            return [(0.0, 1.0)] * len(quantiles)
        out = []
        for q in quantiles:
            place, wide = q * run[-1], max(MARGIN * q * run[-1], FEW)
            low, high = (value[min(np.searchsorted(run, max(p, 0)), len(value) - 1)] for p in (place - wide, place + wide))
            out.append((low * (1 - 2.0**-20), high * (1 + 2.0**-20)))
        return out

    def located(self, quantiles: list[float]) -> tuple[dict, dict, dict] | None:
        """By quantile of the positive distances: an interval that holds it, the first and last bin it lies in, and its places
        from there with the share of the step between them; None without such distances."""
        if not self.pairs:
            return None
        everyone, asked = np.arange(len(self.graph.ids)), dict(enumerate(quantiles))
        spans, bins, ranks = dict(enumerate(self.intervals(quantiles))), {}, {}
        while asked:
            own = {k: spans[k] for k in asked}
            found = settled(self.walk(everyone, max(high for _, high in own.values()), lambda graph: Counted(own)), "distance-counts")
            counts = {(r["kind"], r["step"], r["value"]): r["n"] for r in found.groupBy("kind", "step", "value").agg(F.sum("n").alias("n")).collect()}
            total = self.pairs - counts.get(("zero", -1, 0.0), 0)
            if total <= 0:
                return None
            for k, q in list(asked.items()):
                run = np.cumsum([counts.get(("bin", k, float(b)), 0) for b in range(-1, BINS)])
                wanted = (total - 1) * q
                ends = [int(wanted), -int(-wanted // 1)]
                first, last = (int(np.searchsorted(run, e, side="right")) - 1 for e in ends)
                if first < 0:
                    spans[k] = (0.0, spans[k][1] if last >= 0 else spans[k][0] * (1 + 2.0**-20))
                elif last >= BINS:
                    spans[k] = (spans[k][0] if first < BINS else spans[k][1] * (1 - 2.0**-20), spans[k][1] * 2)
                    if not np.isfinite(spans[k][1]):
                        raise ValueError("distances are too large to count")
                else:
                    bins[k], ranks[k] = (first, last), (ends[0] - int(run[first]), ends[1] - int(run[first]), wanted - ends[0])
                    del asked[k]
        return spans, bins, ranks

    def sizes(self, quantiles: list[float]) -> DataFrame:
        """(center, radius, n): how many nodes are in the ball around each root, itself included, by quantile."""
        schema = "center bigint, radius double, n bigint"
        if (found := self.located(quantiles)) is None:
            return self.spark.createDataFrame([], schema)
        spans, bins, ranks = found
        top, ids = max(high for _, high in spans.values()), np.arange(len(self.graph.ids))
        near = settled(self.walk(ids, top, lambda graph: Sizes(graph.ids, spans, bins)), "ball-sizes")
        radii = _radii(near, ranks)
        asked = self.spark.createDataFrame(list(radii.items()), "step int, radius double")
        rows = near.join(F.broadcast(asked), "step").where("kind = 'below' OR value <= radius")
        return rows.groupBy("step", "center", "radius").agg(F.sum("n").alias("n")).select("center", "radius", "n")

    def spread(self, dates: DataFrame, quantiles: list[float]) -> DataFrame:
        """(step, center, mean_gap): of the dates (node, day) in the ball around each root, by quantile; none without dates."""
        if (found := self.located(quantiles)) is None:
            return self.spark.createDataFrame([], "step int, center bigint, mean_gap double")
        spans, bins, ranks = found
        days = dates.where("day IS NOT NULL").select("node", F.unix_date("day").alias("x")).toPandas().sort_values("x")
        days = days[days["node"].isin(self.graph.ids)]
        at, x = np.searchsorted(self.graph.ids, days["node"].to_numpy()), days["x"].to_numpy(np.int64)
        dated = self.spark.sparkContext.broadcast((at, x))
        everyone = np.arange(len(self.graph.ids))
        top = max(high for _, high in spans.values())
        near = settled(self.walk(everyone, top, lambda graph: Balls(graph.ids, dated.value, spans, bins)), "balls")
        radii = _radii(near, ranks)
        open_ = np.array([r["center"] for r in near.where("kind = 'open'").select("center").distinct().collect()], np.int64)
        again = self.walk(np.sort(np.searchsorted(self.graph.ids, open_)), max(radii.values()), lambda graph: Balls(graph.ids, dated.value, radii))
        rest = again.where("kind = 'gap'").join(near.where("kind = 'open'").select("step", "center"), ["step", "center"], "left_semi")
        rows = near.where("kind = 'gap'").unionByName(rest.select(near.columns)) if len(open_) else near.where("kind = 'gap'")
        return rows.select((F.col("step") + 1).alias("step"), "center", F.col("value").alias("mean_gap"))


def _radii(near: DataFrame, ranks: dict[int, tuple[int, int, float]]) -> dict[int, float]:
    """The quantiles themselves, from the distances in their bins."""
    radii = {}
    for k, (a, b, part) in ranks.items():
        inside = near.where((F.col("kind") == "inside") & (F.col("step") == k)).groupBy("value").agg(F.sum("n").alias("n")).toPandas().sort_values("value")
        low, high = inside["value"].to_numpy()[np.searchsorted(np.cumsum(inside["n"].to_numpy()), [a, b], side="right")]
        radii[k] = float(low + (high - low) * part)
    return radii


def _table(rows: list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """kind, step, centers, values, counts."""
    names, kinds = ["kind", "step", "center", "value", "n"], [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
    parts = [pa.table([pa.array(c, t) for c, t in zip(([kind] * len(v), [step] * len(v), center, v, n), kinds, strict=True)], names=names) for kind, step, center, v, n in rows]
    return pa.concat_tables([pa.table([pa.array([], t) for t in kinds], names=names), *parts])


def _bin(d: np.ndarray, span: tuple[float, float]) -> np.ndarray:
    """Bins of distances: -1 before the interval, BINS behind it; never falling as distances rise."""
    scaled = (d - span[0]) * (BINS / max(span[1] - span[0], 1e-300))
    return np.clip(np.floor(scaled), -1, BINS).astype(np.int64)


class Sampled:
    """Positive distances, to 20 bits."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def add(self, root: int, d: np.ndarray) -> None:
        some = d[(d > 0) & np.isfinite(d)]
        self.parts.append(np.unique(some.view(np.int64) >> 36, return_counts=True))

    def table(self) -> pa.Table:
        keys, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([n for _, n in self.parts]), minlength=len(keys)).astype(np.int64)
        return _table([("sample", -1, np.zeros(len(keys), np.int64), (keys << 36).view(np.float64), n)])


class Counted:
    """How many distances are zero (but for the root itself), before an interval, and in each of its bins."""

    def __init__(self, spans: dict[int, tuple[float, float]]):
        self.spans, self.zero, self.counts = spans, 0, {k: np.zeros(BINS + 2, np.int64) for k in spans}

    def add(self, root: int, d: np.ndarray) -> None:
        near = d[np.isfinite(d)]
        positive = near[near > 0]
        self.zero += len(near) - len(positive) - 1
        for k, span in self.spans.items():
            inside = positive[positive >= span[0]]
            self.counts[k][0] += len(positive) - len(inside)
            self.counts[k] += np.bincount(_bin(inside, span) + 1, minlength=BINS + 2)

    def table(self) -> pa.Table:
        rows = [("zero", -1, [0], [0.0], [self.zero])]
        for k, counts in self.counts.items():
            some = np.flatnonzero(counts[:-1])
            rows.append(("bin", k, np.zeros(len(some), np.int64), some - 1.0, counts[some]))
        return _table(rows)


class Balls:
    """Mean gaps of the days in balls. Given bins, distances in them are noted, and roots that have some stay open."""

    def __init__(self, ids: np.ndarray, dated: tuple[np.ndarray, np.ndarray], spans: dict, bins: dict | None = None):
        self.ids, (self.at, self.x) = ids, dated
        self.spans, self.bins = spans, bins
        self.gaps: dict[int, list] = {k: [] for k in spans}
        self.open: dict[int, list] = {k: [] for k in spans}
        self.inside: dict[int, list] = {k: [np.zeros(0)] for k in spans}

    def add(self, root: int, d: np.ndarray) -> None:
        there = np.flatnonzero(np.isfinite(d[self.at]))
        days, d = d[self.at[there]], d[(d > 0) & np.isfinite(d)]
        for k, span in self.spans.items():
            if self.bins is None:
                ball = days <= span
            else:
                first, last = self.bins[k]
                place = _bin(d, span)
                if len(some := d[(place >= first) & (place <= last)]):
                    self.inside[k].append(some)
                    self.open[k].append(root)
                    continue
                ball = (days == 0) | (_bin(days, span) < first)
            x = self.x[there[ball]]
            if n := len(x):
                total = int((x * (2 * np.arange(1, n + 1) - 1)).sum()) - n * int(x.sum())
                self.gaps[k].append((root, total / (n * (n - 1) / 2) if n > 1 else 0.0))

    def table(self) -> pa.Table:
        rows = []
        for k in self.spans:
            root, gap = (np.array(c) for c in zip(*self.gaps[k], strict=True)) if self.gaps[k] else (np.zeros(0), np.zeros(0))
            rows.append(("gap", k, self.ids[root.astype(np.int64)], gap, np.ones(len(gap), np.int64)))
            rows.append(("open", k, self.ids[np.array(self.open[k], np.int64)], np.zeros(len(self.open[k])), np.ones(len(self.open[k]), np.int64)))
            value, n = np.unique(np.concatenate(self.inside[k]), return_counts=True)
            rows.append(("inside", k, np.zeros(len(value), np.int64), value, n))
        return _table(rows)


class Sizes:
    """By root: how many nodes are before the bins of each quantile, and the distances in these."""

    def __init__(self, ids: np.ndarray, spans: dict, bins: dict):
        self.ids, self.spans, self.bins = ids, spans, bins
        self.below: dict[int, list] = {k: [] for k in spans}
        self.inside: dict[int, list] = {k: [] for k in spans}

    def add(self, root: int, d: np.ndarray) -> None:
        near = d[np.isfinite(d)]
        positive = near[near > 0]
        for k, span in self.spans.items():
            first, last = self.bins[k]
            place = _bin(positive, span)
            self.below[k].append((root, len(near) - len(positive) + int((place < first).sum())))
            some = positive[(place >= first) & (place <= last)]
            self.inside[k].append((np.full(len(some), root), some))

    def table(self) -> pa.Table:
        rows = []
        for k in self.spans:
            root, n = (np.array(c, np.int64) for c in zip(*self.below[k], strict=True)) if self.below[k] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows.append(("below", k, self.ids[root], np.zeros(len(root)), n))
            root, value = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0)), *self.inside[k], strict=True))
            rows.append(("inside", k, self.ids[root], value, np.ones(len(root), np.int64)))
        return _table(rows)
