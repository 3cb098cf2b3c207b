"""Exact laws of small samples, tails as column expressions, and medians of what is never formed: all differences
between two groups, and all replicates of a bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled
from .stats import normal_tail

#: Values of a group up to which rank tests take their exact law; larger groups take the normal one.
EXACT_VALUES = 40
#: Steps of the continued fraction, and degrees of freedom above which a tail is the normal one.
STEPS, MOST_FREEDOM = 200, 20_000
#: Values of a block, probes of a round, and differences that are looked at one by one.
BLOCK, PROBES, CANDIDATES = 16_384, 255, 100_000


def log_gamma(z: Column) -> Column:
    """Of z > 0: Stirling's series at z + 8, less the logarithm of what lies between."""
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    between = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda a, i: a + F.log(z + i))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - between


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) by its continued fraction, for a and b up to some thousands."""

    def below(x: Column, a: Column, b: Column) -> Column:
        def factors(m: Column) -> tuple[Column, Column]:
            even = a + 2 * m
            return m * (b - m) * x / ((even - 1) * even), -(a + m) * (a + b + m) * x / (even * (even + 1))

        def step(s: Column, f: Column) -> Column:
            d, c = 1 / (1 + f * s["d"]), 1 + f / s["c"]
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

        first = 1 / (1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        steps = F.sequence(F.lit(1), F.lit(STEPS))
        fraction = F.aggregate(F.flatten(F.transform(steps, lambda m: F.array(*factors(m.cast("double"))))), start, step)["h"]
        front = F.exp(a * F.log(x) + b * F.log(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
        return front * fraction / a

    inside = F.when(x < (a + 1) / (a + b + 2), below(x, a, b)).otherwise(1 - below(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def student_tail(t: Column, freedom: Column) -> Column:
    """P(T > t) for t >= 0."""
    v = freedom.cast("double")
    return F.when(v > MOST_FREEDOM, normal_tail(t)).otherwise(beta_share(v / (v + t * t), v / 2, F.lit(0.5)) / 2)


def sign_tail(least: Column, n: Column) -> Column:
    """P(X <= least) of n fair coins."""
    k, m = least.cast("double"), n.cast("double")
    exact = F.when(k >= m, 1.0).otherwise(beta_share(F.lit(0.5), m - k, k + 1))
    z = (m / 2 - k - 0.5) / F.sqrt(m / 4)
    return F.when(m <= MOST_FREEDOM, exact).when(z >= 0, normal_tail(F.abs(z))).otherwise(1 - normal_tail(F.abs(z)))


def subset_sums(values: list[int], chosen: int | None = None) -> np.ndarray:
    """How many subsets, of `chosen` values or of any number, have each sum: as floats, exact below 2^53."""
    total = sum(values)
    ways = np.zeros(((chosen or 0) + 1, total + 1))
    ways[0, 0] = 1
    for value in values:
        if chosen is None:
            ways[0, value:] += ways[0, : total + 1 - value].copy()
        else:
            ways[1:, value:] += ways[:-1, : total + 1 - value].copy()
    return ways[-1]


def two_sided(ways: np.ndarray, at: int) -> float:
    """Twice the smaller tail, both with `at`, 1 at most."""
    return float(min(1.0, 2 * min(ways[: at + 1].sum(), ways[at:].sum()) / ways.sum()))


def group_ranks(counted: DataFrame, value: str, by: list[str]) -> DataFrame:
    """counted (by, value, n, ...) with r, the average rank of each value among its group's rows.

    Values are split into ranges and only sums of the ranges meet, so that a group may be larger than a task.
    """
    parted = settled(counted.repartitionByRange(*by, value).withColumn("_p", F.spark_partition_id()), "group-ranks")
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    parted = parted.withColumn("_group", group)
    earlier = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = parted.groupBy("_group", "_p").agg(F.sum("n").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    inside = F.sum("n").over(Window.partitionBy("_group", "_p").orderBy(value))
    return parted.join(before, ["_group", "_p"]).withColumn("r", F.col("_before") + inside - (F.col("n") - 1) / 2).drop("_before", "_p")


def _laws(small: DataFrame, statistic: str, chosen: str | None) -> DataFrame:
    """(_group, p) from small groups' values: rows (_group, n, r) and, of each group, a statistic and how many are chosen."""
    values = F.sort_array(F.collect_list(F.struct((2 * F.col("r")).cast("int").alias("rank"), F.col("n").cast("int").alias("n"))))
    one = small.groupBy("_group").agg(values.alias("values"), F.first(statistic).alias("at"), F.first(chosen).alias("chosen") if chosen else F.lit(None).cast("bigint").alias("chosen"))

    @F.pandas_udf("double")
    def law(values: pd.Series, at: pd.Series, chosen: pd.Series) -> pd.Series:
        out = []
        for cells, statistic, k in zip(values, at, chosen, strict=True):
            doubled = [cell["rank"] for cell in cells for _ in range(cell["n"])]
            out.append(two_sided(subset_sums(doubled, None if pd.isna(k) else int(k)), round(2 * statistic)))
        return pd.Series(out, dtype=float)

    return one.select("_group", law("values", "at", "chosen").alias("p_exact"))


def rank_sum_tests(rows: DataFrame, value: str, first: Column, *by: str) -> DataFrame:
    """(by, n1, n2, u, rank_biserial, p, exact): two-sided rank-sum test of each group.

    Groups of up to EXACT_VALUES values take the exact law, over their own tied ranks; others the normal one with
    corrections for ties and continuity. p is null where one side is empty, 1 where all values are equal.
    """
    keep = list(by)
    counted = rows.where(F.col(value).isNotNull() & first.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.count_if(first).alias("n_first"))
    ranked = group_ranks(counted, value, keep)
    n, n1, n2 = F.col("n_all").cast("double"), F.col("n1").cast("double"), F.col("n2").cast("double")
    sums = ranked.groupBy("_group", *by).agg(F.sum("n").alias("n_all"), F.sum("n_first").alias("n1"), F.sum(F.col("n_first") * F.col("r")).alias("w"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    sums = settled(sums.withColumn("n2", F.col("n_all") - F.col("n1")), "rank-sums")
    small = ranked.select("_group", "n", "r").join(sums.where(f"n_all <= {EXACT_VALUES} AND n1 > 0 AND n2 > 0").select("_group", "w", "n1"), "_group")
    u = F.col("w") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd
    normal = F.when(sd > 0, F.least(F.lit(1.0), 2 * normal_tail(z))).otherwise(1.0)
    p = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.coalesce("p_exact", normal))
    joined = sums.join(_laws(small, "w", "n1"), "_group", "left")
    return joined.select(*by, "n1", "n2", u.alias("u"), F.try_divide(2 * u, n1 * n2).alias("_b"), p.alias("p"), F.col("p_exact").isNotNull().alias("exact")).withColumn("rank_biserial", F.col("_b") - 1).drop("_b")


def signed_rank_tests(rows: DataFrame, delta: str, *by: str) -> DataFrame:
    """(by, n, n_positive, n_negative, w, p, exact, sign_p): signed-rank and sign test of each group's changes.

    Zeros count in n only. Groups of up to EXACT_VALUES changes take the exact law, over their own tied ranks; others the
    normal one with a correction for ties. Without a change both p are null.
    """
    counted = rows.where(F.col(delta).isNotNull()).groupBy(*by, F.abs(delta).alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col(delta) > 0).alias("n_up"))
    some = group_ranks(counted.where("size > 0"), "size", list(by))
    sums = some.groupBy("_group", *by).agg(F.sum("n").alias("m"), F.sum("n_up").alias("n_positive"), F.sum(F.col("n_up") * F.col("r")).alias("w"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    sums = settled(sums, "signed-ranks")
    small = some.select("_group", "n", "r").join(sums.where(f"m <= {EXACT_VALUES}").select("_group", "w"), "_group")
    m = F.col("m").cast("double")
    z = F.abs(F.col("w") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    least = F.least(F.col("n_positive"), F.col("m") - F.col("n_positive"))
    found = sums.join(_laws(small, "w", None), "_group", "left")
    found = found.select("_group", "m", "n_positive", (F.col("m") - F.col("n_positive")).alias("n_negative"), "w", F.coalesce("p_exact", F.least(F.lit(1.0), 2 * normal_tail(z))).alias("p"), F.col("p_exact").isNotNull().alias("exact"), F.least(F.lit(1.0), 2 * sign_tail(least, F.col("m"))).alias("sign_p"))
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    whole = counted.groupBy(*by).agg(F.sum("n").alias("n")).withColumn("_group", group)
    none = {"n_positive": F.lit(0), "n_negative": F.lit(0), "w": F.lit(0.0), "exact": F.lit(False)}
    both = whole.join(found, "_group", "left")
    return both.select(*by, "n", *(F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_positive", "n_negative", "w", "p", "exact", "sign_p")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted values and their counts as blocks with their ends."""
    names = ("low", "high", "n", "values", "counts")

    def give(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [[float(values[0])], [float(values[-1])], [int(counts.sum())], [values.tobytes()], [counts.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    held = [np.zeros(0), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        while len(held[0]) >= BLOCK:
            yield give(held[0][:BLOCK], held[1][:BLOCK])
            held = [h[BLOCK:] for h in held]
    if len(held[0]):
        yield give(*held)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Floats as whole numbers in the same order."""
    bits = np.asarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _floats(keys: list[int]) -> np.ndarray:
    found = np.array(keys, np.int64)
    return np.where(found < 0, np.int64(-(2**63)) - found, found).view(np.float64)


def _at_most(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """For each a the first place in sorted b with a - b <= x, as floats subtract; all later ones have it too."""
    at = np.searchsorted(b, a - x)
    while len(late := np.flatnonzero((at > 0) & (a - b[np.maximum(at - 1, 0)] <= x))):
        at[late] -= 1
    while len(early := np.flatnonzero((at < len(b)) & (a - b[np.minimum(at, len(b) - 1)] > x))):
        at[early] += 1
    return at


class Differences:
    """All differences between the values of two groups, never formed: their k-th smallest by counting.

    Both groups are tables of sorted blocks. The driver has the blocks' ends and sizes, a row for each; pairs of blocks
    whose differences all lie on one side of the open interval count by their product, and only the pairs across it, a
    staircase of about as many as there are blocks, are merged in tasks, for PROBES points at once.
    """

    def __init__(self, rows: DataFrame, value: str, first: Column):
        fine = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & first.isNotNull())
        counted = settled(fine.groupBy(first.alias("first"), (F.col(value).cast("double") + 0.0).alias("v")).agg(F.count("*").alias("c")), "differences")
        schema = "low double, high double, n bigint, values binary, counts binary"
        self.sides = []
        for side in (True, False):
            ordered = counted.where(F.col("first") == side).select("v", "c").repartitionByRange("v").sortWithinPartitions("v")
            self.sides.append(settled(ordered.mapInArrow(_packed, schema).withColumn("id", F.monotonically_increasing_id()), "blocks"))
        self.ends = [side.select("id", "low", "high", "n").orderBy("low").toPandas() for side in self.sides]
        self.spark = rows.sparkSession

    @property
    def sizes(self) -> tuple[int, int]:
        return tuple(int(e["n"].sum()) for e in self.ends)  # type: ignore[return-value]

    def _bounds(self, low: float, high: float) -> tuple[int, pd.DataFrame]:
        """How many differences are at most `low` for sure, and the pairs of blocks with some in (low, high]."""
        a, b = self.ends
        under, pairs = 0, []
        for block, a_low, a_high, n in a.itertuples(index=False):
            sure = (a_high - b["low"] <= low).to_numpy()
            open_ = ~sure & (a_low - b["high"] <= high).to_numpy()
            under += n * int(b["n"][sure].sum())
            pairs += [(block, other) for other in b["id"][open_]]
        return under, pd.DataFrame(pairs, columns=["a", "b"])

    def _merged(self, pairs: pd.DataFrame) -> DataFrame:
        asked = self.spark.createDataFrame([(int(a), int(b)) for a, b in pairs.itertuples(index=False)], "a bigint, b bigint").repartition(max(1, min(len(pairs), 4096)))
        a, b = (side.select(F.col("id").alias(name), F.col("values").alias(f"{name}_values"), F.col("counts").alias(f"{name}_counts")) for side, name in zip(self.sides, "ab", strict=True))
        return asked.join(a, "a").join(b, "b").select("a_values", "a_counts", "b_values", "b_counts")

    def _counts(self, pairs: pd.DataFrame, points: np.ndarray) -> np.ndarray:
        """For each point, how many differences of these pairs are at most there."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(points), np.int64)
            for a, n, b, m in _arrays(batches):
                rest = np.append(np.cumsum(m[::-1])[::-1], 0)
                sums += [int(n @ rest[_at_most(a, b, x)]) for x in points.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points))), pa.array(sums)], names=["point", "n"])

        found = self._merged(pairs).mapInArrow(count, "point bigint, n bigint").groupBy("point").agg(F.sum("n").alias("n"))
        out = np.zeros(len(points), np.int64)
        for row in found.collect():
            out[row["point"]] = row["n"]
        return out

    def _between(self, pairs: pd.DataFrame, low: float, high: float) -> pd.DataFrame:
        """The differences in (low, high] and how often each one is there."""

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, n, b, m in _arrays(batches):
                starts, ends = _at_most(a, b, high), _at_most(a, b, low)
                sizes = ends - starts
                who = np.repeat(np.arange(len(a)), sizes)
                other = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(a[who] - b[other]), pa.array(n[who] * m[other])], names=["d", "n"])

        return self._merged(pairs).mapInArrow(take, "d double, n bigint").groupBy("d").agg(F.sum("n").alias("n")).orderBy("d").toPandas()

    def smallest(self, k: int) -> float:
        """The k-th smallest difference, from 1."""
        a, b = self.ends
        low, high = int(_ordered(a["low"].min() - b["high"].max())) - 1, int(_ordered(a["high"].max() - b["low"].min()))
        while True:  # a round leaves a 256th of the floats between, so this ends
            edges = _floats([low, high])
            under, pairs = self._bounds(*edges)
            points = sorted({low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {low} | {high})
            counts = self._counts(pairs, np.append(edges[0], _floats(points))) + under
            reached = int(np.searchsorted(counts[1:], k))
            before = int(counts[reached])
            low, high = low if reached == 0 else points[reached - 1], points[reached]
            if high - low == 1:
                return float(_floats([high])[0])
            if int(counts[reached + 1]) - before <= CANDIDATES:
                edges = _floats([low, high])
                found = self._between(self._bounds(*edges)[1], *edges)
                return float(found["d"].iloc[int(np.searchsorted(found["n"].cumsum().to_numpy(), k - before))])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield [np.frombuffer(row[c], kind) for c, kind in (("a_values", "<f8"), ("a_counts", "<i8"), ("b_values", "<f8"), ("b_counts", "<i8"))]


def shift(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """One row (n1, n2, shift): the Hodges-Lehmann shift, the median of all differences of the first group's values less
    the others'; null where a group is empty."""
    all_ = Differences(rows, value, first)
    n1, n2 = all_.sizes
    middle = None
    if n1 and n2:
        k = (n1 * n2 + 1) // 2
        middle = all_.smallest(k)
        if n1 * n2 % 2 == 0:
            middle = (middle + all_.smallest(k + 1)) / 2
    return rows.sparkSession.createDataFrame([(n1, n2, middle)], "n1 bigint, n2 bigint, shift double")


#: P(X <= i) of a Poisson number with mean 1, to the last that a 32-bit hash can tell.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(13)]


def hashed_weight(key: Column, replicate: Column) -> Column:
    """A Poisson number with mean 1 from the md5 of key and replicate."""
    h = F.substring(F.md5(F.concat_ws("-", key.cast("string"), replicate.cast("string"))), 1, 8)
    # h / 2^32 passes p from this number on, which stands in the order of its digits
    firsts = [first for p in POISSON if (first := math.floor(p * 2**32) + 1) < 2**32]
    return reduce(lambda a, b: a + b, [(h >= f"{first:08x}").cast("int") for first in firsts])


#: Weights of a range of values: those of the ranges that hold a replicate's median are made twice.
RANGE_WEIGHTS, MOST_RANGES = 500_000, 2048


def bootstrap_medians(rows: DataFrame, value: str, key: str, replicates: int, *by: str, level: float = 0.95) -> DataFrame:
    """(by, n, median, low, high): percentile interval of the median over Poisson resamples.

    Values are split into ranges, and the weights of a range are summed where it lies; only sums of ranges meet. A
    replicate's median is where its running weight passes half of the whole, so only the ranges where that happens are
    looked at by value. No replicate's rows are shuffled.
    """
    group = list(by)
    name = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    fine = rows.where(F.col(value).isNotNull()).select(*by, F.col(key).alias("_key"), F.col(value).cast("double").alias("v"))
    ranges = max(8, min(MOST_RANGES, fine.count() * (replicates + 1) // RANGE_WEIGHTS))
    # equal values may lie in several ranges, in any order
    parted = settled(fine.repartitionByRange(ranges, *by, "v", "_key").withColumn("_p", F.spark_partition_id()), "resamples").withColumn("_group", name)
    # replicate 0 is the sample itself
    weight = F.when(F.col("_k") == 0, 1).otherwise(hashed_weight(F.col("_key"), F.col("_k")))
    each = parted.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    sums = each.groupBy("_group", "_k", "_p").agg(F.sum(weight).alias("_s")).where("_s > 0")
    every = Window.partitionBy("_group", "_k")  # a row for each range
    sums = sums.withColumns({"_all": F.sum("_s").over(every), "_before": F.coalesce(F.sum("_s").over(every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    middle = settled(sums.where("_before * 2 <= _all AND (_before + _s) * 2 >= _all").drop("_s"), "middles")
    counted = parted.join(F.broadcast(middle), ["_group", "_p"]).groupBy(*by, "_group", "_k", "_p", "_before", "_all", "v").agg(F.sum(weight).alias("n")).where("n > 0")
    run = F.col("_before") + F.sum("n").over(Window.partitionBy("_group", "_k", "_p").orderBy("v"))
    reached = counted.withColumn("_run", run)
    low, high = (F.min(F.when(c, F.col("v"))) for c in (F.col("_run") * 2 >= F.col("_all"), F.col("_run") * 2 > F.col("_all")))
    medians = reached.groupBy(*group, "_group", "_k").agg(((low + high) / 2).alias("m"), F.first("_all").alias("_all"))
    draws = F.when(F.col("_k") > 0, F.col("m"))  # as many as there are replicates
    q = F.percentile(draws, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    found = medians.groupBy(*group, "_group").agg(F.max(F.when(F.col("_k") == 0, F.col("_all"))).alias("n"), F.max(F.when(F.col("_k") == 0, F.col("m"))).alias("median"), q.alias("q"))
    return found.select(*by, "n", "median", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
