"""Statistics as aggregates: ranks, correlations, distortions, quartets, group tests and agreement of partitions."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null without variance, also where division by zero is an error."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties at their mean, within groups."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, r): the average rank of each distinct value over the whole table.

    Values are counted first and split into ranges; only a row for each range meets in one task.
    """
    counted = df.groupBy(value).agg(F.count("*").alias("_n")).repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    counted = settled(counted, "ranks")
    before = counted.groupBy("_p").agg(F.sum("_n").alias("_s"))
    before = before.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_p").orderBy(value))
    return counted.join(F.broadcast(before), "_p").select(value, (F.col("_before") + inside - (F.col("_n") - 1) / 2).alias("r"))


def range_quantiles(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row of quantiles (linear) by name over a whole table: from range-split counts of values, not in one task.

    df is read three times, so give a table rather than a long computation. Nulls stay out; no values give nulls.
    """
    rows = df.select(value).where(F.col(value).isNotNull())
    n = rows.count()
    sizes = rows.groupBy(value).agg(F.count("*").alias("_c"))
    first = value_ranks(rows, value).join(sizes, value).select(value, (F.col("r") - (F.col("_c") - 1) / 2 - 1).alias("_first"))
    at = lambda place: F.max(F.when(F.col("_first") <= place, F.col(value)))
    columns = []
    for name, q in quantiles.items():
        place = max(n - 1, 0) * q
        low, high = at(int(place)), at(-int(-place // 1))
        columns.append((low + (high - low) * (place - int(place))).alias(name))
    return first.agg(*columns)


def with_ranks(df: DataFrame, *values: str) -> DataFrame:
    """df with rank_<value> of each value; df is computed once."""
    df = settled(df, "ranked")
    for v in values:
        df = df.join(value_ranks(df, v).withColumnRenamed("r", f"rank_{v}"), v)
    return df


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho); null with fewer than three finite pairs or without variance."""
    fine = df.where(f"{x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y})")
    ranked = with_ranks(fine.select(x, y), x, y)
    rho = correlation(f"rank_{x}", f"rank_{y}")
    return ranked.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, rho).alias("rho"))


def partial_spearman(df: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """One row (n, rho, rho_xy, rho_xz, rho_yz) of x and y given control."""
    ranked = with_ranks(df.select(x, y, control).dropna(), x, y, control)
    one = ranked.agg(F.count("*").alias("n"), correlation(f"rank_{x}", f"rank_{y}").alias("rho_xy"), correlation(f"rank_{x}", f"rank_{control}").alias("rho_xz"), correlation(f"rank_{y}", f"rank_{control}").alias("rho_yz"))
    below = F.sqrt((1 - F.col("rho_xz") ** 2) * (1 - F.col("rho_yz") ** 2))
    return one.select("n", F.when((F.col("n") >= 4) & (below > 0), (F.col("rho_xy") - F.col("rho_xz") * F.col("rho_yz")) / below).alias("rho"), "rho_xy", "rho_xz", "rho_yz")


def distance_fit(pairs: DataFrame, d: str = "d", t: str = "t", eps: float = 1e-12) -> DataFrame:
    """One row: relative squared deviation of t from d, least-squares scale, and distortion over positive pairs."""
    sums = pairs.agg(F.sum((F.col(d) - F.col(t)) ** 2).alias("a"), F.sum(F.col(d) ** 2).alias("b"), F.sum(F.col(d) * F.col(t)).alias("dt"), F.sum(F.col(t) ** 2).alias("tt"))
    one = sums.select(F.sqrt(F.col("a") / F.col("b")).alias("rsd"), F.when(F.col("tt") > 0, F.col("dt") / F.col("tt")).alias("scale"))
    ratio = F.col(d) / (F.col("scale") * F.col(t))
    both = pairs.where((F.col(d) > eps) & (F.col(t) > eps)).join(F.broadcast(one))
    return both.agg(F.first("rsd").alias("rsd"), F.first("scale").alias("scale"), F.count("*").alias("n"), F.max(F.greatest(ratio, 1 / ratio)).alias("max_distortion"), F.avg(F.abs(F.log(ratio))).alias("mean_log_distortion"))


def quartet_sums(quartets: DataFrame, pairs: DataFrame) -> DataFrame:
    """quartets (qid, a, b, c, d) with the three sums of opposite pairs: s_ab_cd, s_ac_bd, s_ad_bc."""
    out = quartets
    for x, y in (("a", "b"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d"), ("b", "c")):
        side = pairs.hint("merge").select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("d").cast("double").alias(f"d_{x}{y}"))
        out = out.join(side, (F.least(x, y) == F.col("_i")) & (F.greatest(x, y) == F.col("_j"))).drop("_i", "_j")
    return out.select("qid", "a", "b", "c", "d", (F.col("d_ab") + F.col("d_cd")).alias("s_ab_cd"), (F.col("d_ac") + F.col("d_bd")).alias("s_ac_bd"), (F.col("d_ad") + F.col("d_bc")).alias("s_ad_bc"))


#: Terms of the differences of two vectors' coordinates, and what is done with their sum, for distances() of named pairs.
TERMS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "cityblock": (F.abs, lambda s: s),
    "euclidean": (lambda x: x * x, F.sqrt),
}


def vector_distance(v: str, w: str, metric: str = "cityblock") -> Column:
    """The distance of two columns of vectors, summed in double over the coordinates in their order and kept as float, as
    the kernels do."""
    term, last = TERMS[metric]
    return last(F.aggregate(F.zip_with(v, w, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + term(x))).cast("float")


def quartet_sums_of(quartets: DataFrame, nodes: DataFrame, metric: str = "cityblock") -> DataFrame:
    """quartet_sums() of quartets (qid, a, b, c, d) from the vectors (id, v) of their members: six distances for each
    quartet, and no table of all pairs. Quartets with an unknown member, or one twice, have no sums."""
    out = quartets.where("a NOT IN (b, c, d) AND b NOT IN (c, d) AND c <> d")
    for name in ("a", "b", "c", "d"):
        out = out.join(nodes.select(F.col("id").alias(name), F.col("v").alias(f"v_{name}")), name)
    apart = lambda x, y: vector_distance(f"v_{x}", f"v_{y}", metric).cast("double")
    return out.select("qid", "a", "b", "c", "d", (apart("a", "b") + apart("c", "d")).alias("s_ab_cd"), (apart("a", "c") + apart("b", "d")).alias("s_ac_bd"), (apart("a", "d") + apart("b", "c")).alias("s_ad_bc"))


def four_point(sums: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per quartet: delta_q = (largest - middle) / (largest - least), half gap, and the topology of the least sum (-1: none)."""
    s = F.sort_array(F.array("s_ab_cd", "s_ac_bd", "s_ad_bc"))
    named = sums.withColumn("s", s)
    low, mid, high = (F.get("s", F.lit(n)) for n in range(3))
    least = F.array_position(F.array("s_ab_cd", "s_ac_bd", "s_ad_bc"), low).cast("int") - 1
    return named.select("qid", F.when(high > low, (high - mid) / (high - low)).otherwise(0.0).alias("delta_q"), ((high - mid) / 2).alias("half_gap"), F.when(mid - low > tolerance * high, least).otherwise(-1).alias("topology"))


def gromov(sums: DataFrame) -> DataFrame:
    """One row: n quartets and the largest half gap between the two larger sums."""
    return four_point(sums).agg(F.count("*").alias("n"), F.max("half_gap").alias("delta"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r, r2 and residual deviation of y on x; null below three rows or two values."""
    n = F.count("*")
    enough = (n >= 3) & (F.count_distinct(x) >= 2) & (F.count_distinct(y) >= 2)
    rest = F.sqrt(F.regr_syy(y, x) * (1 - F.regr_r2(y, x)) / (n - 2))
    return df.dropna(subset=[x, y]).agg(n.alias("n"), *(F.when(enough, c).alias(a) for c, a in ((F.regr_slope(y, x), "slope"), (F.regr_intercept(y, x), "intercept"), (correlation(x, y), "r"), (F.regr_r2(y, x), "r2"), (rest, "residual_sd"))))


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sd (0 for one value), se, 1.96 se, min and max by group."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    sd = F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))
    one = v.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    se = F.col("sd") / F.sqrt("n")
    return one.select(*by, "n", "mean", "sd", se.alias("se"), (1.96 * se).alias("ci95"), "min", "max")


def five_numbers(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, q1, median, q3, max (linear) and mean by group."""
    q = F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return df.groupBy(*by).agg(q.alias("q"), F.avg(value).alias("mean"), F.count(value).alias("n")).select(*by, *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))), "mean", "n")


def histogram_quantiles(df: DataFrame, value: str, low: float, high: float, quantiles: list[float], bins: int = 200) -> DataFrame:
    """(quantile, value): centres of the bins where the running count reaches a share; for values that never stop coming."""
    n_bin = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    counted = df.where(F.col(value).between(low, high)).groupBy(n_bin.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    run = counted.select("bin", (F.sum("n").over(Window.orderBy("bin")) / total).alias("share"))  # at most `bins` rows
    asked = run.withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles)))).where("share >= quantile")
    return asked.groupBy("quantile").agg(F.min("bin").alias("bin")).select("quantile", (low + (F.col("bin") + 0.5) * ((high - low) / bins)).alias("value"))


def rank_sum(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: sizes, medians, U of the first group, rank-biserial correlation, z with tie correction, two-sided p."""
    ranked = with_ranks(df.select(F.col(value), first.alias("g")).dropna(), value)
    ties = df.select(F.col(value)).dropna().groupBy(value).count().agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count")).alias("ties"))
    one = ranked.agg(F.count_if("g").cast("double").alias("n1"), F.count_if(~F.col("g")).cast("double").alias("n2"), F.sum(F.when(F.col("g"), F.col(f"rank_{value}"))).alias("r1"), F.percentile(F.when(F.col("g"), F.col(value)), F.lit(0.5)).alias("median1"), F.percentile(F.when(~F.col("g"), F.col(value)), F.lit(0.5)).alias("median2"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    found = one.join(F.broadcast(ties)).select("n1", "n2", "median1", "median2", u.alias("u"), (2 * u / (F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"), ((u - F.col("n1") * F.col("n2") / 2) / sd).alias("z"))
    return found.withColumn("p", normal_tail(F.abs("z")) * 2)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by a published rational approximation (absolute error below 7.5e-8); its constants are fixed."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series


def stratified_rank_sum(df: DataFrame, value: str, first: Column, stratum: str) -> DataFrame:
    """One row (n_strata, z, p): van Elteren's test, ranks within strata weighted by 1 / (size + 1)."""
    ranked = df.select(stratum, F.col(value), first.cast("int").alias("g"), average_rank(value, stratum).alias("r"), F.count("*").over(Window.partitionBy(stratum)).alias("n"))
    parts = ranked.groupBy(stratum).agg(F.max("n").alias("n"), F.sum("g").alias("m"), F.sum(F.col("g") * F.col("r")).alias("w"), F.var_pop("r").alias("v"))
    parts = parts.where((F.col("m") > 0) & (F.col("m") < F.col("n")))
    expected, variance = F.col("m") * (F.col("n") + 1) / 2, F.col("m") * (F.col("n") - F.col("m")) / (F.col("n") - 1) * F.col("v")
    weight = 1 / (F.col("n") + 1)
    one = parts.agg(F.count("*").alias("n_strata"), (F.sum(weight * (F.col("w") - expected)) / F.sqrt(F.sum(weight**2 * variance))).alias("z"))
    return one.withColumn("p", 2 * normal_tail(F.abs("z")))


def standardized_difference(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row (smd): difference of means over the root of the mean of both variances."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    return df.agg(((F.avg(a) - F.avg(b)) / F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)).alias("smd"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, ari) of two partitions, from their contingency table."""
    two = lambda c: F.sum(c * (c - 1) / 2)
    n = F.col("n").cast("double")
    cells = contingency(df, a, b).agg(two(n).alias("cells"), F.sum("n").alias("n"))
    rows, columns = (df.groupBy(c).count().agg(two(F.col("count").cast("double")).alias(t)) for c, t in ((a, "rows"), (b, "columns")))
    one = cells.join(F.broadcast(rows)).join(F.broadcast(columns))
    every = F.col("n") * (F.col("n") - 1) / 2
    expected, most = F.col("rows") * F.col("columns") / every, (F.col("rows") + F.col("columns")) / 2
    return one.select("n", F.when(most != expected, (F.col("cells") - expected) / (most - expected)).otherwise(1.0).alias("ari"))


def best_mapping(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label, n): one label for each cluster so that most rows agree; exact, over subsets of at most 16 labels.

    The contingency table of few clusters and labels comes to the driver, no rows do.
    """
    cells = {(r[cluster], r[label]): r["n"] for r in contingency(df, cluster, label).collect()}
    clusters, labels = (sorted({k[i] for k in cells}) for i in (0, 1))
    if len(labels) > 16 or len(clusters) > len(labels):
        raise ValueError("an exact mapping needs at most 16 labels, and no fewer than clusters")
    best: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}
    for c in clusters:
        after: dict[int, tuple[int, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for i, name in enumerate(labels):
                if not used >> i & 1:
                    t = (total + cells.get((c, name), 0), (*chosen, i))
                    key = used | 1 << i
                    if key not in after or t[0] > after[key][0] or (t[0] == after[key][0] and t[1] < after[key][1]):
                        after[key] = t
        best = after
    chosen = max(best.values(), key=lambda t: (t[0], [-x for x in t[1]]))[1]
    rows = [(c, labels[i], cells.get((c, labels[i]), 0)) for c, i in zip(clusters, chosen, strict=True)]
    types = dict(df.dtypes)
    return df.sparkSession.createDataFrame(rows, f"{cluster} {types[cluster]}, {label} {types[label]}, n bigint")


def paired_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row of y - x: n, median, signs, sign-test z, and the signed-rank sum with its z (ties at mean ranks, zeros out)."""
    moved = df.select((F.col(y) - F.col(x)).alias("delta")).dropna()
    some = moved.where("delta <> 0").select("delta", F.abs("delta").alias("size"))
    ranked = with_ranks(some, "size")
    ties = some.groupBy("size").count().agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count")).alias("ties"))
    ranks = ranked.agg(F.count("*").cast("double").alias("m"), F.count_if(F.col("delta") > 0).cast("double").alias("up"), F.sum(F.when(F.col("delta") > 0, F.col("rank_size")).otherwise(0.0)).alias("w"))
    m = F.col("m")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    whole = moved.agg(F.count("*").alias("n"), F.percentile("delta", F.lit(0.5)).alias("median"))
    return whole.join(F.broadcast(ranks)).join(F.broadcast(ties)).select("n", "median", "m", "up", ((2 * F.col("up") - m) / F.sqrt(m)).alias("sign_z"), "w", ((F.col("w") - m * (m + 1) / 4) / sd).alias("z"))


def fisher_tail(a: int, b: int, c: int, d: int) -> float:
    """P(first cell <= a) of a 2 x 2 table with these margins, exactly; four counts, no rows."""
    row, column, n = a + b, a + c, a + b + c + d
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    low = max(0, column - (n - row))
    return min(1.0, sum(math.exp(choose(row, k) + choose(n - row, column - k) - choose(n, column)) for k in range(low, a + 1)))


def quantile_strata(df: DataFrame, value: str, bins: int) -> DataFrame:
    """df with stratum: 0 for exact zeros, else 1..bins by quantiles (linear) of what is positive."""
    edges = df.where(F.col(value) > 0).agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges"))
    above = F.size(F.filter("edges", lambda e: F.col(value) > e))
    return df.join(F.broadcast(edges)).withColumn("stratum", F.when(F.col(value) == 0, 0).otherwise(1 + above)).drop("edges")


def saturation(curve: DataFrame, x: str, y: str, *by: str, share: float = 0.95) -> DataFrame:
    """(by, last, x_at): the value at the largest x, and the first x where the curve has reached a share of it."""
    ends = curve.groupBy(*by).agg(F.max_by(y, x).alias("last"))
    return curve.join(ends, list(by)).groupBy(*by).agg(F.first("last").alias("last"), F.min(F.when(F.col(y) >= share * F.col("last"), F.col(x))).alias("x_at"))


def nearest_match(df: DataFrame, value: str, first: str, key: str, *by: str, caliper: float | None = None) -> DataFrame:
    """(by, key, match, gap): for each row of the first group, in the order of key, the nearest row of the others that is
    still free, ties to the smaller key; rows without a value match nothing.

    Strata are matched in different tasks; within one the order matters. Rows that are taken are skipped by pointers, so
    a stratum costs about as much as sorting it.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), f"`{key}` {types[key]}, match {types[key]}, gap double"])

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame[value].notna()]
        chosen = frame[first].fillna(False).astype(bool)
        own, free = frame[chosen].sort_values(key), frame[~chosen].sort_values([value, key])
        values, keys = free[value].to_numpy(float), free[key].to_numpy()
        n = len(values)
        after, before = list(range(n + 1)), list(range(n + 1))  # before is shifted by one: 0 is none

        def follow(pointers: list[int], at: int) -> int:
            while pointers[at] != at:
                pointers[at] = pointers[pointers[at]]
                at = pointers[at]
            return at

        rows = []
        for k, v in zip(own[key], own[value].astype(float), strict=True):
            place = int(values.searchsorted(v))
            above, below = follow(after, place), follow(before, place) - 1
            found = [(values[above] - v, keys[above], above)] if above < n else []
            if below >= 0:  # the smallest key that is free with this value
                below = follow(after, int(values.searchsorted(values[below])))
                found.append((v - values[below], keys[below], below))
            if found and (caliper is None or min(found)[0] <= caliper):
                gap, name, i = min(found)
                after[i], before[i + 1] = i + 1, i
                rows.append((*(frame[c].iloc[0] for c in by), k, name, gap))
        return pd.DataFrame(rows, columns=[*by, key, "match", "gap"])

    return df.groupBy(*by).applyInPandas(match, schema)


def bootstrap_means(df: DataFrame, value: str, key: str, replicates: int, *by: str, level: float = 0.95) -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean over Poisson resamples.

    A row's weight in a replicate is a Poisson number from the hash of its key, so nothing is drawn twice and the
    replicates are partial sums.
    """
    draws = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    u = F.pmod(F.xxhash64(key, "k"), F.lit(1 << 30)) / float(1 << 30)
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(8)]
    weight = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda t, s: t + F.when(F.col("u") > s, 1).otherwise(0))
    rows = df.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("v")).withColumn("k", draws).withColumn("u", u).withColumn("w", weight)
    means = rows.groupBy(*by, "k").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    ends = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    whole = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return whole.join(ends, list(by)).select(*by, "mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
