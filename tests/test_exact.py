import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopanel.operators import exact


def test_tails(spark):
    """Against sums of binomials, and closed forms for one and two degrees of freedom."""
    close = lambda x, rel=1e-8, abs=1e-14: pytest.approx(x, rel=rel, abs=abs)
    cases = [(exact.sign_tail(F.lit(k), F.lit(n)), close(sum(math.comb(n, i) for i in range(k + 1)) / 2**n)) for n in (1, 10, 4000) for k in (0, n // 3, n)]
    cases.append((exact.sign_tail(F.lit(50_100), F.lit(100_000)), pytest.approx(0.7375, abs=1e-3)))
    for t in (0.0, 1.0, 40.0):
        cases.append((exact.student_tail(F.lit(t), F.lit(1)), close(0.5 - math.atan(t) / math.pi, 1e-7, 1e-12)))
        cases.append((exact.student_tail(F.lit(t), F.lit(2)), close(0.5 - t / (2 * math.sqrt(2 + t * t)), 1e-7, 1e-12)))
    normal = math.erfc(1.96 / math.sqrt(2)) / 2
    cases += [(exact.student_tail(F.lit(1.96), F.lit(v)), pytest.approx(normal, rel=1e-3)) for v in (10_000, 30_000)]
    cases += [(exact.log_gamma(F.lit(z)), pytest.approx(math.lgamma(z), abs=1e-10)) for z in (0.2, 0.5, 1.0, 7.5, 300.0)]
    got = [r["x"] for r in spark.range(1).select(F.explode(F.array(*(c for c, _ in cases))).alias("x")).collect()]
    assert got == [want for _, want in cases]


def mid_ranks(values):
    return [sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values]


def rank_sum_p(a, b):
    ranks = mid_ranks(a + b)
    w = sum(ranks[: len(a)])
    sums = [sum(c) for c in itertools.combinations(ranks, len(a))]
    return min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))


def signed_rank_p(deltas):
    some = [d for d in deltas if d]
    ranks = mid_ranks([abs(d) for d in some])
    w = sum(r for r, d in zip(ranks, some, strict=True) if d > 0)
    sums = [sum(r for r, up in zip(ranks, ups, strict=True) if up) for ups in itertools.product((0, 1), repeat=len(some))]
    return w, min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))


def test_small_groups_by_enumeration(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in [*range(25), None]:
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(1, 6))] for _ in range(2))
        rows += [(g, float(v), first, "z") for side, first in ((a, True), (b, False)) for v in side]
        want[g] = rank_sum_p(a, b)
    rows += [(100, 1.0, True, "z"), (100, None, False, "z"), (101, 2.0, True, "z"), (101, 2.0, False, "z")]
    df = spark.createDataFrame(rows, "g int, v double, first boolean, p string").repartition(5)
    found = {r["g"]: r for r in exact.rank_sum_tests(df, "v", F.col("first"), "g").collect()}
    for g, p in want.items():
        assert found[g]["exact"] and found[g]["p"] == pytest.approx(p)
    assert found[100]["p"] is None and found[101]["p"] == 1 and len(found) == 28
    assert exact.rank_sum_tests(df.limit(0), "v", F.col("first"), "g").count() == 0
    deltas = {g: [rng.randint(-4, 4) for _ in range(rng.randint(1, 10))] for g in range(20)} | {50: [0, 0], 51: [3]}
    df = spark.createDataFrame([(g, float(d)) for g, ds in deltas.items() for d in ds], "g int, d double")
    for r in exact.signed_rank_tests(df, "d", "g").collect():
        some = [d for d in deltas[r["g"]] if d]
        assert r["n"] == len(deltas[r["g"]]) and r["n_positive"] == sum(d > 0 for d in some)
        if some:
            w, p = signed_rank_p(some)
            k = min(r["n_positive"], r["n_negative"])
            assert (r["w"], r["p"]) == (w, pytest.approx(p)) and r["sign_p"] == pytest.approx(min(1, 2 * sum(math.comb(len(some), i) for i in range(k + 1)) / 2 ** len(some)))
        else:
            assert r["p"] is None and r["sign_p"] is None and not r["exact"]


def test_large_groups_are_normal(spark):
    rng = random.Random(6)
    a, b = ([rng.gauss(m, 1) for _ in range(60)] for m in (0, 0.4))
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "v double, first boolean")
    r = exact.rank_sum_tests(df, "v", F.col("first")).first()
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    z = (abs(u - 1800) - 0.5) / math.sqrt(3600 * 121 / 12)
    assert not r["exact"] and r["u"] == u and r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


@pytest.mark.parametrize(("n1", "n2", "digits", "block", "few"), [(1, 1, 3, 4, 10), (7, 4, 0, 3, 5), (150, 90, 1, 8, 50), (201, 150, 9, 16, 40), (60, 60, 0, 64, 2)])
def test_shift(spark, monkeypatch, n1, n2, digits, block, few):
    rng = random.Random(n1)
    a, b = [round(rng.gauss(0, 5), digits) for _ in range(n1)], [round(rng.gauss(2, 3) * (1e6 if i % 7 == 0 else 1), digits) for i in range(n2)]
    pack = exact._packed

    def small(batches):  # tasks have the module as it is written
        exact.BLOCK = block
        yield from pack(batches)

    monkeypatch.setattr(exact, "_packed", small)
    monkeypatch.setattr(exact, "CANDIDATES", few)
    monkeypatch.setattr(exact, "PROBES", 15)
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b] + [(None, True), (float("nan"), False), (1.0, None)], "v double, first boolean").repartition(3)
    r = exact.shift(df, "v", F.col("first")).first()
    assert (r["n1"], r["n2"]) == (n1, n2) and r["shift"] == np.median(np.subtract.outer(a, b))


def test_shift_of_nothing(spark):
    df = spark.createDataFrame([(1.0, True)], "v double, first boolean")
    assert tuple(exact.shift(df, "v", F.col("first")).first()) == (1, 0, None)
    assert tuple(exact.shift(df.limit(0), "v", F.col("first")).first()) == (0, 0, None)


def test_floats_keep_their_order():
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, np.inf])
    keys = exact._ordered(x)
    assert np.all(np.diff(keys) > 0) and np.array_equal(exact._floats(keys.tolist()), x)


def test_bootstrap_medians(spark):
    rng = random.Random(9)
    rows = [("a" if i % 3 else None, i, float(rng.randint(0, 30)), "m") for i in range(400)] + [("b", 1000, 5.0, "m"), ("c", 1001, None, "m")]
    df = spark.createDataFrame(rows, "g string, id int, v double, median string").repartition(4)
    found = {r["g"]: r for r in exact.bootstrap_medians(df, "v", "id", 60, "g").collect()}
    assert set(found) == {"a", None, "b"} and found["b"]["median"] == found["b"]["low"] == found["b"]["high"] == 5.0
    weights = {(r["id"], r["k"]): r["w"] for r in df.select("id", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("k")).withColumn("w", exact.hashed_weight(F.col("id"), F.col("k"))).collect()}
    assert 0.97 < sum(weights.values()) / len(weights) < 1.03
    for g in ("a", None):
        own = [(i, v) for h, i, v, _ in rows if h == g]
        medians = [np.median([v for i, v in own for _ in range(weights[i, k])]) for k in range(1, 61)]
        low, high = np.percentile(medians, [2.5, 97.5])
        assert (found[g]["n"], found[g]["median"], found[g]["low"], found[g]["high"]) == (len(own), np.median([v for _, v in own]), pytest.approx(low), pytest.approx(high))
