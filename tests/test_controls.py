import hashlib

import numpy as np
import pytest

from isopanel.operators import controls as C
from pyspark.sql import functions as F


def played(edges, rejected, removed, per_end, caliper=0.1, seed=0):
    """Turn by turn."""
    weight = {(s, t): w for s, t, w in edges}
    turns = sorted((e for e in set(removed) if e in weight), key=lambda e: (hashlib.md5(f"{seed}-{e[0]}-{e[1]}".encode()).hexdigest(), e))
    at, used, out = {}, set(), []
    for e in weight:
        if e not in rejected and e not in removed:
            at.setdefault(e[0], []).append((e[1], e))
            at.setdefault(e[1], []).append((e[0], e))
    for i, e in enumerate(turns):
        for side, node in enumerate(e):
            free = sorted((abs(weight[c] - weight[e]), p, c) for p, c in at.get(node, []) if c not in used)[:per_end]
            for gap, partner, c in free:
                used.add(c)
                fine = weight[e] == weight[c] if 0 in (weight[e], weight[c]) else gap <= caliper * weight[e]
                out.append((*e, 2 * i + side, node, partner, *c, gap, fine))
    return sorted(out)


def asked(spark, edges, rejected, removed, per_end):
    table = spark.createDataFrame(edges, "source long, target long, weight double")
    pairs = lambda rows: spark.createDataFrame(list(rows), "source long, target long")
    rows = C.control_edges(table, pairs(rejected), pairs(removed), per_end).collect()
    assert all((r["role"] == "source") == (r["shared"] == r["source"]) for r in rows)
    return sorted((r["source"], r["target"], r["turn"], r["shared"], r["partner"], r["c_source"], r["c_target"], r["gap"], r["within"]) for r in rows)


@pytest.mark.parametrize("per_end, levels", [(1, 1000), (2, 4)])
def test_controls_are_those_of_turns(spark, per_end, levels):
    """A hub with half of all edges, weights that are mostly ties at four levels, zero weights among them."""
    rng = np.random.default_rng(per_end)
    pairs = {(0, i) for i in range(1, 90)} | {tuple(sorted(p)) for p in rng.integers(1, 90, (90, 2)).tolist() if p[0] != p[1]}
    edges = [(s, t, float(rng.integers(0, levels)) / levels) for s, t in sorted(pairs)]
    kind = rng.random(len(edges))
    removed = {e[:2] for e, k in zip(edges, kind, strict=True) if k < 0.35}
    rejected = {e[:2] for e, k in zip(edges, kind, strict=True) if 0.3 < k < 0.5}
    want = played(edges, rejected, removed, per_end)
    assert len(want) > 50
    assert asked(spark, edges, rejected, removed, per_end) == want


def test_controls_of_odd_tables(spark):
    assert asked(spark, [], [], [(1, 2)], 1) == []
    edges = [(1, 2, 1.0), (1, 2, 1.0), (1, 3, None), (1, 4, float("nan")), (1, 5, 2.0), (6, 7, 1.0)]
    got = asked(spark, edges, [], [(1, 2), (1, 2), (8, 9), (6, 7)], 3)
    assert [(*r[:2], *r[3:]) for r in got] == [(1, 2, 1, 5, 1, 5, 1.0, False)]


def test_caliper(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 0.1), (1.0, 0.0), (1.0, 1.05), (1.0, 1.2)], "a double, b double")
    assert [r[0] for r in rows.select(C.within_caliper(F.col("a"), F.col("b"), 0.1)).collect()] == [True, False, False, True, False]


def test_tables_and_contrasts(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.1), (2, 3, 5.0), (3, 4, 2.0)], "source long, target long, weight double")
    pairs = lambda rows: spark.createDataFrame(rows, "source long, target long")
    removed, rejected = pairs([(1, 2)]), pairs([(1, 2), (3, 4)])
    controls = C.control_edges(edges, rejected, removed)
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "node long, label string")
    dates = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-04"), (3, "2024-01-02")], "node long, day string").withColumn("day", F.to_date("day"))
    other = spark.createDataFrame([(2, 1, 7.0), (1, 3, 3.0)], "i long, j long, d double")
    table = C.edge_table(edges, rejected, removed, controls, labels, dates, other)
    got = {(r["source"], r["target"]): tuple(r)[2:] for r in table.collect()}
    assert got[1, 2] == (1.0, "removed", "removed", 7.0, 3, True, 2, 2)
    assert got[1, 3] == (1.1, "retained", "control", 3.0, 1, False, 2, 3)
    assert got[3, 4] == (2.0, "kept_for_connection", "none", None, None, None, 1, 3)
    found = {r["metric"]: tuple(r)[1:] for r in C.matched_contrasts(table, controls, ["other", "day_gap"]).collect()}
    assert found["other"] == (1, 7.0, 3.0, 4.0, 1, 0, 0)
    assert found["day_gap"] == (1, 3.0, 1.5, 1.5, 1, 0, 0)
