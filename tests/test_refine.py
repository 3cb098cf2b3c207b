import json
import math

import numpy as np
import pandas as pd
import pytest

from isopanel.operators import analytics as A
from isopanel.operators import refine
from isopanel.operators import stats as S
from isopanel.operators import temporal as M
from isopanel.sources.fasta import parse_tree_json
from pyspark.sql import functions as F


def test_directional_filter_on_a_cross(spark):
    """Three neighbours in one direction and one across: the one across has the least in common and goes first."""
    points = {0: (0, 0), 1: (1, 0), 2: (2, 0.1), 3: (3, -0.1), 4: (0, 1), 5: (4, 0.05)}
    vectors = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in points.items()], "id long, v array<double>")
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 6)], "source long, target long, weight double")
    rows = refine.directional_evaluations(vectors, star, share=0.5).where("node = 0").orderBy("candidate_rank").collect()
    unit = np.array([points[i] for i in range(1, 6)], float)
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    alike = np.abs(unit @ unit.T) - np.eye(5)
    assert rows[0]["neighbour"] == 4 and rows[0]["mean_before"] == pytest.approx(alike.sum() / 20) and rows[0]["accepted"]
    assert len(rows) == 2 and not rows[1]["accepted"]


def test_directional_scores_are_taken_among_those_left(spark):
    rng = np.random.default_rng(4)
    points = np.vstack([np.zeros(3), rng.normal(size=(24, 3)) + [3, 0, 0]])
    points[20:] -= [3, 0, 0]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 25)], "source long, target long, weight double")
    got = refine.directional_evaluations(vectors, star, share=0.3).where("node = 0").orderBy("candidate_rank").collect()
    unit = {i: p / np.linalg.norm(p) for i, p in enumerate(points) if i}
    score = lambda i, among: sum(abs(float(unit[i] @ unit[j])) for j in among if j != i) / (len(among) - 1)
    left, want = list(unit), []
    for rank, i in enumerate(sorted(unit, key=lambda i: (score(i, unit), i))[: math.ceil(0.3 * 24)], 1):
        own, before = score(i, left), sum(score(j, left) for j in left) / len(left)
        left.remove(i)
        after = sum(score(j, left) for j in left) / len(left)
        want.append((i, rank, rank / 24, own, before, after, (after - before) / before >= 0.01))
        if not want[-1][-1]:
            break
    assert sum(w[-1] for w in want) >= 2
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert (r["neighbour"], r["candidate_rank"], r["accepted"]) == (w[0], w[1], w[6])
        assert (r["rank_fraction"], r["score"], r["mean_before"], r["mean_after"]) == pytest.approx(w[2:6])


def test_common_component(spark):
    """What one graph cuts off splits another; the result is the same in either order."""
    rng = np.random.default_rng(7)
    graphs = [sorted({tuple(sorted(p)) for p in rng.integers(0, 40, (n, 2)).tolist() if p[0] != p[1]}) for n in (42, 46)]

    def largest(nodes, edges):
        up = {x: x for x in nodes}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a in up and b in up:
                a, b = sorted((root(a), root(b)))
                up[b] = a
        parts = {}
        for x in nodes:
            parts.setdefault(root(x), set()).add(x)
        return max(parts.items(), key=lambda p: (len(p[1]), -p[0]))[1]

    want, rounds = set(range(40)), 0
    while True:
        kept = want & largest(want, graphs[0]) & largest(want, graphs[1])
        if kept == want:
            break
        want, rounds = kept, rounds + 1
    assert rounds > 1
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    frames = [spark.createDataFrame([(*p, 1.0) for p in g], "source long, target long, weight double") for g in graphs]
    for order in (frames, frames[::-1]):
        assert {r["node"] for r in A.common_component(nodes, order).collect()} == want
    with pytest.raises(ValueError):
        A.common_component(nodes.limit(0), frames)


def test_deletion_keeps_components(spark):
    rng = np.random.default_rng(1)
    e = sorted({tuple(sorted(p)) for p in rng.integers(0, 30, (80, 2)).tolist() if p[0] != p[1]})
    edges = spark.createDataFrame([(*p, 1.0) for p in e], "source long, target long, weight double")
    queue = spark.createDataFrame([(*p, i + 1) for i, p in enumerate(e[::2])], "source long, target long, position int")
    kept = refine.delete_safely(edges, queue)
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    assert sorted(A.membership(nodes, kept).collect()) == sorted(A.membership(nodes, edges).collect())
    up = list(range(30))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    want = set(e[1::2])
    for a, b in want:
        up[root(a)] = root(b)
    for a, b in reversed(e[::2]):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.add((a, b))
    assert {(r["source"], r["target"]) for r in kept.collect()} == want


def test_layout_of_a_path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node long")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "source long, target long, weight double")
    rows = refine.spectral_layout(nodes, edges).orderBy("node").collect()
    assert [r["rank"] for r in rows] in ([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0])


def test_layout_of_many_nodes(spark):
    """More nodes than a dense eigenproblem has; with vectors one by one as with a matrix."""
    rng = np.random.default_rng(3)
    n = 5_200
    source, target = np.concatenate([np.arange(n), rng.integers(0, n, n)]), np.concatenate([(np.arange(n) + 1) % n, rng.integers(0, n, n)])
    ends = {(min(a, b), max(a, b)) for a, b in zip(source.tolist(), target.tolist(), strict=True) if a != b}
    edges = spark.createDataFrame([(a, b, 1.0 + (a + b) % 7) for a, b in sorted(ends)], "source long, target long, weight double")
    rows = refine.spectral_layout(spark.range(n).withColumnRenamed("id", "node"), edges).orderBy("node").toPandas()
    x = rows["x"].to_numpy()
    applied = np.zeros(n)
    for a, b in ends:
        applied[[a, b]] += (1.0 + (a + b) % 7) * np.array([x[a] - x[b], x[b] - x[a]])
    assert np.abs(applied - (x @ applied) * x).max() < 1e-9 and abs(x.sum()) < 1e-9 and abs(x @ x - 1) < 1e-9
    assert rows["rank"].to_numpy()[x.argmin()] == 0 and rows["rank"].to_numpy()[x.argmax()] == n - 1
    half = pd.DataFrame([(a, b, 1.0) for i in range(299) for a, b in ((i, i + 1), (i + 1, i))], columns=["node", "neighbour", "weight"])
    graph = A.Csr(half)
    assert np.allclose(np.abs(refine.sparse_vectors(graph, many=20)), np.abs(refine.dense_vectors(graph)), atol=1e-9)


def test_small_tests(spark):
    assert S.fisher_tail(1, 9, 11, 3) == pytest.approx(1.379728e-3, rel=1e-4)
    df = spark.createDataFrame([(1, True, 1.0), (2, True, 1.1), (3, False, 1.05), (4, False, 9.0), (5, True, 50.0)], "k long, g boolean, v double").withColumn("s", F.lit("x"))
    got = sorted((r["k"], r["match"]) for r in S.nearest_match(df, "v", "g", "k", "s", caliper=10.0).collect())
    assert got == [(1, 3), (2, 4)]
    assert math.isclose(sum(math.comb(3, k) for k in range(4)), 8)


def test_local_shuffle_stays_near(spark):
    dates = spark.range(40).select(F.col("id").alias("node"), F.date_from_unix_date((F.col("id") % 9).cast("int")).alias("day"))
    moved = M.locally_shuffled(dates, 3, 2).join(dates.withColumnRenamed("day", "own"), "node")
    assert moved.where(F.abs(F.datediff("day", "own")) > 2).count() == 0 and moved.count() == 120
    assert moved.where("day <> own").count() > 0


def test_tree_json():
    tree = {"tree": {"name": "r", "node_attrs": {"div": 1.0}, "children": [{"name": "a", "node_attrs": {"div": {"value": 3}}}, {"name": "b", "branch_length": 2, "children": [{"name": "c"}]}]}}
    assert parse_tree_json(json.dumps(tree)) == [(0, None, 0.0, 1.0, "r"), (1, 0, 2.0, 3.0, "a"), (2, 0, 2.0, 3.0, "b"), (3, 2, 0.0, 3.0, "c")]


def test_exact_densest_subgraph():
    from itertools import combinations

    from isopanel.operators.flows import densest_nodes

    rng = np.random.default_rng(5)
    for _ in range(6):
        n = 9
        e = np.array([p for p in combinations(range(n), 2) if rng.random() < 0.4] or [(0, 1)])
        dense = lambda s: sum(a in s and b in s for a, b in e.tolist()) / len(s)
        best = max(dense(set(s)) for k in range(1, n + 1) for s in combinations(range(n), k))
        assert dense(densest_nodes(e[:, 0], e[:, 1], n)) == pytest.approx(best)


def test_bootstrap(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v"), F.lit("g").alias("g"))
    one = S.bootstrap_means(df, "v", "id", 60, "g").first()
    assert one["low"] < one["mean"] < one["high"] < one["low"] + 1
