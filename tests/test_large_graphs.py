"""Farthest-first orders, structural audits and resamples without tables of pairs, edges or replicates."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from isopanel.operators import analytics as A
from isopanel.operators import comparison as C
from isopanel.operators import distance as D
from isopanel.operators import exact as X
from isopanel.operators import graphs as G
from isopanel.operators import structure as R
from isopanel.operators import temporal as M
from isopanel.operators.within import Within


def vectors(spark, n=60):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (n, 3)).astype(float)  # many ties and copies
    return spark.createDataFrame([(int(i), v) for i, v in zip(rng.permutation(n), x.tolist(), strict=True)], "id bigint, v array<double>").localCheckpoint()


def test_farthest_first_without_pairs(spark, monkeypatch):
    nodes = vectors(spark)
    monkeypatch.setattr(A, "PICKED_AMONG", 25)
    assert sorted(A.farthest_first_of(nodes).collect()) == sorted(A.farthest_first(nodes, D.pairwise(nodes)).collect())


def test_stages_and_hubs_without_edges(spark):
    nodes = vectors(spark, 40)
    names, edges, graph = nodes.select(F.col("id").alias("node")), G.tau_graph(nodes, 1.0).localCheckpoint(), Within(nodes, 1.0, block=16)
    records = nodes.select(F.col("id").alias("node"), F.col("id").alias("record"), F.lit("a").alias("lineage"), F.lit("2024-01-01").cast("date").alias("day"))
    assert sorted(R.stages_within(graph).collect()) == sorted(R.stages(names, edges).collect())
    assert sorted(R.hub_records(names, graph, records).collect()) == sorted(R.hub_records(names, edges, records).collect())


def test_bootstrap_medians_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(X, "RANGE_WEIGHTS", 20)
    values = [1.0, 1.0, 1.0, 2.0, 2.0, 5.0, 7.0, 7.0, 9.0, 11.0] * 4
    rows = spark.createDataFrame(list(enumerate(values)), "key bigint, x double")

    def weight(key, k):
        return sum(p < int(hashlib.md5(f"{key}-{k}".encode()).hexdigest()[:8], 16) / 2**32 for p in X.POISSON)

    def median(k):
        drawn = sorted(x for key, x in enumerate(values) for _ in range(weight(key, k) if k else 1))
        return float(np.median(drawn))

    found = X.bootstrap_medians(rows, "x", "key", 6).first()
    low, high = np.quantile([median(k) for k in range(1, 7)], [0.025, 0.975])
    assert (found["n"], found["median"]) == (len(values), median(0))
    assert np.allclose([found["low"], found["high"]], [low, high])


def test_densest_nodes_are_all_of_them_by_few_cuts(monkeypatch):
    from isopanel.operators import flows

    cuts = []
    whole = flows.Network.source_side
    monkeypatch.setattr(flows.Network, "source_side", lambda self, *ends: cuts.append(ends) or whole(self, *ends))
    # two equal cliques and a tail: both are in the answer
    clique = [(i, j) for i in range(4) for j in range(i)]
    a, b = np.array(clique + [(i + 4, j + 4) for i, j in clique] + [(0, 8), (8, 9)]).T
    assert flows.densest_nodes(a, b, 10) == set(range(8)) and len(cuts) <= 4


def test_geodesics_are_summed_where_they_are(spark):
    """Moments, reach and fits by root against the table of all geodesics, with nodes alone and without a date."""
    rng = np.random.default_rng(2)
    ends = {tuple(sorted(map(int, rng.choice(30, 2, replace=False) + (0 if n % 2 else 100)))) for n in range(60)}
    edges = spark.createDataFrame([(a, b, float(1 + (3 * a + b) % 5)) for a, b in ends], "source long, target long, weight float").localCheckpoint()
    nodes = spark.createDataFrame([(n,) for n in [*range(30), *range(100, 130), 500]], "node long")
    members = A.membership(nodes, edges).localCheckpoint()
    table = A.geodesics(edges, nodes.select(F.col("node").alias("root"))).localCheckpoint()
    want = table.groupBy("root").agg(F.count("*"), F.max("distance"), F.round(F.avg("distance"), 9))
    got = A.eccentricities(edges, nodes).withColumn("mean", F.round("mean", 9))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and want.count() == 61
    assert C.reach_check_of(A.reach_counts(edges, members), members).first() == C.reach_check(table, members).first()
    wrong = members.withColumn("component", F.when(F.col("node") == 5, -1).otherwise(F.col("component")))
    assert C.reach_check_of(A.reach_counts(edges, wrong), wrong).first() == C.reach_check(table, wrong).first()
    dates = nodes.where("node % 7 <> 0").select("node", F.date_from_unix_date((F.col("node") * 13 % 41).cast("int")).alias("day"))
    best, first = M.best_fit(A.date_fits(edges, nodes, dates)).first(), M.best_root(table, dates).first()
    assert best["root"] == first["root"] and abs(best["r"] - first["r"]) < 1e-9
