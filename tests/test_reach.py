"""Dates in balls of small quantiles against the table of all geodesics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from isopanel.operators import analytics as A
from isopanel.operators import temporal as M
from isopanel.operators.reach import Reach


def graph(spark, whole):
    rng = np.random.default_rng(4)
    ends = {tuple(sorted(p)) for p in rng.integers(0, 45, (70, 2)).tolist() if p[0] != p[1]} | {(50, 51), (51, 52)}
    weight = (lambda: float(rng.integers(0, 4))) if whole else (lambda: float(rng.uniform(1, 3)))
    edges = spark.createDataFrame([(a, b, weight()) for a, b in sorted(ends)], "source bigint, target bigint, weight double").localCheckpoint()
    nodes = spark.range(0, 60).select(F.col("id").alias("node")).localCheckpoint()  # some have no edge
    dates = nodes.where("node % 5 <> 2").select("node", F.expr("date_add(DATE '2024-01-01', cast(pmod(xxhash64(node), 40) as int))").alias("day"))
    return nodes, edges, dates.unionByName(spark.sql("SELECT CAST(2 AS BIGINT) AS node, CAST(NULL AS DATE) AS day")).localCheckpoint()


def by_table(nodes, edges, dates, quantiles):
    found = A.geodesics(edges, nodes.select(F.col("node").alias("root"))).localCheckpoint()
    radii = A.quantile_radii(found, quantiles)
    spread = M.ball_spread(A.balls(found, radii), dates).where("n_dated > 0").collect()
    return sorted((radii.index(r["radius"]) + 1, r["center"], r["mean_gap"]) for r in spread)


@pytest.mark.parametrize("whole", [False, True])
def test_spread_without_a_table_of_distances(spark, whole):
    nodes, edges, dates = graph(spark, whole)
    quantiles = [0.02, 0.4] if whole else [0.02, 0.1]
    assert sorted(tuple(r) for r in Reach(nodes, edges).spread(dates, quantiles).collect()) == by_table(nodes, edges, dates, quantiles)


def test_a_wrong_guess_changes_the_time_only(spark, monkeypatch):
    nodes, edges, dates = graph(spark, False)
    monkeypatch.setattr(Reach, "intervals", lambda self, quantiles: [(5.0, 5.5), (0.1, 0.2)])
    assert sorted(tuple(r) for r in Reach(nodes, edges).spread(dates, [0.02, 0.1]).collect()) == by_table(nodes, edges, dates, [0.02, 0.1])


def test_walks_end_at_the_bound(spark):
    _, edges, _ = graph(spark, False)
    csr = A.broadcast_graph(edges)
    roots = np.arange(5)
    whole = csr.within(roots)
    assert (whole == csr.distances(roots)).all()
    assert (csr.within(roots, 4.0) == np.where(whole <= 4.0, whole, np.inf)).all()


def test_query_writes_no_geodesics(spark, monkeypatch):
    monkeypatch.setattr(A, "geodesics", None)
    assert __spark_entry__.queries()["center_date_correlations"](spark, "/root/testdata/sf0.001").count() == 2


@pytest.mark.parametrize("whole", [False, True])
def test_ball_sizes_without_a_table_of_distances(spark, whole):
    nodes, edges, _ = graph(spark, whole)
    quantiles = [0.05, 0.25, 0.5]
    found = A.geodesics(edges, nodes.select(F.col("node").alias("root"))).localCheckpoint()
    radii = A.quantile_radii(found, quantiles)
    want = [(r["center"], radius, r["count"]) for radius in radii for r in found.where(F.col("distance") <= radius).groupBy(F.col("root").alias("center")).count().collect()]
    assert sorted(tuple(r) for r in Reach(nodes, edges).sizes(quantiles).collect()) == sorted(want) and len(want) == 180
    assert Reach(nodes, edges.limit(0)).sizes(quantiles).count() == 0
