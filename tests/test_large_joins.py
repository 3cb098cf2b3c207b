"""Queries over all pairs that must not make, send or join a table of them; and steps whose size Spark takes for small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopanel.operators import cluster as K
from isopanel.operators import comparison as C
from isopanel.operators import distance as D
from isopanel.operators import graphs as G
from isopanel.operators import pairs as P
from isopanel.operators import stats as S
from isopanel.operators import temporal as M
from isopanel.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 vectors of three labels, two of them alike, and events of all but two of them."""
    path, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(1)
    values = rng.normal(size=(60, 8)).astype(np.float32)
    values[7] = values[3]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    events = spark.createDataFrame([(i, i * 7 % 11, i % 5, float(i % 13), "click" if i % 3 else "view") for i in range(80) if i not in (5, 9)], "event_id long, day int, user_id long, value double, event_type string")
    events.select("event_id", F.timestamp_add("DAY", F.col("day"), F.lit("2024-01-01").cast("timestamp")).alias("ts"), "user_id", "event_type", "value").write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture
def no_pairs(monkeypatch):
    def refuse(*args, **more):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(D, "pairwise", refuse)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["drawn_quartets", "four_point_condition", "gromov_hyperbolicity"])
def test_quartets_make_no_pairs(spark, folder, no_pairs, name):
    assert registry.QUERIES[name](spark, folder).count() > 0


@pytest.mark.parametrize("metric", ["cityblock", "euclidean"])
def test_quartets_from_vectors(spark, folder, metric):
    nodes = D.vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    quartets = spark.createDataFrame([(0, 1, 2, 3, 4), (1, 9, 8, 7, 3), (2, 1, 1, 2, 3), (3, 1, 2, 3, 99)], "qid long, a long, b long, c long, d long")
    got, want = (sorted(map(tuple, f.collect())) for f in (S.quartet_sums_of(quartets, nodes, metric), S.quartet_sums(quartets, D.pairwise(nodes, metric))))
    assert got == want and [r[0] for r in got] == [0, 1]


def test_permuted_labels_are_not_broadcast(spark, folder):
    plan = plan_of(registry.QUERIES["permuted_label_test"](spark, folder))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_shuffled_dates_are_not_broadcast(spark, folder):
    dates = spark.createDataFrame([(i, 0) for i in range(9)], "node long, d int").select("node", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("day"))
    plan = plan_of(M.shuffled(dates, 5))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_root_distances_are_not_broadcast(spark):
    dates = spark.range(4).select(F.col("id").alias("node"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    distances = spark.range(2).select(F.col("id").alias("root"), F.explode(F.array(*(F.lit(n).cast("long") for n in range(4)))).alias("node")).withColumn("distance", F.abs(F.col("root") - F.col("node")).cast("double"))
    found = M.best_root(distances, dates)
    plan = plan_of(found)
    assert "SortMergeJoin" not in plan and "BuildRight" in plan and "BuildLeft" not in plan
    assert tuple(found.first()) == (0, pytest.approx(1.0))


ASKED = "spearman_distance_days partial_spearman distance_distortion distance_change correlation_change gromov_relative time_control matrix_quality medoid_update medoid_assignment clock_score".split()


@pytest.mark.parametrize("name", ASKED)
def test_statistics_make_no_pairs(spark, folder, no_pairs, name):
    assert registry.QUERIES[name](spark, folder).count() > 0


@pytest.fixture(scope="module")
def both(spark, folder):
    """Dated vectors, asked in blocks of 16, and the same as a table of pairs (i, j, d, t, days)."""
    days = spark.createDataFrame([(i, None if i % 10 == 4 else float(i * 7 % 11)) for i in range(60)], "id long, days double")
    nodes = D.vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    table = D.pairwise(nodes).select("i", "j", F.round(F.col("d").cast("double"), 3).alias("d"))
    table = table.join(D.pairwise(nodes, "euclidean").select("i", "j", F.round(F.col("d").cast("double"), 3).alias("t")), ["i", "j"])
    a, b = (days.select(F.col("id").alias(c), F.col("days").alias(n)) for c, n in (("i", "a"), ("j", "b")))
    table = table.join(a, "i").join(b, "j").select("i", "j", "d", "t", F.abs(F.col("a") - F.col("b")).alias("days")).cache()
    return P.Pairs(nodes.join(days, "id"), {"d": "cityblock", "t": "euclidean"}, {"days": None}, block=16), table


def close(got, want):
    return got.columns == want.columns and tuple(got.first()) == pytest.approx(tuple(want.first()), abs=1e-9)


def test_asked_as_in_a_table(both):
    pairs, table = both
    assert close(P.spearman(pairs, "d", "days"), S.spearman(table, "d", "days"))
    assert close(P.partial_spearman(pairs, "d", "days", "t"), S.partial_spearman(table, "d", "days", "t"))
    assert close(P.correlation_change(pairs, "d", "t", "days"), C.correlation_change(table, "d", "t", "days"))
    assert close(P.distance_fit(pairs, "d", "t"), S.distance_fit(table))
    assert close(P.quantiles(pairs, "d", {"q1": 0.25, "q3": 0.75}), S.range_quantiles(table, "d", {"q1": 0.25, "q3": 0.75}))


def test_change_as_in_a_table(both):
    pairs, table = both
    for x, y in (("t", "d"), ("d", "t")):
        got = P.distance_change(pairs, x, y)
        assert close(got, C.distance_change(table.select("i", "j", F.col(x).alias("d")), table.select("i", "j", F.col(y).alias("d"))))


def test_few_vectors(spark):
    nodes = spark.createDataFrame([(1, [0.0, 1.0], 0.0), (2, [1.0, 1.0], 3.0)], "id long, v array<double>, days double")
    for n in range(3):
        pairs = P.Pairs(nodes.where(f"id <= {n}"), {"d": "cityblock", "t": "euclidean"}, {"days": None})
        assert tuple(P.spearman(pairs, "d", "days").first()) == (n // 2, None)
        assert P.distance_change(pairs, "t", "d").first()["median_ratio"] == (1.0 if n == 2 else None)
        assert P.distance_fit(pairs, "d", "t").first()["n"] == n // 2
        assert P.matrix_quality(nodes.where(f"id <= {n}").select("id", "v")).first()["n_pairs"] == n // 2


def test_medoids_from_vectors(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    nodes, start = D.vectors(rows), rows.groupBy("label").agg(F.min("vec_id").alias("node")).select(F.lit(0).alias("repeat"), F.col("label").alias("slot"), "node")
    pairs = D.pairwise(nodes)
    first = K.assign(pairs, start)
    assert sorted(map(tuple, K.assign_vectors(nodes, start).collect())) == sorted(map(tuple, first.collect()))
    assert sorted(map(tuple, K.update_vectors(nodes, first).collect())) == sorted(map(tuple, K.update(pairs, first).collect()))


#: Vectors on a grid of few values, so that many distances are equal.
@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(4)
    return D.vectors(spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(70)], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("metric", ["cityblock", "euclidean"])
@pytest.mark.parametrize("k", [1, 4, 200])
def test_lists_are_enough(grid, metric, k):
    near = D.nearest(grid, k, metric, block=16).cache()
    knn = G.knn_graph(grid, k, metric).cache()
    both = lambda f: sorted(map(tuple, f.collect()))
    assert both(G.prune_nearest(near, grid, metric)) == both(G.prune_by_witness(knn, grid, metric))
    assert both(G.nearest_ranks(near)) == both(G.min_ranks(knn, grid, metric).select("source", "target", "weight", "min_rank"))


@pytest.mark.parametrize("name", ["witness_pruned_knn", "rng_in_knn", "edge_min_ranks", "pruning_fractions"])
def test_pruning_asks_no_others(spark, folder, monkeypatch, name):
    def refuse(*args, **more):
        raise AssertionError("all nodes are read for each edge")

    for asked in ("lunes", "witnessed", "nearer_counts"):
        monkeypatch.setattr(G, asked, refuse)
    assert registry.QUERIES[name](spark, folder).count() > 0


def test_vectors_are_not_shuffled_for_pairs(grid):
    for found in (D.pairwise(grid, block=16), D.pairwise(grid, within=2.0, block=16)):
        assert "FlatMapGroupsInArrow" not in plan_of(found)
