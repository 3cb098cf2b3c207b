import numpy as np
import pytest

from isopanel.operators import structure as R
from pyspark.sql import functions as F


def batches(edges, slack):
    left, rows, best = {frozenset(e) for e in edges if e[0] != e[1]}, [], None
    while left:
        degree: dict = {}
        for e in left:
            for n in e:
                degree[n] = degree.get(n, 0) + 1
        n, m = len(degree), len(left)
        rows.append((len(rows), n, m, m / n))
        if best is None or m * best[0] > best[1] * n:
            best = (n, m, set(degree))
        stays = {x for x, d in degree.items() if d * n * 100 > (100 + slack) * 2 * m}
        left = {e for e in left if e <= stays}
    return rows, best[2] if best else set()


@pytest.mark.parametrize("slack", [10, 100])
def test_batches(spark, slack):
    """A sparse graph around a clique of twelve and a star of forty leaves; loops and both directions of an edge."""
    rng = np.random.default_rng(1)
    edges = [(i, j) for i in range(12) for j in range(i + 1, 12)] + [(50, i) for i in range(100, 140)] + rng.integers(0, 90, (100, 2)).tolist()
    edges += [(3, 3), (1, 0)]
    rows, dense = batches(edges, slack)
    found = R.densest_by_batches(spark.createDataFrame([(int(a), int(b), 1.0) for a, b in edges], "source long, target long, weight double"), slack)
    assert [tuple(r) for r in found.trace.orderBy("round").collect()] == rows
    assert {r["node"] for r in found.nodes.collect()} == dense >= set(range(12))


def test_no_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    none = spark.createDataFrame([], "source long, target long, weight double")
    found = R.densest_by_batches(none)
    assert found.trace.count() == 0 and found.nodes.count() == 0
    got = {r["stage"]: (r["n"], r["m"]) for r in R.stages(nodes, none).collect()}
    assert got["original_graph"] == got["one_round_degree_1_removed"] == (2, 0) and got["recursive_2_core"] == (0, None)


def test_multiplicity(spark):
    degree = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 5), (5, 0)], "node long, degree long")
    records = spark.createDataFrame([(1,), (1,), (1,), (3,), (4,), (4,), (9,)], "node long")
    got = {r["node_group"]: tuple(r)[1:] for r in R.multiplicity_by_degree(degree, records).collect()}
    assert got["degree_1"] == (2, 3, 1.5, 1.5, 1, 0.5, 3)
    assert got["degree_ge_2"] == (2, 3, 1.5, 1.5, 1, 0.5, 2)
    assert got["all_nodes"] == (5, 6, 1.2, 1.0, 2, 0.4, 3)
    assert got["=0"] == (1, 0, 0.0, 0.0, 0, 0.0, 0) and set(got) == {"degree_1", "degree_2", "degree_ge_2", "all_nodes", "=0", "=1", "=2", "=5"}


def test_hubs(spark):
    """A triangle 1, 2, 3 with leaves 4 and 5 at 1, and a hub 6 of three leaves that is in no core."""
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (1, 5), (6, 7), (6, 8), (6, 9)], "source long, target long").withColumn("weight", F.lit(1.0))
    nodes = spark.range(1, 11).withColumnRenamed("id", "node")
    records = spark.createDataFrame([(1, 12, "b", "2024-02-01"), (1, 11, "a", None), (1, 13, "b", "2024-01-01"), (2, 5, "c", "2024-01-01")], "node long, record long, lineage string, day string")
    got = [tuple(r) for r in R.hub_records(nodes, edges, records, 2).orderBy("node").collect()]
    assert got == [(1, 4, 3, 2, 2, True, 2, 11, "a|b", "2024-01-01", "2024-02-01"), (6, 3, 0, 3, 0, False, 0, None, "", None, None)]


def test_grid(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("c", 1), ("a", None)], "name string, seed int")
    axes = {"name": spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "name string"), "seed": spark.createDataFrame([(1,), (2,)], "seed int")}
    got = {(r["name"], r["seed"]): (r["n_runs"], r["state"]) for r in R.grid_check(runs, axes).collect()}
    assert got == {("a", 1): (1, "once"), ("a", 2): (2, "repeated"), ("b", 1): (0, "missing"), ("b", 2): (0, "missing"), ("c", 1): (1, "unexpected"), ("a", None): (1, "unexpected")}
