"""Statistics, dates, measures, clustering, trees and sources on small inputs with known results."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopanel.functions import scalars as C
from isopanel.operators import analytics as A
from isopanel.operators import cluster as K
from isopanel.operators import distance as D
from isopanel.operators import stats as S
from isopanel.operators import temporal as M
from isopanel.operators import trees as R
from isopanel.sources import fasta, graph_files

POINTS = [0.0, 0.5, 1.5, 7.0, 8.0, 10.0]
PATH = [(0, 1, 0.5), (1, 2, 1.0), (2, 3, 5.5), (3, 4, 1.0), (4, 5, 2.0)]


@pytest.fixture(scope="module")
def path(spark):
    return spark.createDataFrame(PATH, "source long, target long, weight float")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i,) for i in range(6)], "node long")


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, j, abs(POINTS[i] - POINTS[j])) for i, j in itertools.combinations(range(6), 2)], "i long, j long, d float")


@pytest.fixture(scope="module")
def dates(spark):
    days = ["2020-03-01", "2020-01-01", "2020-02-01", "2020-02-01", None, "2020-06-15"]
    return spark.createDataFrame([(i, d) for i, d in enumerate(days)], "node long, day string").select("node", F.col("day").cast("date").alias("day"))


def test_orientation_and_roles(path, dates):
    rows = {(r["source"], r["target"]): r for r in M.orient(path, dates).collect()}
    assert [(rows[0, 1]["older"], rows[0, 1]["lag_days"]), (rows[1, 2]["older"], rows[1, 2]["lag_days"])] == [(1, 60), (1, 31)]
    assert [rows[2, 3]["status"], rows[3, 4]["status"], rows[4, 5]["status"]] == ["equal", "missing", "missing"]
    found = {r["node"]: (r["n_in"], r["n_out"]) for r in M.roles(M.orient(path, dates), dates).collect()}
    assert {n for n, (i, _) in found.items() if i == 0} == {1, 3, 5} and {n for n, (_, o) in found.items() if o == 0} == {0, 2, 3, 5}
    null = M.lag_null(path, dates, 19).first()
    assert null["observed"] == pytest.approx(91 / 3) and 0 < null["p_ge"] <= 1


def test_ball_spread(path, nodes, dates):
    found = A.geodesics(path, nodes.select(F.col("node").alias("root")))
    ball = A.balls(found, [2.0]).where("center = 1")
    assert sorted(r["node"] for r in ball.collect()) == [0, 1, 2]
    one = M.ball_spread(ball, dates).first()
    assert (one["n_nodes"], one["n_dated"], one["span"], one["mean_gap"]) == (3, 3, 60, pytest.approx(40.0))
    assert A.power_radii(10.0, zero=True) == [0.0, 1.0, 2.0, 4.0, 8.0, 16.0]


def test_geodesics_agree(path, nodes):
    one = {(r["root"], r["node"]): r["distance"] for r in A.geodesics(path, nodes.select(F.col("node").alias("root"))).collect()}
    two = {(r["root"], r["node"]): r["distance"] for r in A.geodesics_from(path, nodes.select(F.col("node").alias("root"))).collect()}
    assert one == two and one[0, 5] == 10.0


def test_boxes(path, spark):
    trials = spark.createDataFrame([(0, r, list(range(6))) for r in (0, 1, 2, 5)], "trial long, radius long, priority array<long>")
    assert {r["radius"]: r["n_boxes"] for r in A.box_cover(path, trials).collect()} == {0: 6, 1: 3, 2: 2, 5: 1}


def test_cores_and_peeling(spark):
    k4 = [(a, b, 1.0) for a, b in itertools.combinations(range(4), 2)] + [(3, 4, 1.0), (4, 5, 1.0)]
    edges, nodes = spark.createDataFrame(k4, "source long, target long, weight double"), spark.createDataFrame([(i,) for i in range(7)], "node long")
    assert sorted(r["node"] for r in A.core(nodes, edges).collect()) == [0, 1, 2, 3]
    assert tuple(A.densest(edges).first())[1:] == (4, 1.5)
    assert sorted(r["node"] for r in A.largest_component(nodes, edges).collect()) == list(range(6))
    one = A.graph_stats(nodes, edges).first()
    assert (one["n_nodes"], one["n_edges"], one["n_components"], one["max_degree"]) == (7, 8, 2, 4)
    assert sorted(r["node"] for r in A.without_leaves(nodes, edges).collect()) == [0, 1, 2, 3, 4, 6]


def test_farthest_first(spark, pairs):
    points = spark.createDataFrame([(i, [x]) for i, x in enumerate(POINTS)], "id long, v array<double>")
    rows = A.skew_bound(A.farthest_first(points, pairs)).orderBy("rank").collect()
    assert [r["node"] for r in rows] == [0, 5, 3, 2, 4, 1] and [r["distance"] for r in rows][1:] == [10.0, 3.0, 1.5, 1.0, 0.5]
    assert [r["bound"] for r in rows][1:] == [10.0, 11.5, 12.25, 12.75, 13.0]


def test_dimensions(spark):
    rows = spark.createDataFrame([(0, 2, [3.0, 1.0]), (1, 1, [0.0])], "node long, n long, values array<double>")
    got = {r["node"]: r for r in A.dimensions(rows).collect()}
    assert (got[0]["rank"], got[0]["d90"], got[0]["d95"], got[0]["participation"]) == (2, 2, 2, 1.6) and got[1]["rank"] == 0


def test_k_medoids(spark, pairs):
    start = spark.createDataFrame([(0, 0, 0), (0, 1, 5)], "repeat int, slot int, node long")
    first = K.assign(pairs, start)
    assert [r["slot"] for r in first.orderBy("node").collect()] == [0, 0, 0, 1, 1, 1] and K.objectives(first).first()["objective"] == 7.0
    assert sorted(r["node"] for r in K.update(pairs, first).collect()) == [1, 4]
    _, runs = K.k_medoids(pairs, start)
    assert runs.first()["objective"] == 4.5 and runs.first()["converged"]
    assert not K.k_medoids(pairs, start, rounds=1)[1].first()["converged"]
    strings = spark.createDataFrame([(0, "AAAA"), (1, "AAAB"), (2, "AABB")], "node long, s string")
    owned = spark.createDataFrame([(0, 0, i) for i in range(3)], "repeat int, slot int, node long")
    one = K.profile_medoids(strings, owned).first()
    assert (one["node"], one["s"]) == (1, 2)


def test_k_medoids_from_vectors(spark):
    """Several repeats at once, without a table of pairs: the same steps as with one."""
    rng = np.random.default_rng(6)
    nodes = spark.createDataFrame([(3 * i, rng.integers(0, 30, 3).astype(float).tolist()) for i in range(60)], "id long, v array<double>").localCheckpoint()
    start = spark.createDataFrame([(0, 0, 0), (0, 1, 90), (1, 0, 6), (1, 1, 9), (1, 2, 12), (4, 0, 33)], "repeat int, slot int, node long")
    pairs = D.pairwise(nodes).localCheckpoint()
    (a, x), (b, y) = K.k_medoids(pairs, start), K.k_medoids_vectors(nodes, start)
    assert sorted(map(tuple, a.select("repeat", "node", "slot", "d").collect())) == sorted(map(tuple, b.select("repeat", "node", "slot", "d").collect()))
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())) and x.agg(F.max("iterations")).first()[0] > 1


def test_partitions(spark):
    rows = spark.createDataFrame([(a, b) for a, b in zip([0, 1, 2] * 4, [2, 0, 1] * 4)], "truth int, found int")
    assert S.adjusted_rand(rows, "truth", "found").first()["ari"] == 1.0
    assert {(r["found"], r["truth"]) for r in S.best_mapping(rows, "found", "truth").collect()} == {(2, 0), (0, 1), (1, 2)}


def test_quartets(spark):
    def one(ad):
        d = spark.createDataFrame([(0, 1, 3.0), (0, 2, 8.0), (0, 3, ad), (1, 2, 9.0), (1, 3, 10.0), (2, 3, 9.0)], "i long, j long, d double")
        return S.four_point(S.quartet_sums(spark.createDataFrame([(0, 0, 1, 2, 3)], "qid long, a long, b long, c long, d long"), d)).first()

    assert one(9.0)["delta_q"] == 0.0 and one(9.0)["topology"] == 0
    assert (one(11.0)["delta_q"], one(11.0)["half_gap"]) == (0.25, 1.0)


def test_ranks_and_tests(spark):
    rng = random.Random(2)
    x = [rng.randint(0, 20) for _ in range(200)]
    df = spark.createDataFrame([(float(a), float(a + rng.randint(0, 9)), i % 3 == 0) for i, a in enumerate(x)], "x double, y double, g boolean")
    ranks = {r["x"]: r["r"] for r in S.value_ranks(df, "x").collect()}
    assert all(ranks[v] == np.mean([i + 1 for i, a in enumerate(sorted(x)) if a == v]) for v in set(map(float, x)))
    rows = df.collect()
    u = sum((a["x"] > b["x"]) + 0.5 * (a["x"] == b["x"]) for a in rows if a["g"] for b in rows if not b["g"])
    assert S.rank_sum(df, "x", F.col("g")).first()["u"] == u
    assert 0.5 < S.spearman(df, "x", "y").first()["rho"] <= 1
    assert S.spearman(df.limit(2), "x", "y").first()["rho"] is None
    assert df.select(S.normal_tail(F.lit(1.959964)).alias("p")).first()["p"] == pytest.approx(0.025, abs=1e-6)


def test_trees(spark):
    d = np.array([[0, 3, 8, 9], [3, 0, 9, 10], [8, 9, 0, 9], [9, 10, 9, 0]], float)
    rows = [("g", i, j, float(d[i, j])) for i, j in itertools.combinations(range(4), 2)]
    tree = R.neighbour_trees(spark.createDataFrame(rows, "group string, i long, j long, d double"))
    nodes = R.rooted(tree)
    found = R.patristic(nodes, spark.createDataFrame([(i, j) for _, i, j, _ in rows], "i long, j long"), nodes)
    assert {(r["i"], r["j"]): round(r["d"], 9) for r in found.collect()} == {(i, j): x for _, i, j, x in rows}
    sizes = R.allocate(spark.createDataFrame([("a", 70), ("b", 20), ("c", 13), ("d", 0)], "stratum string, size long"), 10)
    # 93 of 103 go by the room above one: 64.17, 17.67, 11.16
    assert {r["stratum"]: r["n"] for r in sizes.collect()} == {"a": 6, "b": 2, "c": 2, "d": 0}


def test_tree_fits_are_those_of_trees(spark):
    """Vectors to one row a group, without pairs or paths: the same as the tree as a table."""
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 3 % 2], i, rng.integers(0, 9, 6).astype(float).tolist()) for i in range(40)] + [("alone", 99, [0.0] * 6), (None, 100, [1.0] * 6)]
    members = spark.createDataFrame(rows, "group string, id long, v array<double>")
    got = {r["group"]: (r["n"], r["rsd"]) for r in R.tree_fits(members).collect()}
    want = {}
    for group in "ab":
        own = [(i, np.array(v)) for g, i, v in rows if g == group]
        pairs = [(group, i, j, float(np.abs(x - y).sum())) for (i, x), (j, y) in itertools.combinations(own, 2)]
        tree = R.neighbour_trees(spark.createDataFrame(pairs, "group string, i long, j long, d double")).collect()
        up, name = {r["node"]: (r["parent"], r["branch"]) for r in tree}, {r["tip"]: r["node"] for r in tree}

        def path(node):
            out = {node: 0.0}
            while up[node][0] is not None:
                out[up[node][0]], node = out[node] + up[node][1], up[node][0]
            return out

        squares = [(d, min(path(name[i])[k] + path(name[j])[k] for k in path(name[i]).keys() & path(name[j]).keys())) for _, i, j, d in pairs]
        want[group] = (len(pairs), pytest.approx((sum((d - t) ** 2 for d, t in squares) / sum(d * d for d, _ in squares)) ** 0.5, abs=1e-9))
    assert got == want


@pytest.mark.parametrize(("target", "want"), [(155, {"a": 3, "b": 50, "c": 102}), (153, {"a": 3, "b": 50, "c": 100}), (300, {"a": 3, "b": 50, "c": 247}), (60, {"a": 3, "b": 20, "c": 37}), (13, {"a": 3, "b": 5, "c": 5}), (12, None), (1054, None)])
def test_allocation_within_bounds(spark, target, want):
    strata = spark.createDataFrame([("a", 3), ("b", 50), ("c", 1000)], "stratum string, size long")
    found = R.allocate(strata, target, 5, 100)
    if want is None:
        with pytest.raises(Exception, match="out of reach"):
            found.collect()
    else:
        assert {r["stratum"]: r["n"] for r in found.collect()} == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    days = {"2021-00-00": (6, 15), "2021-03-00": (3, 15), "2021-03-09": (3, 9)}
    assert all(one(C.repaired_date(F.lit(t))) == datetime.date(2021, *d) for t, d in days.items()) and one(C.repaired_date(F.lit("x"))) is None
    assert [one(C.gap_ranges(F.lit(t))) for t in ("A--C-", "", "---", "ACD")] == ["2-3;5", "", "1-3", ""]
    lineages = {"BA.2.86.1": "BA.2.86", "BA.2.12": "BA.2", "AY.4": "Delta", "KP.2": "JN.1", "B.1": "Other"}
    assert all(one(C.prefix_bucket(F.lit(t), C.LINEAGES)) == b for t, b in lineages.items())
    assert one(C.accession(F.lit("Spike|x|EPI_ISL_12|y"))) == "EPI_ISL_12" and one(C.accession(F.lit("NP_1 virus"))) == "NP_1"
    assert one(C.clean_sequence(F.lit("ac-u.o*"))) == "ACXX" and one(C.regrouped(F.lit("a"), {"n": ["a", "b"]})) == "n"
    assert one(C.decimal_year(F.lit("2020-07-01").cast("date"))) == pytest.approx(2020 + 182 / 366)


def test_sources(spark, tmp_path, path, nodes):
    rows = spark.createDataFrame([("EPI_ISL_1 a", "A" * 200), ("NP_2 b", "CD"), ("x", "")], "header string, seq string")
    fasta.write_fasta(rows, f"{tmp_path}/fa")
    assert sorted((r["accession"], r["seq"]) for r in fasta.read_fasta(spark, f"{tmp_path}/fa").collect()) == [("EPI_ISL_1", "A" * 200), ("NP_2", "CD"), ("x", "")]
    (tmp_path / "marks.fa").write_bytes(b">A mutation c.35G>A x\r\nAC\r\nGT\n>>B\nT>T\n>C\n")
    assert [tuple(r) for r in fasta.read_fasta(spark, f"{tmp_path}/marks.fa").collect()] == [("A", "A mutation c.35G>A x", "ACGT"), ("B", "B", "T>T"), ("C", "C", "")]
    assert fasta.parse_newick("((a:1,'b c':2)n[x]:0.5,d);") == [(0, None, None, ""), (1, 0, 0.5, "n"), (2, 1, 1.0, "a"), (3, 1, 2.0, "b c"), (4, 0, None, "d")]
    (tmp_path / "t.nwk").write_text("(a:1,b:2);")
    assert fasta.read_newick(spark, f"{tmp_path}/t.nwk").count() == 3
    graph_files.write_graph(nodes, path, f"{tmp_path}", "g")
    assert graph_files.read_edges(spark, f"{tmp_path}", "g").count() == 5 and graph_files.read_stats(spark, f"{tmp_path}").first()["n_nodes"] == 6


def test_queries_have_sql():
    from isopanel.plans import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 70
