"""Graphs of all pairs within a distance against their tables of edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopanel.operators import analytics as A
from isopanel.operators import distance as D
from isopanel.operators import graphs as G
from isopanel.operators.within import Within


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (20, 3)) for c in (0, 6, 12)] + [rng.normal(0, 30, (10, 3)), np.zeros((5, 3))])
    ids = rng.permutation(len(x)) * 3 - 100
    return spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "id bigint, v array<double>").localCheckpoint()


def pairs_of(rows):
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("tau", [1.3])
def test_components_and_degrees_within(nodes, tau):
    names, edges = nodes.select(F.col("id").alias("node")), G.tau_graph(nodes, tau).localCheckpoint()
    graph = Within(nodes, tau, block=8)
    assert pairs_of(graph.components()) == pairs_of(A.membership(names, edges))
    assert pairs_of(graph.degrees()) == pairs_of(A.degrees(names, edges))


def test_common_component_takes_a_graph_without_edges(nodes):
    names, edges, other = nodes.select(F.col("id").alias("node")), G.tau_graph(nodes, 4.0), G.knn_graph(nodes, 2)
    assert pairs_of(A.common_component(names, [Within(nodes, 4.0, block=8), other])) == pairs_of(A.common_component(names, [edges, other]))


def test_codes_tell_distances_of_wide_and_long_vectors():
    rng = np.random.default_rng(0)
    for width, size in ((3, 1.0), (64, 1e-9), (2560, 1e6)):
        a, b = rng.normal(0, size, (70, width)), rng.normal(0, size, (40, width))
        a[0], b[0] = 0, b[1]
        codes, unit, off = D.rough_cityblock(a, b)
        d = D.cityblock(a, b)
        assert (np.abs(codes * unit - d) <= off).all() and off < 0.05 * d.max()
        at, to = np.divmod(np.arange(d.size), 40)
        assert (D.named_cityblock(a[at], b[to]) == d.ravel()).all()
    assert D.rough_cityblock(np.array([[np.nan]]), np.array([[1.0]])) is None
