"""Edges that repeat a direction are dropped where both ends agree and the graph stays as connected as it was."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from .analytics import Csr, broadcast_graph, membership
from .graphs import components, half_edges, minimum_spanning_forest
from .positions import numbered

EVALUATIONS = "node bigint, neighbour bigint, candidate_rank int, rank_fraction double, score double, mean_before double, mean_after double, gain double, accepted boolean"


def directional_evaluations(vectors: DataFrame, edges: DataFrame, share: float = 0.1, least_gain: float = 0.01) -> DataFrame:
    """Each node's candidates to drop, by how little their direction has in common with the others.

    A direction's score is its mean absolute cosine to the node's other directions. The lowest share of them are tried
    in order, ties to the smaller neighbour; one is accepted while the mean score of those left gains enough, and the
    first that isn't ends it. The score of a row is that among the directions left when its turn comes. Two directions
    always stay; neighbours in the same place have none.
    """
    a, b = (vectors.select(F.col("id").alias(c), F.col("v").alias(v)) for c, v in (("node", "v"), ("neighbour", "w")))
    shifts = half_edges(edges).join(b, "neighbour").join(a, "node").select("node", "neighbour", F.zip_with("w", "v", lambda x, y: x - y).alias("shift"))

    def evaluate(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("neighbour")
        x = np.stack(frame["shift"].to_list())
        length = np.sqrt((x * x).sum(1))
        some = length > 1e-12
        x, names = x[some] / length[some, None], frame["neighbour"].to_numpy()[some]
        m, rows = len(x), []
        if m > 2:
            alike = np.abs(x @ x.T)
            np.fill_diagonal(alike, 0)
            scores = alike.sum(1) / (m - 1)
            order = np.lexsort((names, scores))[: min(int(np.ceil(share * m)), m - 2)]
            left, mean, goes = np.ones(m, bool), scores.mean(), True
            for rank, i in enumerate(order, 1):
                n = int(left.sum()) - 1
                own = alike[i, left].sum() / n
                left[i] = False
                after = alike[np.ix_(left, left)].sum() / (n * (n - 1))
                gain = (after - mean) / mean if mean > 0 else 0.0
                goes = goes and gain + 1e-12 >= least_gain
                rows.append((frame["node"].iloc[0], names[i], rank, rank / m, own, mean, after, gain, goes))
                if not goes:
                    break
                mean = after
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EVALUATIONS.split(", ")])

    return shifts.groupBy("node").applyInPandas(evaluate, EVALUATIONS)


def agreed(evaluations: DataFrame) -> DataFrame:
    """(source, target, position): edges that both ends accept, in the order of (larger score, larger rank fraction, ids)."""
    yes = evaluations.where("accepted")
    a = yes.select(F.col("node").alias("source"), F.col("neighbour").alias("target"), F.col("score").alias("sa"), F.col("rank_fraction").alias("ra"))
    b = yes.select(F.col("neighbour").alias("source"), F.col("node").alias("target"), F.col("score").alias("sb"), F.col("rank_fraction").alias("rb"))
    both = a.join(b, ["source", "target"]).where("source < target")
    keyed = both.select("source", "target", F.greatest("sa", "sb").alias("score"), F.greatest("ra", "rb").alias("fraction"))
    placed = numbered(keyed, [], ["score", "fraction", "source", "target"], "place")
    return placed.select("source", "target", (F.col("place") + 1).alias("position"))


def delete_safely(edges: DataFrame, queue: DataFrame) -> DataFrame:
    """edges less those of the queue that connectivity does not need; later ones in the queue are kept first.

    Edges outside the queue join nodes; between what they join, a spanning forest by descending position stays.
    """
    queue = settled(queue, "queue")
    sure = settled(edges.join(queue, ["source", "target"], "left_anti"), "sure")
    parts = components(sure)
    a, b = (parts.select(F.col("node").alias(c), F.col("component").alias(n)) for c, n in (("source", "a"), ("target", "b")))
    named = queue.join(a, "source", "left").join(b, "target", "left").select("source", "target", "position", F.coalesce("a", "source").alias("a"), F.coalesce("b", "target").alias("b")).where("a <> b")
    ends = named.select(F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb"), "position", "source", "target")
    last = ends.groupBy("ca", "cb").agg(F.max_by(F.struct("position", "source", "target"), "position").alias("e"))
    last = settled(last.select("ca", "cb", "e.*"), "contracted")
    forest = minimum_spanning_forest(last.select(F.col("ca").alias("source"), F.col("cb").alias("target"), (-F.col("position")).cast("double").alias("weight")))
    kept = last.join(forest.select(F.col("source").alias("ca"), F.col("target").alias("cb")), ["ca", "cb"], "left_semi")
    back = edges.join(kept.select("source", "target"), ["source", "target"], "left_semi")
    return sure.unionByName(back)


def directional_refinement(vectors: DataFrame, edges: DataFrame, share: float = 0.1, least_gain: float = 0.01) -> DataFrame:
    return delete_safely(edges, agreed(directional_evaluations(vectors, edges, share, least_gain)))


#: Nodes of a dense eigenproblem at the driver; numbers that the vectors of Lanczos' method take above it, and these vectors at least
#: and at most; the residual, as a share of the largest eigenvalue's bound, at which one is found.
LAYOUT_NODES, BASIS, FEW, MANY, RESIDUAL = 2000, 25_000_000, 40, 300, 1e-14


def spectral_layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, x, y, rank) of the largest component: the second and third eigenvectors of its Laplacian, signs so that
    the largest entry is positive; rank is the order of x.

    The component's edges come to the driver behind a check of their number. Above LAYOUT_NODES nodes no matrix is made: the
    Laplacian meets one vector after the other.
    """
    found = settled(membership(nodes, edges), "membership")
    top = found.groupBy("component").count().agg(F.min_by("component", F.struct(-F.col("count"), "component")).alias("component"))
    giant = found.join(F.broadcast(top), "component", "left_semi").select("node")
    alone = giant.limit(1).toPandas()["node"].to_numpy(np.int64)
    graph = broadcast_graph(edges.join(giant.select(F.col("node").alias("source")), "source", "left_semi"), alone)
    n = len(graph.ids)
    vectors = dense_vectors(graph) if n <= LAYOUT_NODES else sparse_vectors(graph)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    x = vectors[:, 0] if vectors.shape[1] else np.zeros(n)
    y = vectors[:, 1] if vectors.shape[1] > 1 else np.zeros(n)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((graph.ids, x))] = np.arange(n)
    rows = pa.table({"node": graph.ids, "x": x, "y": y, "rank": rank})
    return edges.sparkSession.createDataFrame(rows, "node bigint, x double, y double, rank bigint")


def dense_vectors(graph: Csr) -> np.ndarray:
    """The second and third eigenvectors of the Laplacian, a column each."""
    n = len(graph.ids)
    laplacian = np.zeros((n, n))
    at = np.repeat(np.arange(n), np.diff(graph.starts))
    laplacian[at, graph.to] = -graph.weight
    np.fill_diagonal(laplacian, -laplacian.sum(1))
    return np.linalg.eigh(laplacian)[1][:, 1:3]


def sparse_vectors(graph: Csr, many: int | None = None) -> np.ndarray:
    """dense_vectors() of a connected graph by Lanczos' method with thick restarts; one after the other, so that equal
    eigenvalues have a vector each."""
    n = len(graph.ids)
    some = np.flatnonzero(np.diff(graph.starts))
    degree = np.zeros(n)
    degree[some] = np.add.reduceat(graph.weight, graph.starts[some])
    if not np.isfinite(degree).all():
        raise ValueError("a layout's weights are finite")
    many = many or int(np.clip(BASIS // n, FEW, MANY))

    def times(x: np.ndarray) -> np.ndarray:
        out = degree * x
        out[some] -= np.add.reduceat(graph.weight * x[graph.to], graph.starts[some])
        return out

    found = [np.full(n, n**-0.5)]
    for _ in range(min(2, n - 1)):
        found.append(_least_vector(times, np.array(found), min(many, n - len(found)), RESIDUAL * 2 * degree.max()))
    return np.stack(found[1:], axis=1)


def _least_vector(times: Callable[[np.ndarray], np.ndarray], known: np.ndarray, many: int, residual: float) -> np.ndarray:
    """The eigenvector of the least eigenvalue among what is at right angles to known ones (rows)."""

    def free(x: np.ndarray, m: int) -> np.ndarray:
        """x less what is known or among the first m of the basis; twice, as once leaves rounding behind."""
        for _ in range(2):
            x = x - known.T @ (known @ x)
            x -= basis[:m].T @ (basis[:m] @ x)
        return x

    basis, small, m = np.zeros((many + 1, known.shape[1])), np.zeros((many, many)), 0
    start = free(np.random.default_rng(len(known)).standard_normal(known.shape[1]), 0)
    basis[0] = start / np.linalg.norm(start)
    while True:
        while m < many:
            x = times(basis[m])
            small[m, : m + 1] = small[: m + 1, m] = basis[: m + 1] @ x
            x = free(x, m + 1)
            length, m = np.linalg.norm(x), m + 1
            if length <= residual:  # the basis holds all that the start reaches
                break
            basis[m] = x / length
        values, turned = np.linalg.eigh(small[:m, :m])
        if length <= residual or m == known.shape[1] - len(known) or length * abs(turned[-1, 0]) <= residual:
            x = free(turned[:, 0] @ basis[:m], 0)
            return x / np.linalg.norm(x)
        kept = max(1, m // 3)
        basis[:kept], basis[kept] = turned[:, :kept].T @ basis[:m], basis[m].copy()
        small[:] = 0
        small[np.arange(kept), np.arange(kept)] = values[:kept]
        m = kept
