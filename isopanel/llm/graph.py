"""Connected components of an edge table, without any node's neighbours in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Edges that one task contracts, about.
PART_EDGES = 500_000


def components(edges: DataFrame, name: str = "components", part_edges: int = PART_EDGES) -> DataFrame:
    """(node, component) of the nodes that edges (a, b) touch; a component is named by its least node.

    In each round every part of the edges is contracted to stars by itself; one part is then done. With more, large and
    small stars alternate: each hangs neighbours below the least one around, so rounds grow with the logarithm of the
    longest path. A star's centre is found by a partial aggregate and joined back, which Spark can split for nodes with
    very many neighbours. Rounds end when count and fingerprint of the edges stay.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(ends.distinct(), name)
    mark = _fingerprint(links)
    while mark[0]:
        parts = -(-mark[0] // part_edges)
        stars = written(links.coalesce(parts).mapInArrow(_contracted, links.schema).distinct(), name)
        forget(links)
        if parts == 1:
            links = stars
            break
        both = stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # above its node, each neighbour meets the least one around; a node above its least meets it too
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        centre = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(centre, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        links = written(small.select("e.*").where("a <> b").distinct(), name)
        forget(stars)
        if (after := _fingerprint(links)) == mark:
            break
        mark = after
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("e")).select("e.*").distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's edges as stars: each node and the least one that it reaches by them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    schema = held[0].schema
    edges = pa.Table.from_batches(held)
    ends = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    a, b = rank[ends.indices.to_numpy()].reshape(2, -1)
    label = np.arange(len(order))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        # each root that has a smaller one beside it hangs below it, then all nodes hang below their roots
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    nodes = ends.dictionary.take(pa.array(order))
    below = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(below)), nodes.take(pa.array(label[below]))], schema=schema)


def _fingerprint(links: DataFrame) -> tuple[int, int, int]:
    one = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
    return one["n"], one["x"] or 0, one["y"] or 0
