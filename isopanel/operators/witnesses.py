"""What asks for all third points of a pair: lunes, pruning by witnesses, ranks of edges.

Vectors lie as blocks, one file for each in the shared folder. A task has a pair of blocks, or one block, and reads the
others one after the other, so no vectors travel through a shuffle and no task holds more than three blocks; any number
of vectors is possible. Pairs leave as soon as a block holds a witness against them: in each block the nearest few
points are tried first, and only what they leave meets the whole block.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.arrays import file_system
from ..storage import shared_dir
from .distance import METRICS, PAIRS, Metric, _matrix, blocks

BLOCK = 256
#: Distances that are compared at once, and the nearest points of a block that are tried first.
CELLS, FIRST = 4_000_000, 8
GROUP_EDGES = 100_000
INFINITE = np.float32(np.inf)


class Stored(NamedTuple):
    """Blocks of vectors as files: the folder, the names of those that are there, and how many there might be."""

    path: str
    names: list[int]
    n: int

    def read(self, name: int) -> tuple[np.ndarray, np.ndarray]:
        system, path = file_system(self.path)
        with system.open_input_file(f"{path}/{name}.npz") as file, np.load(io.BytesIO(file.read())) as found:
            return found["ids"], found["values"]

    def block_of(self, node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.n)).cast("int")


def stored(nodes: DataFrame, block: int = BLOCK) -> Stored:
    """The vectors (id, v) in files; the driver learns their names, a row for each block."""
    path = shared_dir(nodes.sparkSession, "vector-blocks")
    packed, n = blocks(nodes, block)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                ids, values = _matrix(row["ids"], row["values"])
                file = io.BytesIO()
                np.savez(file, ids=ids, values=values)
                own = f"{folder}/{row['block']}-{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(file.getvalue())
                # another run of this task moves the same content there
                system.move(own, f"{folder}/{row['block']}.npz")
            yield pa.RecordBatch.from_arrays([batch.column("block")], names=["block"])

    names = sorted({r["block"] for r in packed.mapInArrow(write, "block int").collect()})
    return Stored(path, names, n)


def _distances(kernel: Metric, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], self_too: bool) -> np.ndarray:
    d = kernel(a[1], b[1]).astype(np.float32)
    if self_too:  # a point is no witness of its own pair
        d[a[0][:, None] == b[0][None]] = INFINITE
    return d


class Open:
    """Pairs of two blocks that no witness has ended so far."""

    def __init__(self, at: np.ndarray, to: np.ndarray, d: np.ndarray, ratio: float):
        self.at, self.to, self.d, self.ratio = at, to, d, np.float32(ratio)
        self.lune = np.full(len(at), INFINITE)

    def meet(self, di: np.ndarray, dj: np.ndarray) -> None:
        """Another block's distances from both sides; pairs whose lune is too small go."""
        if di.shape[1] > 4 * FIRST:
            near = np.argpartition(di, FIRST, axis=1)[:, :FIRST]
            self._keep(lambda at, to: np.maximum(di[at[:, None], near[at]], dj[to[:, None], near[at]]).min(1), FIRST)
        self._keep(lambda at, to: np.maximum(di[at], dj[to]).min(1), di.shape[1])

    def _keep(self, least: Any, width: int) -> None:
        step = max(1, CELLS // max(1, width))
        for low in range(0, len(self.at), step):
            part = slice(low, low + step)
            self.lune[part] = np.minimum(self.lune[part], least(self.at[part], self.to[part]))
        good = self.lune >= self.ratio * self.d
        self.at, self.to, self.d, self.lune = self.at[good], self.to[good], self.d[good], self.lune[good]


def _survivors(vectors: Stored, kernel: Metric, ratio: float, p: int, q: int, pairs: tuple[np.ndarray, np.ndarray] | None) -> pa.Table:
    a, b = vectors.read(p), vectors.read(q)
    d = kernel(a[1], b[1]).astype(np.float32)
    if pairs is None:
        at, to = np.nonzero(a[0][:, None] < b[0][None] if p == q else np.ones(d.shape, bool))
    else:
        orders = [np.argsort(x[0]) for x in (a, b)]
        at, to = (o[np.searchsorted(x[0][o], ids)] for o, x, ids in zip(orders, (a, b), pairs, strict=True))
    left = Open(at, to, d[at, to], ratio)
    for r in [p, *([q] if q != p else []), *(r for r in vectors.names if r not in (p, q))]:
        if not len(left.at):
            break
        c = vectors.read(r)
        left.meet(_distances(kernel, a, c, r == p), _distances(kernel, b, c, r == q))
    i, j = a[0][left.at], b[0][left.to]
    return pa.table([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(left.d, pa.float32()), pa.array(left.lune, pa.float32())], names=["i", "j", "d", "lune"])


def lunes(nodes: DataFrame, metric: str = "cityblock", ratio: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(i, j, d, lune) of pairs with lune >= ratio * d; lune is the least max(d(i, k), d(j, k)) over all other k.

    With ratio 1 these are the relative neighbours: no k is nearer to both than they are to one another.
    """
    kernel, vectors = METRICS[metric], stored(nodes, block)
    spark = nodes.sparkSession
    firsts = spark.createDataFrame([(n,) for n in vectors.names], "p int")
    tasks = firsts.select("p", F.explode(F.array(*map(F.lit, vectors.names))).alias("q")).where("p <= q") if vectors.names else spark.createDataFrame([], "p int, q int")
    n = len(vectors.names)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _survivors(vectors, kernel, ratio, row["p"], row["q"], None).to_batches()

    return tasks.repartition(max(1, n * (n + 1) // 2), "p", "q").mapInArrow(kept, f"{PAIRS}, lune float")


def witnessed(nodes: DataFrame, candidates: DataFrame, metric: str = "cityblock", block: int = BLOCK) -> DataFrame:
    """(source, target): the candidates (source, target) whose lune holds nobody among all nodes."""
    kernel, vectors = METRICS[metric], stored(nodes, block)
    ends = candidates.select("source", "target", vectors.block_of("source").alias("a"), vectors.block_of("target").alias("b"))
    swapped = F.col("a") > F.col("b")
    dealt = ends.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), F.when(swapped, F.col("target")).otherwise(F.col("source")).alias("i"), F.when(swapped, F.col("source")).otherwise(F.col("target")).alias("j"))

    def kept(rows: pa.Table) -> pa.Table:
        pairs = tuple(rows.column(c).to_numpy() for c in ("i", "j"))
        found = _survivors(vectors, kernel, 1.0, rows.column("p")[0].as_py(), rows.column("q")[0].as_py(), pairs)
        return found.select(["i", "j"]).rename_columns(["source", "target"])

    # at most block^2 pairs in a group; few bytes are much work, so groups are spread and not coalesced by size
    n = len(vectors.names)
    return dealt.repartition(max(1, n * (n + 1) // 2), "p", "q").groupBy("p", "q").applyInArrow(kept, "source bigint, target bigint")


def nearer_counts(nodes: DataFrame, half: DataFrame, metric: str = "cityblock", block: int = BLOCK) -> DataFrame:
    """half (node, neighbour, weight) with nearer: how many other nodes are strictly nearer to node than the weight."""
    kernel, vectors = METRICS[metric], stored(nodes, block)

    def counted(rows: pa.Table) -> pa.Table:
        own = rows.column("p")[0].as_py()
        a = vectors.read(own)
        order = np.argsort(a[0])
        at = order[np.searchsorted(a[0][order], rows.column("node").to_numpy())]
        weights = rows.column("weight").to_numpy()
        nearer = np.zeros(len(at), np.int64)
        for r in vectors.names:
            d = _distances(kernel, a, vectors.read(r), r == own)
            step = max(1, CELLS // max(1, d.shape[1]))
            for low in range(0, len(at), step):
                part = slice(low, low + step)
                nearer[part] += (d[at[part]] < weights[part, None]).sum(1)
        return pa.table([rows.column("node"), rows.column("neighbour"), rows.column("weight"), pa.array(nearer)], names=["node", "neighbour", "weight", "nearer"])

    # a hub's edges are split: no group has many more than GROUP_EDGES
    parts = max(1, -(-half.count() // (GROUP_EDGES * max(1, len(vectors.names)))))
    dealt = half.select("node", "neighbour", F.col("weight").cast("float").alias("weight"), vectors.block_of("node").alias("p"), F.pmod(F.xxhash64("neighbour"), F.lit(parts)).alias("part"))
    return dealt.repartition(max(1, parts * len(vectors.names)), "p", "part").groupBy("p", "part").applyInArrow(counted, "node bigint, neighbour bigint, weight float, nearer bigint")
