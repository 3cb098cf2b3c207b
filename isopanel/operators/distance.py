"""Distances between all rows, in blocks, and what needs no table of all pairs: nearest neighbours and balls.

Rows are packed as blocks of about `block` vectors, which lie as files in the shared folder; a task reads those of its
square of blocks (see pairs) and a NumPy kernel gives the distances of two, so no vectors are shuffled. Distances are summed
in double and kept as float. A kernel that keeps the k nearest or what is within tau never lets the others out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
PAIRS = "i bigint, j bigint, d float"
Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Rows of a block that meet another block at once: their sums stay in the processor's cache.
ROWS = 64


def _summed(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray], None]) -> np.ndarray:
    """Sums over the coordinates, in their order, of a term of the differences of all rows of a and b."""
    out = np.zeros((len(a), len(b)))
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for low in range(0, len(a), ROWS):
        part = out[low : low + ROWS]
        apart = np.empty_like(part)
        for p, q in zip(x[:, low : low + ROWS, None], y, strict=True):
            np.subtract(p, q, out=apart)
            term(apart)
            part += apart
    return out


def cityblock(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(a, b, lambda x: np.abs(x, out=x))


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_summed(a, b, lambda x: np.square(x, out=x)))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - (a @ b.T) / lengths


#: Codes of rough distances go up to here, and so many rows of a block meet another at once.
CODES, CODED = 65_500, 128


def rough_cityblock(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """Codes of all distances of rows of a and b, their unit and the most they are off: |code * unit - distance| <= off.

    Coordinates become 16-bit whole numbers, whose sums of larger ones tell the distance, as |p - q| is
    2 max(p, q) - p - q; all is modulo 2^16, which no distance reaches. None where a number is not finite.
    """
    if not len(a) or not len(b) or a.shape[1] > CODES // 2:
        return None
    most = max(np.abs(a).sum(1).max(), np.abs(b).sum(1).max())
    if not np.isfinite(most):
        return None
    unit = max(2 * most / (CODES - a.shape[1]), 1e-300)  # each coordinate is off by one at most
    (p, p_off), (q, q_off) = ((c, np.abs(c * unit - x).sum(1).max()) for x in (a, b) for c in (np.rint(x / unit).astype(np.int16),))
    left, right = np.ascontiguousarray(p.T), np.ascontiguousarray(q.T)
    out = np.zeros((len(a), len(b)), np.int16)
    for low in range(0, len(a), CODED):
        part = out[low : low + CODED]
        larger = np.empty_like(part)
        for x, y in zip(left[:, low : low + CODED, None], right, strict=True):
            np.maximum(x, y, out=larger)
            part += larger
    out = out.view(np.uint16)
    out *= 2
    out -= p.sum(1, dtype=np.int64).astype(np.uint16)[:, None]
    out -= q.sum(1, dtype=np.int64).astype(np.uint16)[None]
    return out, unit, float(p_off + q_off + 1e-6 * most)


def named_cityblock(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of rows of a and b one by one: the same bits as the kernel's, added up in the same order."""
    apart = np.ascontiguousarray(np.abs(a - b).T)
    out = np.zeros(len(a))
    for x in apart:
        out += x
    return out


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a matrix."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def pairs_within(metric: str, a: np.ndarray, b: np.ndarray, most: np.ndarray | float, keep: np.ndarray | None = None, weights: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of rows (of keep) whose distance is at most a number, or one for each row of a, and the distances.

    Without weights the distances are only made where codes do not tell, and are 0 elsewhere.
    """
    most = np.broadcast_to(np.asarray(most, np.float32), len(a))
    rough = rough_cityblock(a, b) if METRICS[metric] is cityblock else None
    if rough is None:
        d = METRICS[metric](a, b).astype(np.float32)
        near = d <= most[:, None]
        at, to = np.nonzero(near if keep is None else near & keep)
        return at, to, d[at, to]
    codes, unit, off = rough
    last = np.clip((most.astype(np.float64) + off) / unit + 1, -1, CODES)
    near = (codes <= np.maximum(last, 0).astype(np.uint16)[:, None]) & (last >= 0)[:, None]
    if keep is not None:
        near &= keep
    at, to = places(near)
    d = np.zeros(len(at), np.float32)
    open_ = slice(None) if weights else np.flatnonzero(codes[at, to] * unit >= (most.astype(np.float64) - off - unit)[at])
    for low in range(0, len(part := np.arange(len(at))[open_]), NAMED):
        some = part[low : low + NAMED]
        d[some] = named_cityblock(a[at[some]], b[to[some]])
    near = d <= most[at]
    return at[near], to[near], d[near]


#: Pairs whose distances are made one by one at once.
NAMED = 4096
#: Distance kernels by name; add to it to have more.
METRICS: dict[str, Metric] = {"cityblock": cityblock, "manhattan": cityblock, "euclidean": euclidean, "cosine": cosine}


def vectors(nodes: DataFrame, node: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of rows that have both."""
    return nodes.where(F.col(node).isNotNull() & F.col(vector).isNotNull()).select(F.col(node).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": rows["block"].iloc[:1], "ids": [rows["id"].to_numpy("<i8").tobytes()], "values": [np.stack(rows["v"].to_list()).astype("<f8").tobytes()]})


def blocks(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Packed vectors (block, ids, values) of (id, v), and how many blocks."""
    n = max(1, -(-nodes.count() // block))
    numbered = nodes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return numbered.groupBy("block").applyInPandas(_pack, "block int, ids binary, values binary"), n


def block_pairs(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(p, q, block, ids, values): both blocks of each pair p <= q."""
    packed, n = blocks(nodes, block)
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = packed.withColumn("other", other)
    return spread.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "ids", "values")


def _matrix(ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(values, "<f8").reshape(len(names), -1)


def _by_block_pair(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    parts = sorted(zip(*(rows.column(c).to_pylist() for c in ("block", "ids", "values")), strict=True))
    (a, x), (b, y) = _matrix(*parts[0][1:]), _matrix(*parts[-1][1:])
    return a, x, b, y, len(parts) == 1


def _table(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "d": pa.array(d, pa.float32())})


def pairwise(nodes: DataFrame, metric: str = "cityblock", within: float | None = None, block: int = BLOCK) -> DataFrame:
    """(i, j, d) with i < j of (id, v): all pairs, or those within a distance."""
    from .pairs import Pairs

    kernel = METRICS[metric]

    def distances(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], same: bool) -> list[pa.Table]:
        (a, x), (b, y) = first, second
        keep = a[:, None] < b[None] if same else a[:, None] != b[None]
        if within is not None:
            at, to, near = pairs_within(metric, x, y, within, keep)
            return [_table(np.minimum(a[at], b[to]), np.maximum(a[at], b[to]), near)]
        d = kernel(x, y).astype(np.float32)
        at, to = np.nonzero(keep)
        return [_table(np.minimum(a[at], b[to]), np.maximum(a[at], b[to]), d[at, to])]

    return Pairs(nodes, {}, block=block).over(distances, PAIRS)


def _best(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> pa.Table:
    """The first k of each i by (d, j)."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.diff(i, prepend=i[:1] - 1)) if len(i) else i
    place = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i)))
    return _table(i[place < k], j[place < k], d[place < k])


def nearest(nodes: DataFrame, k: int, metric: str = "cityblock", block: int = BLOCK) -> DataFrame:
    """(i, j, d, rank): the k nearest others of each i, ties to the smaller j.

    A task keeps the k nearest of its square of blocks, so few candidates leave it. Where codes show that a pair is farther
    than the k nearest that are held, its distance is never made.
    """
    from .pairs import Pairs

    def best(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], same: bool, held: dict[int, Nearest], names: tuple[int, int]) -> None:
        (a, x), (b, y) = first, second
        rough = rough_cityblock(x, y) if METRICS[metric] is cityblock else None
        d = METRICS[metric](x, y).astype(np.float32) if rough is None else None
        sides = [(names[0], a, x, b, y, False)] + ([] if same else [(names[1], b, y, a, x, True)])
        for name, own, u, others, v, flipped in sides:
            mine = held.setdefault(name, Nearest(own, k))
            if rough is None:
                m = np.ascontiguousarray(d.T) if flipped else d
                if same:
                    m = np.where(own[:, None] == others[None], np.float32(np.inf), m)
                # all that are as near as the k-th, then ties by id
                edge = np.partition(m, min(k, m.shape[1]) - 1, axis=1)[:, min(k, m.shape[1]) - 1]
                at, to = np.nonzero((m <= edge[:, None]) & np.isfinite(m))
                mine.meet(at, others[to], m[at, to])
                continue
            codes, unit, off = rough
            if same:
                codes[own[:, None] == others[None]] = CODES
            codes = codes.T if flipped else codes
            last = mine.last()
            if (unknown := ~np.isfinite(last)).any():
                place = min(k, codes.shape[1]) - 1
                last[unknown] = np.partition(codes[unknown], place, axis=1)[:, place] * unit + off
            last = np.clip((last + off) / unit + 1, 0, CODES).astype(np.uint16)
            at, to = places(rough[0] <= last[None])[::-1] if flipped else places(codes <= last[:, None])
            if same:
                at, to = at[(other := own[at] != others[to])], to[other]
            near = [named_cityblock(u[at[n : n + NAMED]], v[to[n : n + NAMED]]).astype(np.float32) for n in range(0, len(at), NAMED)]
            mine.meet(at, others[to], np.concatenate([np.zeros(0, np.float32), *near]))

    found = Pairs(nodes, {}, block=block).held(best, lambda held: [x.table() for x in held.values()], PAIRS)
    order = Window.partitionBy("i").orderBy("d", "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Nearest:
    """The k nearest so far of each node of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.at, self.to, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def last(self) -> np.ndarray:
        """The distance of the k-th, infinite where there are fewer."""
        out = np.full(len(self.ids), np.inf)
        full = np.bincount(self.at, minlength=len(out)) >= self.k
        ends = np.append(np.flatnonzero(np.diff(self.at)), len(self.at) - 1) if len(self.at) else self.at
        out[self.at[ends]] = self.d[ends]
        out[~full] = np.inf
        return out

    def meet(self, at: np.ndarray, to: np.ndarray, d: np.ndarray) -> None:
        """Others at distances from the nodes at places."""
        if len(at):
            best = _best(np.concatenate([self.at, at]), np.concatenate([self.to, to]), np.concatenate([self.d, d]), self.k)
            self.at, self.to, self.d = (best.column(c).to_numpy() for c in ("i", "j", "d"))

    def table(self) -> pa.Table:
        return _table(self.ids[self.at], self.to, self.d)


#: Ambiguity codes of aligned sequences (fixed).
AMBIGUOUS = "XBZJUO?"


def pairwise_hamming(nodes: DataFrame, gaps_count: bool = True, skip_ambiguous: bool = False, block: int = BLOCK) -> DataFrame:
    """(i, j, d): differing places of aligned strings (id, s) of one length.

    A gap '-' is a letter like others, or drops its place for that pair; so do ambiguity codes with skip_ambiguous.
    Strings of other lengths than the most have null neighbours: align them first.
    """
    dropped = ("" if gaps_count else "-") + (AMBIGUOUS if skip_ambiguous else "")
    letters = nodes.select("id", F.transform(F.split("s", ""), F.ascii).cast("array<double>").alias("v"))

    def distances(rows: pa.Table) -> pa.Table:
        a, x, b, y, same = _by_block_pair(rows)
        x, y = x.astype(np.uint8), y.astype(np.uint8)
        d = np.zeros((len(a), len(b)), np.int32)
        codes = np.frombuffer(dropped.encode(), np.uint8)
        for p, q in zip(x.T, y.T, strict=True):
            differ = p[:, None] != q[None]
            if len(codes):
                differ &= ~np.isin(p, codes)[:, None] & ~np.isin(q, codes)[None]
            d += differ
        at, to = np.nonzero(a[:, None] < b[None] if same else a[:, None] != b[None])
        return _table(np.minimum(a[at], b[to]), np.maximum(a[at], b[to]), d[at, to].astype(np.float32))

    return block_pairs(letters, block).groupBy("p", "q").applyInArrow(distances, PAIRS)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(i, j, d) in both directions."""
    others = [c for c in pairs.columns if c not in ("i", "j")]
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *others))


def finite(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) < float("inf"))


