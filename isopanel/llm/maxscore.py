"""Exact top-k by integer inner product with MaxScore.

A query's terms are its components and a shard's postings are its columns. In a shard each term's contribution lies
between two bounds; taken from the lower one it is never negative. The k rows that the widest terms favour are scored in
full and give a threshold; terms whose widths together can't reach it are non-essential. Every row gets its essential
part, and the other terms are probed, widest first, for rows that can still compete; the threshold rises with what k
rows have already. Shards give their best k and these are merged.

Queries and candidates travel as blocks: each block of queries goes to every shard, which is built once and then asked
by one block after the other, so neither side needs to fit anywhere whole. Ties go to the smaller id.

Defined cases: vectors that are null, or hold a null or a non-finite component, and rows without an id take no part;
vectors of different lengths are compared over the shorter (a missing term scores nothing); rows with the query's id
are its own; of repeated queries with one id the least vector asks; repeated candidates each count; scores beyond a
long end at its bounds; an empty vector scores 0; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

SCALE = 1024.0
QUERY_BLOCK, SHARD_ROWS = 256, 32_768
#: Terms traversed before there is a threshold; terms probed before rows are given up again.
LEAD_TERMS, PROBES = 8, 4


def usable(vector: Column) -> Column:
    """All components are there and finite; an array's comparison counts NaN as larger than infinity."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, scale: float = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of both tables' (vec_id, embedding), components turned to floor(scale * x)."""
    spark = candidates.sparkSession
    ids = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = candidates.where(ids).select("vec_id", "embedding")
    asked = queries.where(ids).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-candidates.count() // shard_rows))
    spread = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    block = "ids binary, width int, terms binary"
    held = map_batches(spread.repartition("shard").sortWithinPartitions("shard"), _blocks, f"shard int, {block}", scale, "shard", shard_rows)
    packed = map_batches(asked, _blocks, f"shard int, {block}", scale, None, QUERY_BLOCK)
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    # a shard comes first, then the blocks of queries one after the other
    both = held.withColumn("asks", F.lit(False)).unionByName(packed).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = map_batches(both, _search, "query_id bigint, vec_id bigint, score bigint", k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, shard: str | None, size: int) -> Iterator[dict[str, Any]]:
    """Rows of a shard as few blocks: ids and terms side by side."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def give(key: tuple[int, int]) -> dict[str, Any]:
        parts = held.pop(key)
        ids, terms = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"shard": [key[0]], "ids": [ids.tobytes()], "width": [key[1]], "terms": [terms.tobytes()]}

    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        where = batch.column(shard).to_numpy() if shard else np.zeros(len(ids), np.int32)
        vectors = batch.column("embedding")
        widths = pa.compute.list_value_length(vectors).to_numpy()
        for key in sorted(set(zip(where.tolist(), widths.tolist(), strict=True))):
            at = np.flatnonzero((where == key[0]) & (widths == key[1]))
            flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.clip(np.floor(flat * scale), -(2.0**63), 2.0**63 - 1024).astype("<i8").reshape(len(at), key[1])
            held.setdefault(key, []).append((ids[at].astype("<i8"), whole))
            if sum(len(x[0]) for x in held[key]) >= size:
                yield give(key)
    for key in list(held):
        yield give(key)


def _matrix(ids: bytes, width: int, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(terms, "<i8").reshape(len(names), width)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[dict[str, Any]]:
    """Rows come by shard, its own before those that ask; each is built once, for queries of one width."""
    own: int | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    built: dict[tuple[int, int], Shard] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != own:
                own, held, built = row["shard"], [], {}
            ids, terms = _matrix(row["ids"], row["width"], row["terms"])
            if not row["asks"]:
                held.append((ids, terms))
                continue
            for place, (names, rows) in enumerate(held):
                shared = min(terms.shape[1], rows.shape[1])
                if (place, shared) not in built:
                    built[place, shared] = Shard(names, rows[:, :shared])
                for query_id, query in zip(ids.tolist(), terms[:, :shared], strict=True):
                    found, scores = built[place, shared].best(query, query_id, k)
                    yield {"query_id": np.full(len(found), query_id), "vec_id": found, "score": scores}


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(rows[order].T)
        self.low, self.high = rows.min(0, initial=2**62), rows.max(0, initial=-(2**62))
        self.largest = float(np.abs(rows.astype(np.float64)).max(initial=0))
        #: Whole numbers below 2^53 add up exactly in floating point, and faster.
        self.exact = self.postings.astype(np.float64) if self.largest < 2.0**52 else self.postings
        #: Non-essential terms of the last query.
        self.probed = 0

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the shard's k best rows, those with the query's own id left out."""
        most = np.abs(query.astype(np.float64)).sum() * max(self.largest, 1)
        if most >= 2.0**61:
            return self._large(query, own, k)
        ends = np.stack([query * self.low, query * self.high])
        least, width = ends.min(0), np.abs(ends[1] - ends[0])
        terms = np.argsort(-width, kind="stable")
        terms = terms[width[terms] > 0]
        base = int(least.sum())
        #: What the terms from a position on can add at most.
        rest = np.append(np.cumsum(width[terms][::-1])[::-1], 0)
        postings = self.exact if most < 2.0**52 else self.postings
        query = query.astype(postings.dtype)
        alive = np.flatnonzero(self.ids != own)
        # the widest terms are essential whatever the threshold; the rows they favour give the first one
        first = min(LEAD_TERMS, len(terms))
        scores = self._sum(postings, query, least, terms[:first])[alive]
        threshold = -1
        if len(alive) > k:
            lead = alive[np.argpartition(scores, len(scores) - k)[-k:]]
            threshold = int((query[terms] @ postings[np.ix_(terms, lead)]).min()) - int(least[terms].sum())
        essential = max(first, min(int(np.searchsorted(-rest, -threshold, "right")), len(terms)) if threshold >= 0 else len(terms))
        self.probed = len(terms) - essential
        if essential > first:
            scores += self._sum(postings, query, least, terms[first:essential])[alive]
        for at in range(essential, len(terms) + PROBES, PROBES):
            if len(alive) > k:  # what rows have already, they keep
                threshold = max(threshold, int(np.partition(scores, len(scores) - k)[-k]))
            stay = scores + rest[min(at, len(terms))] >= threshold
            alive, scores = alive[stay], scores[stay]
            for t in terms[at : at + PROBES]:
                scores = scores + (query[t] * postings[t, alive] - least[t])
        return self._cut(alive, scores.astype(np.int64) + base, k)

    def _sum(self, postings: np.ndarray, query: np.ndarray, least: np.ndarray, terms: np.ndarray) -> np.ndarray:
        return query[terms] @ postings[terms] - int(least[terms].sum()) if len(terms) else np.zeros(len(self.ids), postings.dtype)

    def _cut(self, alive: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[order]], scores[order]

    def _large(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms too large for 64-bit sums: whole numbers of any size, no bounds."""
        alive = np.flatnonzero(self.ids != own)
        scores = query.astype(object) @ self.postings[:, alive].astype(object) if len(query) else np.zeros(len(alive), object)
        scores = np.array([min(max(int(s), -(2**63) + 1), 2**63 - 1) for s in scores], np.int64)
        return self._cut(alive, scores, k)
