"""Ranked lexical search: the exact k best documents of each item, by buckets of impact vectors in order of length.

A document's impact vector has, for each of its terms that some item asks for, a whole number that grows with the
term's occurrences and shrinks with the document's length; an item's vector has its terms' weights times their
repeats, and a score is the inner product of both. Texts are read once: what is kept of them are their vectors of
occurrences, a small table in the shared folder, from which the collection's counts come too.

A task orders its vectors by length and cuts them into buckets. For an item and its threshold (the k-th best score so
far) Cauchy-Schwarz ends the search at the first bucket whose longest vector is too short. Inside a bucket the item's
heaviest terms are focus coordinates, as many as it takes until no vector can compete by the others alone, and more
while many vectors are left; a vector's bound is its part over them and, for the rest, the lesser of two: Cauchy-Schwarz over what is left of its length, and
the sum of the other coordinates' largest values in the bucket. Vectors whose bound reaches the threshold are scored
again in whole numbers. First thresholds come from the exact scores of every SEED_FILES-th file of vectors: the k-th
best of any rows is a lower bound for that of all.

Items are read in blocks of about BLOCK_TERMS terms, which a task holds; every further block is one more pass over the
texts. An item is never split.

Defined cases: a null or empty text has no terms and is in no result; every row of items asks for itself, also where
ids repeat or are null, and gets no rows where no document shares a term of some weight; rows of documents are
documents, also where ids repeat; a null doc_id comes before others of the same score, and equal rows both count;
empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_batches, slices, written

BEST = 10
BLOCK_TERMS, SEED_FILES = 200_000, 64
#: Vectors of a bucket; numbers in the vectors that a task orders together.
BUCKET_ROWS, CHUNK_NUMBERS = 2048, 2_000_000
#: Coordinates are added, so many at a time, while more vectors than this are left in a bucket.
FEW, MORE = 32, 4
#: Bytes of a text that are split together, and the bytes between terms (fixed by the contract; A-Z are lowered first).
STEP = 1 << 20
BETWEEN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bounds in floating point count as so much larger.
SLACK = 1 + 1e-9


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the terms of UTF-8 text; only its ASCII letters are lowered."""
    plain = text.lower().translate(BETWEEN)
    low = 0
    while low < len(plain):
        cut = plain.find(b" ", low + STEP) if len(plain) - low > STEP else -1
        yield plain[low : cut if cut >= 0 else len(plain)].split()
        low = cut if cut >= 0 else len(plain)


class Item(NamedTuple):
    number: int
    item_id: int | None
    terms: dict[bytes, int]


class Query(NamedTuple):
    """An item's vector, heaviest terms first, and rest: the length of what follows each of them."""

    number: int
    terms: np.ndarray
    weights: np.ndarray
    rest: np.ndarray


class Collection(NamedTuple):
    documents: int
    terms: int

    def weight(self, documents: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * documents + 1)))

    def impacts(self, occurrences: np.ndarray, n_terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        spread = np.array([25 + 75 * n * self.documents // self.terms for n in n_terms.tolist()], np.int64)
        return 1_000_000_000 * occurrences // (1000 * occurrences + 8 * np.repeat(spread, sizes))


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score of the k best of docs (doc_id, text) for each row of items (item_id, text)."""
    numbered = written(items.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "lexical-items")
    size = F.length(F.coalesce("text", F.lit(""))) / 4
    blocks = max(1, math.ceil((numbered.agg(F.sum(size).alias("n")).first()["n"] or 0) / BLOCK_TERMS))
    part = F.pmod(F.xxhash64("number"), F.lit(blocks))
    found = [_block(docs.select("doc_id", "text"), _read(numbered.where(part == b)), k) for b in range(blocks)]
    result = reduce(DataFrame.unionAll, found).join(numbered.select("number", "item_id"), "number")
    return result.select("item_id", "rank", "doc_id", "score")


def _read(items: DataFrame) -> list[Item]:
    """One block of about BLOCK_TERMS terms comes to the driver."""
    found = []
    for row in items.collect():
        terms: Counter[bytes] = Counter()
        for part in terms_of((row["text"] or "").encode()):
            terms.update(part)
        found.append(Item(row["number"], row["item_id"], terms))
    return found


def _block(docs: DataFrame, items: list[Item], k: int) -> DataFrame:
    """number, rank, doc_id, score: a table of k rows for each item at most."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for item in items for t in item.terms}))}
    vectors = written(map_batches(docs, _vectors, "doc_id bigint, n_terms bigint, terms binary, occurrences binary", vocabulary), "lexical-vectors")
    counts = vectors.agg(F.count_if(F.col("n_terms") > 0).alias("documents"), F.sum("n_terms").alias("terms")).first()
    collection = Collection(counts["documents"], counts["terms"] or 0)
    holding = np.zeros(len(vocabulary), np.int64)
    # at most a row for each term of the block
    for row in map_batches(vectors.select("terms"), _holding, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        holding[row["term"]] = row["n"]
    weights = np.array([collection.weight(n) for n in holding.tolist()], np.int64)
    queries = [q for q in (_query(item, vocabulary, weights) for item in items if collection.terms) if len(q.terms)]
    thresholds = {}
    if queries:
        seeds = docs.sparkSession.read.schema(vectors.schema).parquet(*sorted(vectors.inputFiles())[::SEED_FILES])
        best = _ranked(seeds, collection, queries, {}, k).where(F.col("rank") == k)
        thresholds = {r["number"]: r["score"] for r in best.select("number", "score").collect()}  # a row for each item of the block
    result = written(_ranked(vectors, collection, queries, thresholds, k), "lexical-best")
    forget(vectors)
    return result


def _query(item: Item, vocabulary: dict[bytes, int], weights: np.ndarray) -> Query:
    terms = np.array([vocabulary[t] for t in item.terms], np.int64)
    own = np.array(list(item.terms.values()), np.int64) * weights[terms]
    order = np.argsort(-own, kind="stable")
    order = order[own[order] > 0]
    squares = np.append(np.cumsum((own[order].astype(float) ** 2)[::-1])[::-1], 0.0)
    return Query(item.number, terms[order], own[order], np.sqrt(squares))


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[dict[str, Any]]:
    for whole in batches:
        for batch in slices(whole):
            n_terms, terms, occurrences = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n, seen = 0, Counter[int | None]()
                for part in terms_of(text or b""):
                    n += len(part)
                    seen.update(map(vocabulary.get, part))
                seen.pop(None, None)
                n_terms.append(n)
                terms.append(np.fromiter(seen, "<i4", len(seen)).tobytes())
                occurrences.append(np.fromiter(seen.values(), "<i4", len(seen)).tobytes())
            yield {"doc_id": batch.column("doc_id"), "n_terms": n_terms, "terms": terms, "occurrences": occurrences}


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """How many vectors have each term: a row for each term and task."""
    counts = np.zeros(0, np.int64)
    for batch in batches:
        new = np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=len(counts))
        new[: len(counts)] += counts
        counts = new
    if len(at := np.flatnonzero(counts)):
        yield {"term": at.astype(np.int32), "n": counts[at]}


def _ranked(vectors: DataFrame, collection: Collection, queries: list[Query], thresholds: dict[int, int], k: int) -> DataFrame:
    found = map_batches(vectors, _search, "number bigint, doc_id bigint, score bigint", collection, queries, thresholds, k)
    best = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("number", "rank", "doc_id", "score")


def _search(batches: Iterator[pa.RecordBatch], collection: Collection, queries: list[Query], thresholds: dict[int, int], k: int) -> Iterator[dict[str, Any]]:
    boards = [Board(q, thresholds.get(q.number, 1), k) for q in queries]
    held: list[pa.RecordBatch] = []
    numbers = 0
    for batch in batches:
        held.append(batch)
        numbers += (pa.compute.sum(pa.compute.binary_length(batch.column("terms"))).as_py() or 0) // 4 + batch.num_rows
        if numbers >= CHUNK_NUMBERS:
            _searched(pa.Table.from_batches(held), collection, boards)
            held, numbers = [], 0
    if held:
        _searched(pa.Table.from_batches(held), collection, boards)
    for board in boards:
        if len(board.scores):
            ids = pa.array(board.ids, mask=board.missing)
            yield {"number": [board.query.number] * len(ids), "doc_id": ids, "score": board.scores}


def _searched(rows: pa.Table, collection: Collection, boards: list[Board]) -> None:
    """Rows in order of length, bucket after bucket."""
    sizes = np.array([len(t) // 4 for t in rows.column("terms").to_pylist()], np.int64)
    terms, occurrences = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<i4").astype(np.int64) for c in ("terms", "occurrences"))
    impacts = collection.impacts(occurrences, rows.column("n_terms").to_numpy(), sizes)
    starts = np.cumsum(sizes) - sizes
    lengths = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), impacts.astype(float) ** 2, len(sizes)))
    missing = rows.column("doc_id").is_null().to_numpy()
    ids = np.where(missing, -(2**63), rows.column("doc_id").fill_null(0).to_numpy())
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    asked = boards
    for low in range(0, len(order), BUCKET_ROWS):
        at = order[low : low + BUCKET_ROWS]
        asked = [b for b in asked if b.query.rest[0] * lengths[at[0]] * SLACK >= b.threshold]
        if not asked:
            break
        inside = _spans(starts[at], sizes[at])
        bucket = Bucket(ids[at], missing[at], lengths[at], sizes[at], terms[inside], impacts[inside])
        for board in asked:
            bucket.search(board)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Board:
    """The best so far of a query, and the least score that still matters."""

    def __init__(self, query: Query, threshold: int, k: int):
        self.query, self.threshold, self.k = query, threshold, k
        self.ids, self.scores, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        #: Vectors that were scored again.
        self.rescored = 0

    def add(self, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        self.rescored += len(ids)
        good = scores >= self.threshold
        ids, missing, scores = (np.concatenate(x) for x in ((self.ids, ids[good]), (self.missing, missing[good]), (self.scores, scores[good])))
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.missing, self.scores = ids[order], missing[order], scores[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


class Bucket:
    """Vectors in falling order of length, by row and by term."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.ids, self.missing, self.lengths, self.sizes, self.terms, self.impacts = ids, missing, lengths, sizes, terms, impacts
        self.starts = np.cumsum(sizes) - sizes
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = np.repeat(np.arange(len(ids)), sizes)[order], impacts[order].astype(float)
        self.known, firsts = np.unique(terms[order], return_index=True)
        self.cuts = np.append(firsts, len(terms))
        #: The coordinates' upper bounds; lower ones are zero.
        self.most = np.maximum.reduceat(self.values, firsts) if len(terms) else np.zeros(0)

    def search(self, board: Board) -> None:
        query = board.query
        place = np.minimum(np.searchsorted(self.known, query.terms), len(self.known) - 1)
        there = self.known[place] == query.terms
        most = np.where(there, self.most[place] * query.weights, 0.0)
        others = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        # focus coordinates: no vector reaches the threshold by the terms after them
        focus = int(np.argmax(np.minimum(query.rest * self.lengths[0], others) * SLACK < board.threshold))
        part, squares = np.zeros(len(self.ids)), np.zeros(len(self.ids))

        def read(low: int, high: int) -> None:
            for t in low + np.flatnonzero(there[low:high]):
                span = slice(self.cuts[place[t]], self.cuts[place[t] + 1])
                rows, values = self.rows[span], self.values[span]
                part[rows] += query.weights[t] * values
                squares[rows] += values * values

        read(0, focus)
        alive = np.flatnonzero(part)
        while True:
            if len(alive) > board.k:  # a part is a lower bound of its score
                least = np.partition(part[alive], len(alive) - board.k)[-board.k]
                board.threshold = max(board.threshold, math.floor(least / SLACK))
            left = np.sqrt(np.maximum(self.lengths[alive] ** 2 * SLACK - squares[alive], 0.0))
            bound = part[alive] + np.minimum(query.rest[focus] * left, others[focus])
            alive = alive[bound * SLACK >= board.threshold]
            if len(alive) <= FEW or focus == len(query.terms):
                break
            # further coordinates make the bounds of those left closer
            low, focus = focus, min(focus + MORE, len(query.terms))
            read(low, focus)
        if len(alive):
            board.add(self.ids[alive], self.missing[alive], self._exact(query, alive))

    def _exact(self, query: Query, rows: np.ndarray) -> np.ndarray:
        """Whole-number scores of rows over all of the query's terms."""
        order = np.argsort(query.terms)
        names, weights = query.terms[order], query.weights[order]
        inside = _spans(self.starts[rows], self.sizes[rows])
        terms = self.terms[inside]
        at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
        products = np.where(names[at] == terms, weights[at] * self.impacts[inside], 0)
        return np.add.reduceat(products, np.cumsum(self.sizes[rows]) - self.sizes[rows])
