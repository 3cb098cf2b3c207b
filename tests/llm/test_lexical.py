import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from isopanel.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(d, terms(t)) for d, t, *_ in docs]
    n, length = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    held = Counter(w for _, t in counted for w in set(t))
    out = []
    for item_id, text, *_ in items:
        scores = []
        for doc_id, t in counted:
            tf = Counter(t)
            m = 25 + 75 * len(t) * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in terms(text) if tf[w])
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def in_order(rows):
    return sorted(tuple((x is not None, x) for x in r) for r in rows)


DOCS, ITEMS = "doc_id long, text string, rank string, number int", "item_id long, text string, score string"


@pytest.mark.parametrize(("bucket", "chunk", "block", "step"), [(2048, 2_000_000, 200_000, 1 << 20), (7, 300, 60, 5)])
def test_equals_brute_force(spark, monkeypatch, bucket, chunk, block, step):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "Übel", "x1", "X1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 80, 300]))) + rng.choice(["", ".", "!?"]), "r", 1) for i in range(400)]
    docs += [(400 + i, docs[7][1], "r", 2) for i in range(60)]  # ties
    docs += [(None, docs[7][1], None, None), (None, docs[8][1], None, None), (9, docs[9][1], "r", 1), (500, None, "r", 1), (501, "", "r", 1), (502, " .,-\x7f", "r", 1), (503, "w3 " * 40_000, "r", 1)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40))), "s") for i in range(25)]
    items += [(25, None, "s"), (26, "", None), (27, "nowhere", "s"), (28, "w1 W1 w1", "s"), (28, "w2", "s"), (None, "É x1", "s"), (29, docs[7][1], "s")]
    run = lexical._search

    def small(batches, *args):  # tasks have the module as it is written
        lexical.BUCKET_ROWS, lexical.CHUNK_NUMBERS = bucket, chunk
        yield from run(batches, *args)

    monkeypatch.setattr(lexical, "_search", small)
    monkeypatch.setattr(lexical, "STEP", step)
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)).collect()
    assert in_order(map(tuple, got)) == in_order(brute(docs, items))


def test_terms_in_parts(monkeypatch):
    monkeypatch.setattr(lexical, "STEP", 3)
    for text in ("", "a", "Ab,cÉ d" * 20, "x" * 50 + " y", " " * 9):
        assert [w.decode() for part in lexical.terms_of(text.encode()) for w in part] == terms(text)


def test_buckets_and_vectors_are_pruned():
    """A threshold ends the search at short vectors, and few of the others are scored again."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(5, 60, 4000)
    rows = {"n": sizes, "terms": [np.sort(rng.choice(300, n, replace=False)).astype("<i4") for n in sizes]}
    import pyarrow as pa

    table = pa.table({"doc_id": np.arange(4000), "n_terms": sizes, "terms": [t.tobytes() for t in rows["terms"]], "occurrences": [np.ones(n, "<i4").tobytes() for n in sizes]})
    query = lexical._query(lexical.Item(0, 0, {str(t).encode(): 1 for t in range(0, 300, 9)}), {str(t).encode(): t for t in range(300)}, rng.integers(1, 9000, 300))
    boards = [lexical.Board(query, threshold, 10) for threshold in (1, 1)]
    collection = lexical.Collection(4000, int(sizes.sum()))
    lexical._searched(table, collection, boards[:1])
    assert len(boards[0].scores) == 10 and boards[0].rescored < 100
    again = lexical.Board(query, boards[0].threshold, 10)
    lexical._searched(table, collection, [again])
    assert again.ids.tolist() == boards[0].ids.tolist() and again.scores.tolist() == boards[0].scores.tolist() and again.rescored < 100


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 1)], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert lexical.search(docs.limit(0), items).count() == 0 == lexical.search(docs, items.limit(0)).count()
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
