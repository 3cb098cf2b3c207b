import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopanel.llm import maxscore

SCHEMA = "vec_id long, embedding array<float>, score string, query_id string"


def brute(rows, asked, k):
    def whole(v):
        return [math.floor(1024 * float(np.float32(x))) for x in v]

    good = [(i, whole(v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % asked == 0}):
        v = next(v for i, v in good if i == q)
        best = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard_rows", [50, 100_000])
def test_top_k(spark, shard_rows):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(200)]
    rows += [(None, rows[0][1]), (4001, None), (4002, [None] * 12), (4003, [float("nan")] * 12), (4004, [float("inf")] * 12), (4005, [1.0, 2.0]), (4100, []), (4007, rows[5][1]), (4007, rows[5][1])]
    df = spark.createDataFrame([(*r, "s", None) for r in rows], SCHEMA)
    got = maxscore.top_k(df, df.where(F.col("vec_id") % 100 == 0), shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows, 100, 10)


def test_few_and_large(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1e30]), (2, [3.0, 4.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = maxscore.top_k(df, df.where(F.col("vec_id") % 100 == 0))
    assert [tuple(r)[:3] for r in sorted(got.collect())] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 1), (100, 2, 2), (100, 3, 0)] or got.count() == 6
    assert maxscore.top_k(df.limit(0), df.limit(0)).count() == 0


def test_shards_of_any_size_leave_terms_to_probe():
    rng = np.random.default_rng(8)
    for n in (1, 5, 11, 12, 40, 300, 5_000):
        probed = 0
        rows = np.floor(1024 * rng.normal(size=(n, 64)) * rng.gamma(1, 1, 64)).astype(np.int64)
        rows[n // 2 :] //= 7
        ids = rng.permutation(n).astype(np.int64)
        shard = maxscore.Shard(ids, rows)
        for at in range(min(n, 12)):
            query = rows[at]
            found, scores = shard.best(query, int(ids[at]), 10)
            want = sorted((-int(s), int(i)) for s, i in zip(rows @ query, ids) if i != ids[at])[:10]
            assert list(zip((-scores).tolist(), found.tolist())) == want
            probed += shard.probed
        assert probed > 0 or n <= 11


def test_a_shard_is_built_once_for_all_blocks_of_queries(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    blocks = [(shard, False, np.arange(200) + 1000 * shard, rng.integers(-99, 99, (200, 6))) for shard in (0, 1)]
    asked = [(np.arange(5) + 10 * n, rng.integers(-99, 99, (5, 6))) for n in range(4)]
    rows = sorted([*blocks, *((shard, True, *a) for shard in (0, 1) for a in asked)], key=lambda r: r[:2])
    columns = {"shard": [r[0] for r in rows], "asks": [r[1] for r in rows], "ids": [r[2].astype("<i8").tobytes() for r in rows], "width": [6] * len(rows), "terms": [r[3].astype("<i8").tobytes() for r in rows]}
    built = []

    class Counted(maxscore.Shard):
        def __init__(self, *args):
            built.append(1)
            super().__init__(*args)

    monkeypatch.setattr(maxscore, "Shard", Counted)
    table = pa.table(columns)
    found = list(maxscore._search(iter(table.to_batches(max_chunksize=2)), 3))
    assert len(built) == 2 and len(found) == 2 * 4 * 5
    for out, (shard, ids, query) in zip(found, ((s, i, q) for s in (0, 1) for a in asked for i, q in zip(*a, strict=True)), strict=True):
        scores = blocks[shard][3] @ query
        best = sorted((-int(s), int(i)) for s, i in zip(scores, blocks[shard][2]) if i != ids)[:3]
        assert list(zip((-out["score"]).tolist(), out["vec_id"].tolist())) == best and set(out["query_id"].tolist()) == {int(ids)}
