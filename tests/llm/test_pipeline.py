import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from isopanel.llm.tokens import VOCABULARY

EN = "the of and to in that is was he for it with as his on be at by".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split()


def tables(folder):
    rng = random.Random(9)
    names = [f"{a}{b}" for a in "abcdefgh" for b in ("one", "two", "tri", "qua", "fun")]
    items = [(i, " ".join(rng.choices(names, k=20))) for i in range(5)]
    docs = []
    for i in range(150):
        words = rng.choices((EN if i % 3 else DE) + names, k=rng.randint(30, 90))
        if i % 10 == 3:
            words[10:10] = items[i % 5][1].split()
        if i % 10 == 5:
            words[5:5] = ["mail", "me@some.example", "or", "+1", "(555)", "010-2030"]
        docs.append([i, " ".join(words), "en" if i % 3 else "de", f"s{i % 4}"])
    for i in range(20):
        copy = docs[2 * i][1].split()
        copy[i % len(copy)] = "changed" if i % 2 else copy[i % len(copy)]
        docs.append([200 + i, " ".join(copy), docs[2 * i][2], "s0"])
    docs += [[300, "", "en", "s1"], [301, None, "de", "s1"], [302, "12 34 ?!", "en", "s1"]]
    columns = list(zip(*docs))
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    lengths = [len(t or "") for t in columns[1]]
    pq.write_table(pa.table(dict(zip(kinds.names, [*columns, lengths])), schema=kinds), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}, schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())])), folder / "benchmark.parquet")
    return docs, items


def brute(docs, items):
    docs = [d for d in docs if d[0] < 300]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((d[1] or "").split() for d in docs)]
    group = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if group[i] != group[j] and len(sets[i] & sets[j]) * 100 >= 75 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
        break
    kept = [d for i, d in enumerate(docs) if group[i] == i]
    kept = [d for d in kept if not any(item in d[1] for _, item in items)]
    return {d[0]: re.sub(r"\+1 \(555\) 010-2030", "<phone>", d[1].replace("me@some.example", "<email>")) for d in kept}


def test_pipeline(spark, tmp_path):
    docs, items = tables(tmp_path)
    want = brute(docs, items)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    crc = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in want.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == crc
    assert len(got) == len(want)


def test_stages_keep_columns(spark, tmp_path):
    tables(tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, str(tmp_path))
        assert after.columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
        assert 0 < after.count() <= df.count()
