import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from isopanel.llm import idfiles, packing
from isopanel.llm.tokens import VOCABULARY, WordEncoder

ODD = ["", " ", None, "don't I'LL stop", "á  b c\x85d́ e", "<|startoftext|>x <|endoftext|>", "\x1cab\x1fc d", "ΣΑΣ İstanbul ﬁ 三 😀😀 123", "a\u0000b", "ÀÉß ÿ ×÷ ª", "x" * 300]
SCHEMA = "doc_id long, text string, length string, sequence_id int, ids_crc32 string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def brute(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def rows():
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choice(["the", "Ereaen,", "ündst", "42", "!?", "naïve"]) for _ in range(rng.choice([1, 30, 300, 5000, 9000]))) for _ in range(60))]
    out = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return [*out, out[20], out[20], (None, "no id", None, None, None)]


def test_encoder_equals_the_library(tokenizer):
    words = WordEncoder(memo=50)
    for _, text, *_ in rows():
        assert words.encode(text or "").tolist() == brute(tokenizer, text)


def test_other_vocabularies_go_to_the_library():
    path = VOCABULARY.replace("word_bpe_49k", "byte_bpe_50k")
    words, library = WordEncoder(path), Tokenizer.from_file(path)
    assert WordEncoder().by_words and not words.by_words
    for _, text, *_ in rows()[:30]:
        assert words.encode(text or "").tolist() == brute(library, text)


@pytest.mark.parametrize("width", [1, 5, 8, 16, 17, 31])
def test_bits(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint32)
    data = idfiles.pack_bits(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert (idfiles.unpack_bits(data, width, 1001) == ids).all()


def test_files(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    files = idfiles.write_ids(docs, f"file://{tmp_path}/ids", file_ids=20_000)
    got = [tuple(r) for r in idfiles.read_ids(files).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows(), key=lambda r: (-1 if r[0] is None else r[0])):
        ids = brute(tokenizer, text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert files.count() > 4
    reader = idfiles.Reader(files.orderBy("part").first()["path"])
    whole = reader.ids(0, reader.n_ids)
    assert (reader.ids(5, 17) == whole[5:17]).all() and len(reader.ids(3, 3)) == 0


def test_files_of_nothing(spark):
    assert idfiles.read_ids(idfiles.write_ids(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("block", [7, 64, idfiles.BLOCK])
def test_several_blocks(tmp_path, block):
    """Documents and ranges across the edges of blocks."""
    rng = np.random.default_rng(block)
    sizes = [0, 1, block - 1, block, block + 1, 0, 2 * block + 3, 5, 3 * block]
    docs = [(i if i != 3 else None, rng.integers(0, 49_152, n).astype(np.uint32)) for i, n in enumerate(sizes)]
    path = f"file://{tmp_path}/ids.bin"
    writer = idfiles.Writer(path, 49_152, block)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = idfiles.Reader(path)
    every = np.concatenate([ids for _, ids in docs])
    starts = np.cumsum([0, *sizes[:-1]])
    assert [(d, s, i.tolist()) for d, s, i in reader.documents()] == [(d, int(s), i.tolist()) for (d, i), s in zip(docs, starts)]
    edges = [k * block + x for k in range(9) for x in (-1, 0, 1)]
    for a, b in [(x, y) for x in edges for y in edges if 0 <= x <= y <= len(every)] + [(0, len(every))]:
        assert (reader.ids(a, b) == every[a:b]).all() and len(reader.ids(a, b)) == b - a


def check_packing(got, capacity):
    where = {}
    for r in got:
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in where.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(where)


def test_packing(spark, tokenizer):
    got = packing.pack_documents(spark.createDataFrame(rows(), SCHEMA)).collect()
    want = []
    for doc_id, text, *_ in rows():
        ids = brute(tokenizer, text)
        want += [(doc_id, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    n = check_packing(got, 4096)
    assert n <= -(-sum(w[3] for w in want) // 4096) + 1


def test_plan_is_best_fit():
    rng = random.Random(5)
    for capacity in (7, 50, 100):
        lengths = [rng.randint(1, capacity) for _ in range(700)]
        room = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= x]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - x)
            else:
                room.append(capacity - x)
        histogram = {x: lengths.count(x) for x in set(lengths)}
        slots = packing.plan(histogram, capacity)
        assert slots["sequences"][0] == len(room)
        assert sum(slots["last"] - slots["first"]) == 700


def test_packing_of_lengths(spark):
    pieces = spark.createDataFrame([(i % 40, i) for i in range(2000)] + [(None, 1), (3, None)], "length long, name long")
    got = packing.pack(pieces, 64).collect()
    assert len(got) == 2002
    assert all((r["sequence_id"] is None) == (not r["length"]) for r in got)
    check_packing([r for r in got if r["length"]], 64)
    assert packing.pack(pieces.limit(0), 64).count() == 0
    with pytest.raises(ValueError):
        packing.pack(pieces, 30)
