import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isopanel.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def stands(kind, s):
        n = sum(c in "0123456789" for c in s)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 14 <= n <= 19 and pii.luhn("".join(c for c in s if c.isdigit())), "phone": 10 <= n <= 15}[kind]

    return sorted((m.start(), list(PATTERNS).index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if stands(k, m[0]))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+0159 ()%_é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [(s.start, s.end, s.kind) for s in pii.find(text) if s.kind in pii.BASE] == [(a, b, k) for a, _, b, k in brute(text)]


def test_known():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    text = "card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; ssn 078-05-1120, not 078-05-1121 of parts nobody would name here; token = \"" + "0a" * 20 + '"'
    kinds = [s.kind for s in pii.find(text)]
    assert kinds.count("iban") == 1 and kinds.count("secret") == 1 and "card" in kinds
    assert "national_id" in kinds and pii.find("x " * 30 + "078-05-1121") == []
    assert "4111" not in pii.mask(text) and "0a0a" not in pii.mask(text)
    assert pii.mask("a b") == "a b"


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@a" * 100_000, "+1" + "(" * 200_000, "AA00 " + "A " * 100_000, "a" * 300_000, "0" * 200_000 + ".1.2.3"])
def test_long_texts_take_linear_time(text):
    pii.find(text)


def test_leading_zeros_of_any_number():
    assert [(s.start, s.end, s.kind) for s in pii.find("0" * 5000 + "1.2.3.4")] == [(0, 5007, "ip")]
    assert [(s.start, s.end) for s in pii.find("000.0000.0.0")] == [(0, 12)] and pii.find("0256.1.1.1") == []


def test_queries(spark):
    rng = random.Random(1)
    parts = ["a.b@c.de", "1.2.3.4", "300.1.1.1", "+1 (555) 010-2030", "4111111111111111", "word", "é", "@", "@x.y"]
    data = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "n") for i in range(80)] + [(None, "a@b.cd", None), (3, None, "x"), (4, "", ""), (5, "a@b.cd", "x"), (5, "a@b.cd", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans string")
    got = sorted((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digest(docs).collect())
    want = []
    for d, t, _ in data:
        b = brute(t or "")
        want.append((d or -1, *(sum(x[3] == k for x in b) for k in pii.BASE), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in b).encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.find_spans(docs).count() >= sum(sum(w[1:5]) for w in want)
    kept = pii.redact(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert not any(pii.find(r["text"] or "") for r in kept.collect())
    assert pii.digest(docs.limit(0)).count() == 0
