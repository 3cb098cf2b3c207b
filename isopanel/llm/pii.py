"""Personal data: patterns propose spans, checksums and ranges confirm them, nearby words adjust their score.

Base kinds are email, ip, card and phone; their proposals are leftmost and without overlap in each kind, a proposal
that its validator turns down is dropped, and those that stand are never dropped for a low score. The further kinds
(iban, national_id, secret) need a score of at least THRESHOLD, which a mod-97 checksum gives alone and a pattern
without a checksum gets only from a context word before it. Every search is linear in the text.

Defined cases: a null or empty text has no spans; positions are code points, ends exclusive; a null doc_id stays null;
repeated rows are each reported; kinds may overlap one another; further columns are kept by redact() and not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, map_batches, slices, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "secret")
THRESHOLD = 0.5
#: Score of a confirmed or proposed span alone, and what a context word within REACH code points before it adds.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.9, 0.1), "national_id": (0.3, 0.5), "secret": (0.3, 0.5)}
REACH = 40
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national_id": "ssn|social security|national id|tax id",
    "secret": "token|secret|key|password|api|auth",
}
_NEAR = {kind: re.compile(rf"\b(?:{words})\b", re.IGNORECASE) for kind, words in CONTEXT.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"\b[0-9a-fA-F]{32,128}+\b")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @; its local part is all that may precede it since the last match."""
    low = 0
    while (at := text.find("@", low)) >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = domain.end() if domain else at + 1
        if domain:
            yield start, low


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest proposal that ends with a word and passes the checksum."""
    for m in _IBAN.finditer(text):
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]
        for end in ends:
            account = text[m.start() : end].replace(" ", "")
            if 15 <= len(account) <= 34 and not text[end : end + 1].isalnum() and mod97(account):
                yield m.start(), end
                break


def find(text: str) -> list[Span]:
    """All spans by start, then kind."""
    found: list[Span] = []

    def add(kind: str, spans: Iterator[tuple[int, int]]) -> None:
        alone, near = SCORES[kind]
        for start, end in spans:
            score = alone + near * bool(_NEAR[kind].search(text, max(0, start - REACH), start))
            if kind in BASE or score >= THRESHOLD:
                found.append(Span(start, end, kind, score))

    if "@" in text:
        add("email", _emails(text))
    if _DIGIT.search(text):
        add("ip", _ips(text))
        add("card", _cards(text))
        if "+" in text:
            add("phone", _phones(text))
        add("iban", _ibans(text))
        add("national_id", (m.span() for m in _NATIONAL.finditer(text)))
        add("secret", (m.span() for m in _SECRET.finditer(text)))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find_spans(docs: DataFrame) -> DataFrame:
    """One row for each span: doc_id, kind, start, end, score, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for whole in batches:
            for batch in slices(whole):
                out = [(d, s.kind, s.start, s.end, s.score, t[s.start : s.end]) for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True) for s in find(t)]
                if out:
                    yield dict(zip(("doc_id", "kind", "start", "end", "score", "text"), zip(*out, strict=True), strict=True))

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id bigint, kind string, start bigint, end bigint, score double, text string")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by base kind, a digest of base spans, all spans and their scores."""
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, score double"
    return map_batches(docs.select("doc_id", "text"), _digests, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for whole in batches:
        for batch in slices(whole):
            found = [find(text) for text in texts_of(batch)]
            joined = [[",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in kinds) for spans in found] for kinds in (BASE, KINDS)]
            yield {
                "doc_id": batch.column("doc_id"),
                **{f"n_{k}": [sum(s.kind == k for s in spans) for spans in found] for k in BASE},
                "base_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in joined[0]],
                "spans": joined[1],
                "score": [max((s.score for s in spans), default=0.0) for spans in found],
            }


def mask(text: str) -> str:
    """text with every span's kind in its place, until none is left: taking one away can complete another.

    Overlapping spans become one, named by the first. Each round takes away digits or an @ that never come back.
    """
    while spans := find(text):
        out, low = [], 0
        for s in spans:
            if s.start >= low:
                out += [text[low : s.start], f"<{s.kind}>"]
            low = max(low, s.end)
        text = "".join([*out, text[low:]])
    return text


def redact(docs: DataFrame) -> DataFrame:
    """docs with spans masked in text; all rows and columns stay, a null text stays null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = pa.array([None if t is None else mask(t) for t in batch.column("text").to_pylist()], pa.string())
                yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    return bounded(docs).mapInArrow(rows, docs.schema)
