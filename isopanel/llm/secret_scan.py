"""Secrets in texts: fixed patterns, and strings that a vocabulary of public text finds hard to write.

Base kinds are assign, access and hex: leftmost matches without overlap in each kind, dropped where they are too short.
The further kind, random, is the token-efficiency test. A run of token characters is cut at underscores and equal
signs, and each piece of LEAST characters or more that mixes digits with letters, or letters of both cases, goes through a
byte-pair vocabulary: words and names take few tokens, random strings nearly one for every other character, so a piece
of fewer than MOST_EFFICIENT characters a token is a span. Left out before the test are known digests and
identifiers: whole runs that are hex digits (of a digest's length or any other), digests in an `sha256-` or `md5:`
notation, UUIDs, times and dates, versions and numbers.

Runs are found in bytes at once for all texts of a batch, so only pieces of runs reach the vocabulary; long pieces are
written in parts of PART characters, so that the test is linear in the text.

Defined cases: a null or empty text has no spans; positions are code points, ends exclusive; a null doc_id stays null;
repeated rows are each reported; kinds may overlap one another (a random span is left out where a base span holds it);
further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import map_batches, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Lengths of matches (fixed by the contract).
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Characters of a piece, and characters a token below which it is random; what is written at once.
LEAST, MOST_EFFICIENT, PART = 20, 2.0, 256
#: Bytes whose classes are looked up together.
STEP = 1 << 20

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Pieces end at underscores and equal signs.
_PIECE = re.compile(r"[A-Za-z0-9+]+(?:[/-][A-Za-z0-9+]+)*")
_KNOWN = re.compile(
    r"""(?ax) (?: [0-9a-f]+ | [0-9A-F]+  # hex digits of one case
    | (?i: [0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12} )  # UUID
    | (?i: (?:sha1|sha256|sha384|sha512|md5) ) [-:=/] .*  # digest with its name
    | v?[0-9]+(?:[./+:T-][0-9]+)*Z? )"""  # numbers, versions, times
)
_HEX, _RUN = (np.array([chr(b) in alphabet for b in range(256)]) for alphabet in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    #: Characters a token, of random spans.
    efficiency: float | None = None


@lru_cache(1)
def vocabulary(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The worker's own; it outlives tasks."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def efficiency(piece: str, path: str = VOCABULARY) -> float:
    """Characters a token."""
    encode = vocabulary(path).encode_ordinary
    return len(piece) / max(1, sum(len(encode(piece[i : i + PART])) for i in range(0, len(piece), PART)))


def is_mixed(piece: str) -> bool:
    """Digits and letters, or letters of both cases beyond a capital at the start."""
    digit, lower, upper = (any(map(test, piece)) for test in (str.isdigit, str.islower, str.isupper))
    return digit and (lower or upper) or lower and any(map(str.isupper, piece[1:]))


def runs(data: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the longest runs of at least `least` bytes inside, in order."""
    found, opened = [], -1
    for low in range(0, len(data), STEP):
        held = inside[data[low : low + STEP]]
        edges = np.flatnonzero(np.diff(held, prepend=opened >= 0, append=held[-1])) + low
        if opened >= 0:
            edges = np.append(opened, edges)
        opened = int(edges[-1]) if len(edges) % 2 else -1
        pairs = edges[: len(edges) // 2 * 2].reshape(-1, 2)
        found.append(pairs[pairs[:, 1] - pairs[:, 0] >= least])
    if opened >= 0 and len(data) - opened >= least:
        found.append(np.array([[opened, len(data)]]))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _random(run: str) -> Iterator[tuple[int, int, float]]:
    """Pieces of a run that are random."""
    if _KNOWN.fullmatch(run):
        return
    for m in _PIECE.finditer(run):
        piece = m[0]
        if len(piece) >= LEAST and is_mixed(piece) and not _KNOWN.fullmatch(piece):
            parts = piece.split("-") if "-" in piece else [piece]
            # words joined by hyphens are a name, whatever the whole costs
            if max(map(len, parts)) * 2 >= LEAST and (found := efficiency(piece)) < MOST_EFFICIENT:
                yield *m.span(), found


def find_all(texts: list[bytes]) -> list[list[Span]]:
    """The spans of each UTF-8 text, by start, then kind."""
    found: list[list[Span]] = [[] for _ in texts]
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    for inside, least in ((_HEX, LEAST_HEX), (_RUN, LEAST)):
        spans = runs(data, inside, least)
        owners, firsts = np.unique(np.searchsorted(starts, spans[:, 0], "right") - 1, return_index=True)
        for owner, held in zip(owners.tolist(), np.split(spans, firsts[1:]), strict=False):
            own = held - starts[owner]
            places = _code_points(texts[owner], own)
            if inside is _HEX:
                found[owner] += [Span(a, b, "hex") for a, b in places.tolist()]
                continue
            for (low, high), at in zip(own.tolist(), places[:, 0].tolist(), strict=True):
                found[owner] += [Span(at + a, at + b, "random", x) for a, b, x in _random(texts[owner][low:high].decode())]
    for text, spans in zip(texts, found, strict=True):
        low = text.lower()
        if any(name in low for name in map(str.encode, _NAMES)):
            spans += [Span(*m.span(), "assign") for m in _ASSIGN.finditer(text.decode()) if len(m[2]) >= LEAST_VALUE]
        if b"AKIA" in text:
            spans += [Span(*m.span(), "access") for m in _ACCESS.finditer(text.decode()) if len(m[0]) >= LEAST_ACCESS]
    return [_in_order(spans) for spans in found]


def _code_points(text: bytes, places: np.ndarray) -> np.ndarray:
    """Byte places as code points: what precedes, less the bytes that only continue a character."""
    if text.isascii():
        return places
    following = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)
    return places - np.searchsorted(following, places)


def _in_order(spans: list[Span]) -> list[Span]:
    """By start, then kind; random spans inside base spans go."""
    kept, reach = [], -1
    for span in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end)):
        if span.kind in BASE:
            reach = max(reach, span.end)
        elif span.end <= reach:
            continue
        kept.append(span)
    return kept


def find(text: str) -> list[Span]:
    return find_all([text.encode()])[0]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], list[list[Span]]]]:
    for whole in batches:
        for batch in slices(whole):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.column("doc_id"), texts, find_all(texts)


def find_spans(docs: DataFrame) -> DataFrame:
    """One row for each span: doc_id, kind, start, end, efficiency (of random ones), text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for ids, texts, found in _batches(batches):
            out = [(d, s.kind, s.start, s.end, s.efficiency, whole[s.start : s.end]) for d, t, spans in zip(ids.to_pylist(), texts, found, strict=True) if spans for whole in [t.decode()] for s in spans]
            if out:
                yield dict(zip(("doc_id", "kind", "start", "end", "efficiency", "text"), zip(*out, strict=True), strict=True))

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id bigint, kind string, start bigint, end bigint, efficiency double, text string")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by kind, a digest of base spans, and all spans."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
    return map_batches(docs.select("doc_id", "text"), _digests, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for ids, _, found in _batches(batches):
        joined = [[",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in kinds) for spans in found] for kinds in (BASE, KINDS)]
        yield {
            "doc_id": ids,
            **{f"n_{k}": [sum(s.kind == k for s in spans) for spans in found] for k in KINDS},
            "base_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in joined[0]],
            "spans": joined[1],
        }
