"""Token ids of whole texts, with a bounded memo of words."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Words a worker remembers, twice over; beyond it the older half goes, so memory stays bounded on any corpus.
MEMO_WORDS = 250_000
#: Texts of these characters alone are split here; others, and those that may name a special token, go to the library whole.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
#: The vocabulary's own word pattern (fixed), for the characters above in lower case.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: What a vocabulary's file says when its texts can be split as above (fixed values); texts of others go to the library whole.
_LETTER_WORDS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_SPLIT = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": _LETTER_WORDS, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: Byte-level vocabularies write bytes that are no visible Latin-1 character as U+0100 and on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTES = {b: chr(256 + n) for n, b in enumerate(_HIDDEN)}


class WordEncoder:
    """Encodes as the tokenizers library does.

    With byte-level vocabularies that mark the ends of words and drop white space, the ids of a text are those of its
    words, one after the other, so each different word goes to the library once while the memo lasts.
    """

    def __init__(self, path: str = VOCABULARY, memo: int = MEMO_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = memo
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        told = json.loads(self.tokenizer.to_str())
        self.by_words = (told["normalizer"], told["pre_tokenizer"]) == _SPLIT and all(t["content"].startswith("<|") for t in told["added_tokens"])
        self.vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: Iterable[str]) -> None:
        split = self.tokenizer.model.tokenize
        for word in words:
            if (known := self.older.get(word)) is None:
                known = array("I", [token.id for token in split(word.encode().decode("latin-1").translate(_BYTES))]).tobytes()
            self.memo[word] = known

    def encode(self, text: str, end: int | None = END_ID) -> np.ndarray:
        """The ids of text, then the end id, as little-endian unsigned 32-bit integers."""
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        if not self.by_words or _OTHER.search(text):
            return np.frombuffer(self._ids(text).tobytes() + tail, "<u4")
        words = _WORD.findall(text.lower())
        try:
            return np.frombuffer(b"".join(map(self.memo.__getitem__, words)) + tail, "<u4")
        except KeyError:
            pass
        if len(self.memo) > self.size:
            self.memo, self.older = {}, self.memo
        self._learn(set(words).difference(self.memo))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)) + tail, "<u4")


@lru_cache(1)
def encoder(path: str = VOCABULARY) -> WordEncoder:
    """The worker's own; it outlives tasks."""
    return WordEncoder(path)
