"""Words of whole texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np

#: Bytes whose words are hashed together, so that memory is bounded on texts of any length.
STEP = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _numbers(first: int, n: int) -> np.ndarray:
    """n fixed odd numbers without a pattern, from a counter."""
    return mix(mix((np.arange(first, first + n, dtype=np.uint64) + np.uint64(1)) * _P) * _P) | np.uint64(1)


#: A number for each byte; A-Z have those of a-z.
_BYTES = _numbers(0, 256)
_BYTES[65:91] = _BYTES[97:123]
#: Bytes between words: white space (U+0020, U+0009 to U+000D), or all that is no letter, digit or part of a longer character.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
PLAIN = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def word_hashes(texts: list[str | None], between: np.ndarray = WHITE) -> list[np.ndarray]:
    """The hashes of each text's words, A-Z taken as a-z.

    A word's hash is the sum of its bytes' numbers, each times a number for its place in the word, with its bits spread.
    """
    encoded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in encoded])
    inside = ~between[data]
    first = inside & ~np.append(False, inside[:-1])
    starts = np.flatnonzero(first)
    sums = np.zeros(len(starts), np.uint64)
    longest = int(np.diff(np.append(starts, len(data))).max(initial=0))
    places = _numbers(256, min(longest, STEP))
    begun = 0  # words that begin before the part
    for low in range(0, len(data), STEP):
        part, held = data[low : low + STEP], inside[low : low + STEP]
        word = np.cumsum(first[low : low + STEP]) + (begun - 1)
        begun = int(word[-1]) + 1
        at = np.flatnonzero(held)
        if not len(at):
            continue
        word = word[at]
        place = at + low - starts[word]
        # a word of more than STEP bytes goes on with further numbers
        factor = places[place] if longest <= STEP else places[place % STEP] * _numbers(0, 1)[0] ** (place // STEP).astype(np.uint64)
        values = _BYTES[part[at]] * factor
        cuts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sums[word[cuts]] += np.add.reduceat(values, cuts)
    return np.split(mix(sums), np.searchsorted(starts, ends[:-1])) if len(texts) else []


def gram_hashes(words: np.ndarray, offsets: list[int]) -> np.ndarray:
    """A number for each start, of the words at start + offset, in order."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(offsets), np.uint64)
    for o in offsets:
        out = out * _P + words[o : o + n]
    return mix(out)
