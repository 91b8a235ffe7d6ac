"""Vectorised words, word hashes and shingle hashes over UTF-8 bytes.

A word's hash is a polynomial over random 64-bit byte codes, finished by a mixer; the
chance that two given words share it is about 2**-58.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX, _STEP = np.uint64(0x9E3779B97F4A7C15 | 3), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, 1 << 21)
        for name, b in (("p", _BASE), ("i", inverse)):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["p"][:n], _powers["i"]


#: Bytes of words that are hashed at a time.
PIECE = 1 << 20


def word_edges(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes of the joined texts, starts and ends of the words, offsets): text i has the words offsets[i] to offsets[i + 1]."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(is_word[buf], prepend=False))  # starts and ends in turn; the last byte is a separator
    ends_at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return buf, edge[::2], edge[1::2], np.concatenate([[0], np.searchsorted(edge[::2], ends_at)])


def word_hashes(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets): text i has the words offsets[i] to offsets[i + 1]. A-Z count as a-z."""
    buf, starts, ends, offsets = word_edges(texts, is_word)
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(starts, low + PIECE)))
        high = ends[stop - 1] + 1  # with the separator
        power, inverse = _power_tables(high - low)
        edge = np.stack([starts[at:stop], ends[at:stop]], 1).ravel() - low
        sums = np.add.reduceat(_CODE[buf[low:high]] * power, edge)[::2]
        out[at:stop] = mix(sums * inverse[starts[at:stop] - low])
        at = stop
    return out, offsets


def prefix_hashes(texts: list[bytes], is_word: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: (index of the word, hash of its first bytes), of the words that are longer."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(is_word[buf], prepend=False))
    starts, ends = edge[::2], edge[1::2]
    out = []
    for n in lengths:
        longer = np.flatnonzero(ends - starts > n)
        h = np.full(len(longer), n, np.uint64)
        for j in range(n):
            h = h * _STEP + _CODE[buf[starts[longer] + j]]
        out.append((longer, mix(h)))
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; of the whole sequence where it has fewer."""
    k = min(k, len(words))
    if not k:
        return words
    h = words[: len(words) - k + 1] + np.uint64(k * int(_STEP) % (1 << 64))
    for j in range(1, k):
        h = mix(h * _STEP) + words[j : len(words) - k + 1 + j]
    return mix(h)


def shingle_sets(texts: list[bytes], k: int, is_word: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (empty without words)."""
    words, offsets = word_hashes(texts, is_word)
    if len(words) >= k:
        rolled = shingle_hashes(words, k)
    sets = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        sets.append(np.unique(rolled[a : b - k + 1] if b - a >= k else shingle_hashes(words[a:b], k)))
    return sets
