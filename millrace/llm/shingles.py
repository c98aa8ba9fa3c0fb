"""Word and shingle hashes of whole texts in numpy, for many texts at once."""

from __future__ import annotations

import numpy as np

#: ASCII letters and digits and all bytes from 0x80 make words; all else parts them.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.full(n, b, np.uint64)) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the lower-cased texts, and the number of words of each text."""
    raw = [t.lower().encode("utf-8", "replace").translate(_FOLD) for t in texts]
    ends_at = np.cumsum([len(b) + 1 for b in raw])
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inside = data != 32
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    counts = np.diff(np.searchsorted(starts, ends_at), prepend=0)
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and their number for each text.

    A text of fewer words, but one at least, has one shingle of all its words.
    """
    firsts = np.cumsum(counts) - counts
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    total = int(n.sum())
    at = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(total)
    left = np.repeat(firsts + counts, n)
    h = np.zeros(total, np.uint64)
    padded = np.append(words, np.zeros(size, np.uint64))
    for j in range(size):
        h += np.where(at + j < left, padded[at + j], np.uint64(0)) * _ODD[j % 5]
        h = h ^ (h >> np.uint64(29))
    return mix(h), n


def bags(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in one array, their weights (how often they occur), and how many a text has."""
    sh, n = shingle_hashes(*word_hashes(texts), size)
    if not len(sh):
        return sh, np.zeros(0, np.int64), n
    of = np.repeat(np.arange(len(n)), n)
    key = mix(sh + mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    weight = np.diff(np.append(first, len(key)))
    sh, of = sh[order][first], of[order][first]
    by_text = np.argsort(of, kind="stable")
    return sh[by_text], weight[by_text], np.bincount(of, minlength=len(n))


def units(sh: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle as often as it weighs, with the copy's number in its hash; and the shingle each unit is of."""
    of = np.repeat(np.arange(len(sh)), weight)
    copy = np.arange(len(of)) - np.repeat(np.cumsum(weight) - weight, weight)
    return mix(sh[of] + copy.astype(np.uint64) * np.uint64(_BASE)), of
