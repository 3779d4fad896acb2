"""Words of whole texts as 64-bit hashes, from the UTF-8 bytes of an Arrow batch with a few array operations.

A word is a run of ASCII letters, digits, underscores and bytes of non-ASCII characters; ASCII letters are
folded to lower case, as are the accented letters of Latin-1. Each ideograph or kana (lead bytes E3 to E9) begins a word of its own.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 22
_MULT = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c == 95 or _c >= 128:
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_CJK = np.zeros(256, bool)
_CJK[0xE3:0xEA] = True
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on the input."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _MULT, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _words_of(raw: np.ndarray, forced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = _FOLD[raw]
    capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    c[1:] += capital.view(np.uint8) << 5
    w = c != 0
    starts = w.copy()
    starts[1:] &= ~w[:-1]
    starts |= w & _CJK[raw]
    forced = forced[forced < len(raw)]
    starts[forced] |= w[forced]
    at = np.flatnonzero(starts)
    if not len(at):
        return at, np.zeros(0, np.uint64), at
    held = c[w]
    first = np.cumsum(w, dtype=np.int64)[at] - 1
    lens = np.diff(np.append(first, len(held)))
    place = np.arange(len(held)) - np.repeat(first, lens)
    value = held.astype(np.uint64) * _power_table(int(lens.max()))[place]
    return at, mix(np.add.reduceat(value, first) + lens.astype(np.uint64)), lens


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and byte lengths of all words, and n + 1 offsets into them for n texts that lie
    one after another in `raw`. Long inputs are cut at bytes outside words, so scratch memory is bounded."""
    base, end = int(offsets[0]), int(offsets[-1])
    parts, a = [], base
    while a < end:
        b = min(a + PIECE, end)
        while b < end and _FOLD[raw[b]] != 0 and _FOLD[raw[b - 1]] != 0:
            rest = np.flatnonzero(_FOLD[raw[b : b + PIECE]] == 0)
            b = b + int(rest[0]) if len(rest) else min(b + PIECE, end)
        inside = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        at, h, lens = _words_of(raw[a:b], inside)
        parts.append((at + a, h, lens))
        a = b
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at, h, lens = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, at, lens, np.searchsorted(at, offsets)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; a shorter text that has words is one shingle."""
    if len(words) == 0:
        return words
    if len(words) < k:
        x = np.uint64(len(words))
        for w in words:
            x = mix(np.array([x], np.uint64) * _MULT + w)[0]
        return np.array([x], np.uint64)
    x = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        x = x * _MULT + words[j : j + len(x)]
    return mix(x)


def labelled(values: np.ndarray) -> np.ndarray:
    """Each value with the number of its earlier occurrences mixed in, so that all become distinct."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return mix(values)
    runs = np.flatnonzero(fresh)
    nth = np.arange(len(values)) - np.repeat(runs, np.diff(np.append(runs, len(values))))
    out = np.empty(len(values), np.uint64)
    out[order] = mix(ranked + nth.astype(np.uint64) * _MULT)
    return out
