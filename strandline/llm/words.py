"""Vectorised words, word hashes and shingle hashes over blocks of UTF-8 text."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def byte_table(inside) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes of words that white space separates: all but space and TAB to CR.
NOT_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of digits, lower-case letters and whatever isn't ASCII.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def runs(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``inside``; runs end with their text."""
    mask = inside[raw]
    before = np.empty_like(mask)
    before[:1], before[1:] = False, mask[:-1]
    cuts = offs[(offs > 0) & (offs < len(raw))]
    before[cuts] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1:], after[:-1] = False, mask[1:]
    after[cuts - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have, dtype=U)
    return have[:n]


def forget_powers() -> None:
    """Drop the tables of powers, which grow with the longest block and are soon made again."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings raw[start:end]: a polynomial in an odd base, read off prefix sums, then mixed."""
    if not len(starts):
        return np.zeros(0, U)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * _power("up", _BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _BASE_INV, len(raw))[starts])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive words; the i-th begins at word i, and there are len(words)-width+1."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, factor = np.zeros(n, U), U(1)
    with np.errstate(over="ignore"):
        for j in range(width):
            factor = U((int(factor) * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D | 1) & 0xFFFFFFFFFFFFFFFF)
            out += words[j : j + n] * factor
    return mix(out ^ U(width))


def doc_word_offsets(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text, the number of the first word at or after its begin (one more than texts)."""
    return np.searchsorted(starts, offs, side="left")


def whole(width: int, words: np.ndarray) -> np.uint64:
    """The hash of one sequence of fewer than ``width`` words, as a shingle of its own length."""
    return shingle_hashes(words, len(words))[0]
