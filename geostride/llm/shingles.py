"""Sets of word shingles as sorted 64-bit hashes, computed over many texts at once in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
#: Lower-cases A-Z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: The separators 0x20 and 0x09-0x0D.
APART = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_ODD = 0x9E3779B97F4A7C15 | 1
_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out[0], out[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words of each text). A word's hash is the value of its bytes as a
    polynomial modulo 2^64, got from running sums over all texts, mixed with its length."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = FOLD[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    inside = np.concatenate([[False], ~APART[flat], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    size = 1 << max(16, int(len(flat)).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)], dtype=np.uint64)])
        value = (sums[end] - sums[start]) * inverse[start]
        value = mix(value ^ (end - start).astype(np.uint64) * np.uint64(_ODD))
    return value, np.diff(np.searchsorted(start, np.concatenate([[0], ends_of])))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted: all runs of `words` words; with fewer words the whole sequence; none
    without words or text."""
    hashes, counts = word_hashes([t or "" for t in texts])
    n = max(0, len(hashes) - words + 1)
    runs = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            runs = mix(runs * np.uint64(_ODD) + hashes[k : n + k])
        out, at = [], 0
        for c in counts.tolist():
            if c >= words:
                s = runs[at : at + c - words + 1].copy()
                s.sort()
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif c:
                h = np.full(1, c, np.uint64)
                for k in range(c):
                    h = mix(h * np.uint64(_ODD) + hashes[at + k])
                out.append(h)
            else:
                out.append(runs[:0])
            at += c
    return out


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        return int(mix(np.atleast_1d(np.add.reduce(mix(s ^ np.uint64(_BASE))) + np.uint64(len(s))))[0].astype(np.int64))
