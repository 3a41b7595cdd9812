"""Numpy helpers that run inside Arrow functions: words, word hashes, hashes of word runs."""

from __future__ import annotations

import numpy as np

#: ASCII white space 0x20, 0x09-0x0D; odd multipliers of the rolling hashes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 14)
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, with each word's start and end in that."""
    words = text.split()
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return b" ".join(words), end - size, end


def word_hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, without a Python loop over words; in pieces of about 1 MB."""
    out, i, n = [], 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 20))))
        lo, hi = int(start[i]), int(end[j - 1])
        pw, inv = powers(BYTE_BASE, hi - lo + 1)
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((np.frombuffer(text, np.uint8, hi - lo, lo).astype(np.uint64) + np.uint64(1)) * pw[: hi - lo], out=s[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out.append(mix((s[b] - s[a]) * inv[a] + (b - a).astype(np.uint64)))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, from the words' hashes."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    pw, inv = powers(WORD_BASE, n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(h * pw[:n], out=s[1:])
    return mix((s[k:] - s[:-k]) * inv[: n - k + 1])
