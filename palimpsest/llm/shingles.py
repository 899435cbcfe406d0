"""Word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_white = np.zeros(256, bool)
_white[[0x20, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, A-Z lower-cased, and the number of words of each text."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    white = _white[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white)).astype(np.int8)))
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    start, stop = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_lower[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    words = mix((total[stop] - total[start]) * down[start])
    ends = np.cumsum([len(c) + 1 for c in coded])
    return words, np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a text of fewer words has its whole sequence as its only one."""
    words, counts = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        grams = mix(grams + words[k : k + len(grams)] * np.uint64(2 * k + 3)) if k < size - 1 else mix(grams + words[k : k + len(grams)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for k in range(n):
                x = mix(x + words[at + k : at + k + 1] * np.uint64(2 * k + 7))
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def in_chunks(texts: list[str | None], most: int = 1 << 18):
    """(first, last) ranges of texts of about ``most`` characters in all; a longer text is a range of its own."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(texts):
        yield first, len(texts)
