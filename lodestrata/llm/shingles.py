"""Hashed word shingles of texts, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Words in a shingle.
WIDTH = 5
#: Bytes hashed at once.
SLICE = 1 << 18
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_GAP = re.compile(b"[ \t-\r]")


#: Rows of a batch that are turned into Python values at once.
STEP = 256


def encoded(column) -> Iterator[list[bytes]]:
    """The texts of an Arrow column as UTF-8, a few rows at a time; a null is empty."""
    import pyarrow as pa

    for at in range(0, len(column), STEP):
        yield [t or b"" for t in column.slice(at, STEP).cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0], m = 1, 1
    while m < n:
        e = min(m, n - m)
        out[m : m + e] = out[:e] * _U(pow(base, m, 1 << 64))
        m += e
    return out


_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if n > 2 * SLICE:  # a word longer than a slice; not kept
        return _powers(base, n)
    if name not in _tables:
        _tables[name] = _powers(base, 2 * SLICE)
    return _tables[name][:n]


def _words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a buffer: differences of prefix sums of a polynomial."""
    b = _LOWER[np.frombuffer(buf, np.uint8)]
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, _U)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((b.astype(_U) + _U(1)) * _table("up", _BASE, len(b)), dtype=_U)))
    return start, mixed((sums[end] - sums[start]) * _table("down", pow(_BASE, -1, 1 << 64), len(b))[start])


def _cuts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about SLICE bytes that end between words."""
    at = 0
    while at < len(text):
        m = _GAP.search(text, min(at + SLICE, len(text)))
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def _set(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n >= WIDTH:
        h = words[: n - WIDTH + 1].copy()
        for k in range(1, WIDTH):
            h = h * _U(_STEP) + words[k : n - WIDTH + 1 + k]
        h = np.sort(mixed(h))
        return h[np.concatenate(([True], h[1:] != h[:-1]))]
    if not n:
        return np.zeros(0, _U)
    s = n  # a text of fewer words is one shingle, which none of another length equals
    for w in words:
        s = (s * _STEP + int(w)) & (1 << 64) - 1
    return mixed(np.array([s], _U))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > SLICE:
            yield _set(np.concatenate([_words(p)[1] for p in _cuts(texts[i])]))
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= SLICE:
            size += len(texts[j]) + 1
            j += 1
        start, h = _words(b"\n".join(texts[i:j]))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[i:j]]))
        at = 0
        for e in ends:
            yield _set(h[at:e])
            at = e
        i = j
