"""Hashed word shingles of texts, in numpy."""

from __future__ import annotations

import re

import numpy as np

#: An odd base has an inverse modulo 2^64, which moves a prefix hash to where a word starts.
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text hashed at a time, so that what this process keeps is bounded; cuts are made at white space.
CHUNK = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0D]")

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) > n:
        return _powers
    m, out = 1 << n.bit_length(), []
    for b in (_BASE, _BACK):
        p = np.full(m, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    if m <= 2 * CHUNK:
        _powers[:] = out
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``text``: runs of bytes other than ASCII white space."""
    out, at = [], 0
    while len(text) - at > CHUNK and (m := _GAP.search(text, at + CHUNK // 2)):
        out.append(_hashes(text[at : m.start()]))
        at = m.start()
    return np.concatenate([*out, _hashes(text[at:])])


def _hashes(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, back = _up_to(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    return _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def shingles(text: bytes, k: int) -> np.ndarray:
    """The distinct hashes, ascending, of all runs of ``k`` words; of the whole sequence where it is shorter.

    ``text`` is taken as it is: lower it first where case doesn't count."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    total = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        total = _mix(total + w[i : len(w) - k + 1 + i])
    return np.unique(total)
