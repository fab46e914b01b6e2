"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

from weftline.llm.cluster import FORGET

#: Letters and digits of ASCII, A-Z lower-cased, and all bytes beyond ASCII make words; all else parts them.
_VALUE = np.zeros(256, np.uint64)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _VALUE[_b] = ord(chr(_b).lower()) + 1 if _b < 128 else _b + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _forget() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


FORGET.append(_forget)


def _upto(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first bytes, ends, bounds): words of all texts in a row; text i has words bounds[i] to bounds[i + 1]."""
    data = np.frombuffer(b"\0".join([b"", *texts, b""]), np.uint8)
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
    value = _VALUE[data]
    word = value > 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _upto(len(data) + 1)
    value *= power[: len(data)]
    total = np.cumsum(value)
    hashes = mixed((total[ends - 1] - total[starts - 1]) * inverse[starts])
    bounds = np.searchsorted(starts, offsets)
    shift = np.repeat(offsets[:-1], np.diff(bounds))
    return hashes, starts - shift, ends - shift, bounds
