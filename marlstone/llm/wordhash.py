"""64-bit hashes of the words of whole texts, computed in numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(97)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """The first n powers of the base."""
    if len(_powers[0]) < n:
        _powers[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]), dtype=np.uint64)
    return _powers[0]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, in order, and the number of words of each text. Words are runs of bytes other than the six ASCII white
    spaces, A-Z lower-cased; null texts have none."""
    raw = [(t or "").encode().lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    space = _SPACE[data]
    before = np.empty(len(space), bool)
    before[:1] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(space & ~before)
    lengths = np.append(np.diff(starts), len(data) - starts[-1])
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    body = data[starts[0] :]
    table = powers(int((ends - starts).max()) + 1)
    value = _BYTE[body] * table[np.minimum(place, len(table) - 1)]
    value[space[starts[0] :]] = 0
    hashes = mixed(np.add.reduceat(value, starts - starts[0]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    borders = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, np.diff(borders)
