"""Word n-gram sets of whole texts as sorted 64-bit numbers, vectorised."""

from __future__ import annotations

import numpy as np

from .tasks import mix

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int):
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _UNDO)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raws: list[bytes]):
    """(hash of each word, number of its text) over all texts, in order. A word is a
    run of bytes other than ASCII white space, with A-Z in lower case."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    starts = np.zeros(len(raws), np.int64)
    starts[1:] = np.cumsum([len(r) + 1 for r in raws[:-1]])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[::2], edge[1::2]
    up, down = _power(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=run[1:])
    words = mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return words, np.searchsorted(starts, begin, "right") - 1


def shingle_sets(raws: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer
    words that of the whole sequence; without words none."""
    words, owner = word_hashes(raws)
    many = max(0, len(words) - k + 1)
    joined = np.zeros(many, np.uint64)
    for j in range(k):
        joined += words[j : j + many] * _STEP[j]
    whole = owner[:many] == owner[k - 1 :] if many else np.zeros(0, bool)
    joined, of = mix(joined[whole]), owner[:many][whole]
    bounds = np.searchsorted(of, np.arange(len(raws) + 1))
    words_at = np.searchsorted(owner, np.arange(len(raws) + 1))
    out = []
    for i in range(len(raws)):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            out.append(np.unique(joined[a:b]))
            continue
        own = words[words_at[i] : words_at[i + 1]]
        if len(own):
            own = mix(np.array([np.sum(own * _STEP[: len(own)], dtype=np.uint64) + np.uint64(len(own))], np.uint64))
        out.append(own)
    return out
