"""Content-defined cuts by a gear rolling hash, vectorised over many texts."""

from __future__ import annotations

import numpy as np

WINDOW = 16
_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hashes(raws: list[bytes]) -> list[np.ndarray]:
    """For each byte of each text the 16-bit gear hash of the 16 bytes up to it:
    the hash shifted left by one, plus the byte's number, at each step. What stood
    further back has left it, so equal surroundings give equal hashes anywhere."""
    gap = bytes(WINDOW)
    joined = np.frombuffer(gap + gap.join(raws), np.uint8)
    number = _GEAR[joined]
    at, starts = WINDOW, []
    for r in raws:
        number[at - WINDOW : at] = 0
        starts.append(at)
        at += len(r) + WINDOW
    total = number.copy()
    for k in range(1, WINDOW):
        total[k:] += number[:-k] << np.uint16(k)
    return [total[a : a + len(r)] for a, r in zip(starts, raws)]


def chunk_ends(raws: list[bytes], average: int, most: int = 0) -> list[np.ndarray]:
    """The ends of the chunks of each text: a cut follows a byte whose hash is below
    65536 / average; with ``most`` also each ``most`` bytes without a cut."""
    below = max(1, 65536 // average)
    out = []
    for raw, h in zip(raws, gear_hashes(raws)):
        ends = np.flatnonzero(h < below) + 1
        if not len(ends) or ends[-1] != len(raw):
            ends = np.append(ends, len(raw))
        if most and len(raw):
            starts = np.concatenate([[0], ends[:-1]])
            if (ends - starts).max() > most:
                ends = np.concatenate([np.append(np.arange(a + most, b, most), b) for a, b in zip(starts, ends)])
        out.append(ends if len(raw) else np.zeros(0, np.int64))
    return out
