"""Hashes of the words of texts, computed in numpy for a whole Arrow array at a time.

A word's hash is a polynomial of its bytes over 64-bit integers, read as a difference of prefix sums and then mixed. The
base is odd, so its inverse powers exist and a word hashes alike wherever it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)])
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            _powers[name] = have = np.cumprod(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the place of its first word (and at last the number of words).

    Words are bounded by ASCII white space, or with ``letters`` by any ASCII character but a small letter. Null: no words.
    """
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data] if letters else ~_SPACE[data]
    begins = np.flatnonzero(inside[1:] & ~inside[:-1])
    # A text that begins amid a run of word bytes starts a word, and ends the one before.
    joint = offsets[1:-1]
    joint = joint[(joint > 0) & (joint < len(data))] if len(data) else joint[:0]
    joint = np.unique(joint[inside[joint] & inside[joint + 1]])
    ends = np.sort(np.concatenate([np.flatnonzero(~inside[1:] & inside[:-1]), joint]))
    begins = np.sort(np.concatenate([begins, joint]))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * _grown("up", _BASE, len(data)), out=sums[1:])
        found = mix((sums[ends] - sums[begins]) * _grown("down", _INVERSE, len(data) + 1)[begins])
    return found, np.searchsorted(begins, offsets)


def runs(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Consecutive rows whose texts have at most ``most`` bytes in all; a longer text stands alone."""
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    out, start = [], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        out.append((start, min(end, len(texts))))
        start = out[-1][1]
    return out
