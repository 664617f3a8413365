"""Windows of bytes and their minimisers: how equal 50-byte strings of different documents come to meet in one place.

Every window of `width` bytes has as its minimiser the least hash of its GRAM-byte strings, at the leftmost place that has
it. Equal windows have equal minimisers at equal places, so a minimiser that one document alone has can't belong to a
shared window. Consecutive windows of one minimiser at one place make a segment, the unit that is compared: all its
windows hold the same GRAM bytes, which stand for one symbol there.
"""

from __future__ import annotations

import numpy as np

#: A multiple of 8.
GRAM = 24
#: Minimisers are kept to 48 bits; two that are equal by chance cost a comparison and change no result.
MINIMISER_BITS = np.uint64(16)


#: Positions that are worked on at once: what a processor core's cache holds.
BLOCK = 1 << 14


def _eight_bytes(data: np.ndarray) -> np.ndarray:
    """The little-endian number in the eight bytes at each position: twice as many bytes with each step."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position, to 48 bits."""
    n = max(len(data) - GRAM + 1, 0)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, BLOCK):
            m = min(BLOCK, n - a)
            eight = _eight_bytes(data[a : a + m + GRAM - 1])
            h = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
            for k in range(0, GRAM, 8):
                h ^= eight[k : k + m]
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            np.right_shift(h, MINIMISER_BITS, out=out[a : a + m])
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    n = max(len(h) - width + 1, 0)
    out = np.empty(n, h.dtype)
    for a in range(0, n, BLOCK):
        x, done = h[a : min(a + BLOCK, n) + width - 1], 1
        while done * 2 <= width:
            x = np.minimum(x[:-done], x[done:])
            done *= 2
        more = width - done
        out[a : a + BLOCK] = np.minimum(x[: len(x) - more], x[more:]) if more else x
    return out


def segments(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, windows, minimiser) of every segment, the byte where its first window starts and how many windows it has; and the gram_hashes, for minimiser_places."""
    if len(data) < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    gram = gram_hashes(data)
    value = sliding_min(gram, width - GRAM + 1)
    # The next window has another minimiser, or the same hash at a later place.
    new = np.ones(len(value), bool)
    for a in range(0, len(value) - 1, BLOCK):
        here, there = value[a : a + BLOCK][: len(value) - 1 - a], value[a + 1 : a + 1 + BLOCK]
        np.logical_or(here != there, gram[a : a + len(here)] == here, out=new[a + 1 : a + 1 + len(here)])
    new[at[:-1][at[:-1] < len(value)]] = True
    past = np.maximum(at[1:] - width + 1, at[:-1])  # from here on, windows would reach beyond their text
    size = at[1:] - past
    past = np.repeat(past - (np.cumsum(size) - size), size) + np.arange(size.sum())
    new[past[past < len(value)]] = False
    start = np.flatnonzero(new)
    of = np.searchsorted(at, start, side="right") - 1
    count = np.minimum(np.append(start[1:], len(value)), at[of + 1] - width + 1) - start
    return of, start, count, value[start], gram


def minimiser_places(gram: np.ndarray, start: np.ndarray, windows: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The byte where the minimiser's GRAM bytes start, of each segment."""
    place = start + windows - 1  # every window holds the last one's first gram; the minimiser starts there or later
    todo = np.flatnonzero(gram[place] != value)
    while len(todo):
        place[todo] += 1
        todo = todo[gram[place[todo]] != value[todo]]
    return place
