"""Numpy kernels over the bytes of a whole Arrow batch of texts: no Python loop over words or characters."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Spans of more bytes than this are hashed one by one; shorter ones in rounds of eight bytes, all at once.
LONG = 256
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: Bytes of lower-cased words: digits, a to z and all bytes of non-ASCII characters.
WORDISH = np.array([b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" for b in range(256)])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as rows; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))


def _word(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each position the next eight bytes as a number, `left` of them at most."""
    return np.ascontiguousarray(eights[at]).view("<u8").ravel() & _FIRST[np.minimum(left, 8)]


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    return _word(_eights(data), at, np.full(len(at), 8))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]: a chain of mixed words, so that no pattern in the bytes cancels out.

    Where a result is exact, equal hashes are not taken for equal bytes: see exact_ids.
    """
    start, length = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    with np.errstate(over="ignore"):
        h = length.astype(np.uint64) * _STEP + _SEED
        eights = _eights(data)
        todo = np.flatnonzero((length > 0) & (length <= LONG))
        done = 0
        while len(todo):
            whole = len(todo) == len(h)
            word = _word(eights, (start if whole else start[todo]) + done, (length if whole else length[todo]) - done)
            new = mix((h if whole else h[todo]) * _STEP ^ word)
            if whole:
                h = new
            else:
                h[todo] = new
            done += 8
            todo = todo[length[todo] > done]
        for i in np.flatnonzero(length > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + length[i]], digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Is data[a : a + length] equal, byte for byte, to other[b : b + length]?"""
    mine = _eights(data)
    theirs = mine if other is data else _eights(other)
    same = np.ones(len(a), bool)
    todo = np.flatnonzero((length > 0) & (length <= LONG))
    done = 0
    while len(todo):
        left = length[todo] - done
        ok = _word(mine, a[todo] + done, left) == _word(theirs, b[todo] + done, left)
        same[todo[~ok]] = False
        done += 8
        todo = todo[ok & (left > 8)]
    for i in np.flatnonzero(length > LONG).tolist():
        n = int(length[i])
        same[i] = np.array_equal(data[a[i] : a[i] + n], other[b[i] : b[i] + n])
    return same


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): spans have equal ids if and only if their bytes are equal, and `first` is one span of each id, the earliest.

    key: their span_hash, if known. It brings equal spans together; then neighbours are compared byte for byte, and
    spans that differ under one hash are told apart. Ids are in the order of the hashes.
    """
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = span_hash(data, start, end) if key is None else key
    length = end - start
    order = np.argsort(key, kind="stable")
    alike = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    one, two = order[alike], order[alike + 1]
    equal = length[one] == length[two]
    equal[equal] = same_spans(data, start[one[equal]], data, start[two[equal]], length[one[equal]])
    new = np.ones(n, bool)
    new[alike + 1] = False
    if not equal.all():
        kind = np.zeros(n, np.int64)  # within one hash
        for k in np.unique(key[one[~equal]]):
            seen: dict[bytes, int] = {}
            for i in order[np.searchsorted(key[order], k) : np.searchsorted(key[order], k, side="right")].tolist():
                kind[i] = seen.setdefault(data[start[i] : end[i]].tobytes(), len(seen))
        order = np.lexsort((kind, key))
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (kind[order[1:]] != kind[order[:-1]])
    ids = np.empty(n, np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, order[new]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross an offset."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(mask))]
    cut = cut[mask[cut] & mask[cut - 1]]
    first[cut], last[cut - 1] = True, True
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of True within each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def doc_of(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The index of the text that holds each byte position."""
    return np.searchsorted(offsets, at, side="right") - 1


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, and the starts and ends of words of WORDISH bytes."""
    low = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    start, end = runs(WORDISH[low], offsets)
    return low, start, end


def chars(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80
