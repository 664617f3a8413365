"""Burrows-Wheeler transform and longest common prefixes of a collection, built column by column.

Round t inserts one symbol of every sequence that still has one: the suffix one longer than the last. The transform and
the common prefixes of what is inserted so far lie in two files, which each round reads from front to back and writes
anew. Sequences end with a symbol of their own that sorts first, by the sequence's place in the collection.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class CollectionBWT:
    """codes: the sequences' symbols end to end, 1 to 255; offsets: n + 1 of them. Sequences are not empty and at most 255 long."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, folder: str | None = None):
        self.codes, self.offsets = codes, offsets
        self.n = len(offsets) - 1
        self.length = np.diff(offsets)
        self.folder = tempfile.TemporaryDirectory(dir=folder)
        self.files = {name: [open(os.path.join(self.folder.name, f"{name}{k}"), "w+b", buffering=0) for k in (0, 1)] for name in ("bwt", "lcp")}  # noqa: SIM115  held until close()
        self.size = 0
        try:
            self._build()
        except BaseException:
            self.close()
            raise

    def close(self) -> None:
        for both in self.files.values():
            for f in both:
                f.close()
        self.folder.cleanup()

    def read(self, name: str) -> np.ndarray:
        """One of the two finished files, front to back."""
        f = self.files[name][self.now]
        f.seek(0)
        return np.fromfile(f, np.uint8, self.size)

    def _write(self, name: str, which: int, values: np.ndarray) -> None:
        """Front to back over what the file held: it is never cut, so its pages stay."""
        f, data, at = self.files[name][which], memoryview(values), 0
        f.seek(0)
        while at < len(data):
            at += f.write(data[at : at + (1 << 24)])

    def _build(self) -> None:
        """Besides the two files, memory holds `order`: the transform's positions by (symbol, position), which a round maps on and merges into instead of sorting anew."""
        n = self.n
        self.now = 0
        symbol = self.codes[self.offsets[1:] - 1]
        self._write("bwt", 0, np.ascontiguousarray(symbol))
        self._write("lcp", 0, np.zeros(n, np.uint8))
        self.size = n
        order = np.argsort(symbol, kind="stable")
        every = np.arange(len(self.codes) + n)
        count = np.bincount(symbol, minlength=256)  # of each symbol in the transform
        slot, who = np.arange(n), order  # places of the newest suffixes in order, and whose they are
        done = 1
        while len(slot):
            bwt, lcp = self.read("bwt"), self.read("lcp")
            size, ended = len(bwt), int(count[0])
            place = n + slot - ended  # by (symbol, position): the order of the new suffixes

            # A new suffix shares one symbol more with a neighbour of its symbol than the suffixes behind them share.
            touched = np.empty(2 * len(slot), np.int64)
            touched[0::2], touched[1::2] = slot, slot + 1
            fresh = np.ones(len(touched), bool)
            fresh[2::2] = touched[2::2] != touched[1:-1:2]
            fresh[-1] = touched[-1] < size
            touched = touched[fresh]
            here, before = order[touched], order[touched - 1]
            same = bwt[here] == bwt[before]
            same[touched == 0] = False
            shared = np.zeros(len(touched), np.uint8)
            pairs = np.flatnonzero(same)
            if len(pairs):
                pairs = pairs[np.argsort(here[pairs])[::-1]]  # descending, so that reduceat skips what lies between
                cuts = np.empty(2 * len(pairs), np.int64)
                cuts[0::2], cuts[1::2] = before[pairs] + 1, here[pairs] + 1
                shared[pairs] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), cuts)[0::2] + 1

            done += 1
            left = self.length[who] >= done
            nxt = np.zeros(len(who), np.uint8)
            nxt[left] = self.codes[self.offsets[who[left] + 1] - done]
            old = np.ones(size + len(place), bool)
            old[place] = False
            grown = np.empty(size + len(place), np.uint8)
            grown[old], grown[place] = bwt, nxt
            self._write("bwt", 1 - self.now, grown)
            grown[old] = lcp
            grown[n + touched - ended] = shared
            self._write("lcp", 1 - self.now, grown)
            self.now, self.size = 1 - self.now, len(grown)

            moved = np.take(every[: len(old)][old], order, mode="clip")  # where the old symbols stand now, still by (symbol, position)
            by_symbol = np.argsort(nxt, kind="stable")
            new_at, new_symbol = place[by_symbol], nxt[by_symbol]
            new_slot = np.arange(len(new_at))
            start = np.cumsum(count) - count
            cut = np.searchsorted(new_symbol, np.arange(257))
            for c in np.flatnonzero(np.diff(cut)):
                mine = slice(cut[c], cut[c + 1])
                new_slot[mine] += start[c] + np.searchsorted(moved[start[c] : start[c] + count[c]], new_at[mine])
            stay = np.ones(len(moved) + len(new_at), bool)
            stay[new_slot] = False
            order = np.empty(len(stay), np.int64)
            order[stay], order[new_slot] = moved, new_at
            count = count + np.diff(cut)
            on = new_symbol > 0
            slot, who = new_slot[on], who[by_symbol][on]
        self._order = order

    def places(self, longest: int):
        """Yield (length, who, position): where the suffix of each length up to `longest` of each sequence stands in the sorted order."""
        step = np.empty(len(self._order), np.int32)
        step[self._order] = np.arange(len(step), dtype=np.int32)  # all n sequences have ended: the symbols that end them come first, as their suffixes do
        at, who = np.arange(self.n), np.arange(self.n)
        for length in range(1, longest + 1):
            keep = self.length[who] >= length
            at, who = step[at[keep]], who[keep]
            if not len(who):
                return
            yield length, who, at
