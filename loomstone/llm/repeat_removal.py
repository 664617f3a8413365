"""Removal of repeated strings, exact to the byte, over a collection Burrows-Wheeler transform with common prefixes.

A transform of whole documents, built column by column, needs as many rounds as the longest document has bytes, and each
round rewrites everything. So windows first meet by minimiser (windows.py): only segments whose minimiser several
documents have are compared. All windows of a segment hold the minimiser's GRAM bytes, so these are one symbol (a few
digits, where there are more of them than symbols); each shard of minimisers builds the transform of its distinct
segments, one symbol of each a round, and runs of common prefixes as long as a window are the repeated windows. Nothing
is sampled: equal windows always meet, and each answer is the least doc_id that has the window. Hashes only bring equal
strings together; whatever is taken for equal is compared byte for byte.

Messages travel as blobs, one a chunk of documents and shard, and each holds an entry at least: a string that a third of
all documents hold is one entry a chunk. A minimiser with more different segments than a shard's fair share of them all
is hot: its segments are cut into single windows, which are dealt by their own bytes, so that the many surroundings of a
frequent string don't meet in one task. There are fewer hot minimisers than shards.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.collection_bwt import CollectionBWT
from loomstone.llm.common import drop, free_names, partitions, ready, staged, table, tidy
from loomstone.llm.textkernel import chars, exact_ids, mix, span_hash, text_bytes, words_at
from loomstone.llm.windows import GRAM, minimiser_places, segments

WIDTH = 50
#: Segments of a chunk: what a task gathers before it sends blobs to the shards.
CHUNK_SEGMENTS = 400_000
#: Shards of a partition: each builds a transform of its own, one after another.
SHARDS_EACH = 8
#: Bytes of the segments of one transform; a shard with more builds several.
TRANSFORM_BYTES = 4 << 20
#: A minimiser with this many segments, or fewer, is never hot.
HOT_SEGMENTS = 100_000

_pack = zstandard.ZstdCompressor(level=1).compress
_unpack = zstandard.ZstdDecompressor().decompress


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob, byte planes apart so that small numbers shrink."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return _pack(head + b"".join(planes))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = _unpack(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    shape = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(count, 2)
    at, out = 8 + 16 * count, []
    for (width, n), kind in zip(shape.tolist(), kinds, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T).view(kind).ravel())
        at += width * n
    return out


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray, block: int = 8192) -> np.ndarray:
    """The bytes data[start:start + length] of all spans end to end; indices are made for one block of spans at a time."""
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    begin = ends - length
    for a in range(0, len(start), block):
        b = min(a + block, len(start))
        lo, hi = int(begin[a]), int(ends[b - 1])
        out[lo:hi] = data[np.repeat(start[a:b] - (begin[a:b] - lo), length[a:b]) + np.arange(hi - lo)]
    return out


def _by_group(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(n + 1))


MANY = np.int64(np.iinfo(np.int64).min)


def _looks(data: np.ndarray, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimisers with 16 bits of their segment's first and last eight bytes and length, which tell most segments apart."""
    with np.errstate(over="ignore"):
        look = mix(words_at(data, start) + mix(words_at(data, end - 8)) + (end - start).astype(np.uint64))
    return value << np.uint64(16) | look >> np.uint64(48)


def _ask(width: int, shards: int):
    """Documents -> (shard, doc_id, blob): questions to the shards, one entry a chunk and minimiser, with the number of its different segments there; and for each document the minimisers known to be shared within the chunk."""

    def flush(value: list, doc: list, looks: list) -> Iterator[tuple]:
        v, d, look = np.concatenate(value), np.concatenate(doc), np.sort(np.concatenate(looks))
        look = look[np.concatenate([[True], look[1:] != look[:-1]])] >> np.uint64(16)
        kinds = np.diff(np.flatnonzero(np.concatenate([[True], look[1:] != look[:-1], [True]])))
        order = np.argsort(v, kind="stable")  # a document's segments stand together, so they do within a minimiser
        v, d = v[order], d[order]
        once = np.ones(len(v), bool)
        once[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        v, d = v[once], d[once]
        first = np.ones(len(v), bool)
        first[1:] = v[1:] != v[:-1]
        group = np.cumsum(first) - 1
        many = np.bincount(group) > 1
        known = many[group]
        order, cut = np.unique(d[known], return_inverse=True)
        kv = v[known][np.argsort(cut, kind="stable")]
        ends = np.cumsum(np.bincount(cut, minlength=len(order)))
        for k, one in enumerate(order):
            a = ends[k - 1] if k else 0
            yield int(one % shards), int(one), kv[a : ends[k]].tobytes()
        v, d = v[first], np.where(many, MANY, d[first])
        order, cut = _by_group((v % np.uint64(shards)).astype(np.int64), shards)
        for s in range(shards):
            mine = order[cut[s] : cut[s + 1]]
            if len(mine):
                yield s, None, pack(v[mine], d[mine], kinds[mine])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, doc, looks, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            rows = list(zip(*flush(value, doc, looks), strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["shard", "doc_id", "blob"])

        for b in batches:
            data, at = text_bytes(b.column(1))
            of, start, windows, v, _ = segments(data, at, width)
            value.append(v)
            doc.append(b.column(0).to_numpy(zero_copy_only=False)[of])
            looks.append(_looks(data, v, start, start + windows + width - 1))
            held += len(v)
            if held > CHUNK_SEGMENTS:
                yield out()
                value, doc, looks, held = [], [], [], 0
        if held:
            yield out()

    return kernel


def _answer(blocks: int, least_hot: int):
    """A shard's blobs -> (block, blob, segments): which minimisers documents share with others, a row for each of the `blocks` of documents.

    Besides, the number of all segments (block -1), and each minimiser of more than `least_hot` segments (block -2).
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, docs, kinds, known_values, known_docs = [], [], [], [], []
        for b in batches:
            for one, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if one is None:
                    v, d, k = unpack(blob.as_buffer(), np.uint64, np.int64, np.int64)
                    values.append(v)
                    docs.append(d)
                    kinds.append(k)
                else:
                    known_values.append(np.frombuffer(blob.as_buffer(), np.uint64).copy())
                    known_docs.append(np.full(len(known_values[-1]), one))
        rows = []
        if values:
            v, d, k = np.concatenate(values), np.concatenate(docs), np.concatenate(kinds)
            order = np.argsort(v, kind="stable")
            v, d, k = v[order], d[order], k[order]
            first = np.ones(len(v), bool)
            first[1:] = v[1:] != v[:-1]
            group = np.cumsum(first) - 1
            shared = ((np.bincount(group) > 1)[group]) & (d != MANY)
            known_values.append(v[shared])
            known_docs.append(d[shared])
            total = np.add.reduceat(k, np.flatnonzero(first))
            rows.append((-1, None, int(total.sum())))
            rows += [(-2, one.tobytes(), int(n)) for one, n in zip(v[first][total > least_hot], total[total > least_hot], strict=True)]
        if known_values:
            v, d = np.concatenate(known_values), np.concatenate(known_docs)
            order, cut = _by_group((mix(d.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64), blocks)
            rows += [(k, pack(d[order[cut[k] : cut[k + 1]]], v[order[cut[k] : cut[k + 1]]]), None) for k in range(blocks) if cut[k] < cut[k + 1]]
        if rows:
            block, blob, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(blob, pa.binary()), pa.array(n, pa.int64())], names=["block", "blob", "segments"])

    return kernel


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blobs of a block -> (doc_id, minimisers), a row a document."""
    for b in batches:
        for blobs in b.column(0):
            parts = [unpack(x.as_buffer(), np.int64, np.uint64) for x in blobs.values]
            d, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(d, kind="stable")
            d, v = d[order], v[order]
            start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            cut = np.append(start, len(d))
            yield pa.RecordBatch.from_arrays([pa.array(d[start]), pa.array([v[cut[i] : cut[i + 1]].tobytes() for i in range(len(start))], pa.binary())], names=["doc_id", "minimisers"])


def _units(data: np.ndarray, at: np.ndarray, minimisers: pa.Array, width: int, shards: int, hot_values: np.ndarray) -> dict[str, np.ndarray]:
    """What documents have to compare: row, start, length, place (of the minimiser, from the start) and shard of each segment of a shared minimiser, or of each of its windows where the minimiser is hot."""
    of, start, windows, value, gram = segments(data, at, width)
    n = [len(x.as_buffer()) // 8 for x in minimisers]
    wanted = np.frombuffer(b"".join(x.as_buffer() for x in minimisers), np.uint64)
    key = np.sort(wanted | (np.repeat(np.arange(len(n)), n).astype(np.uint64) << np.uint64(48)))
    mine = value | (of.astype(np.uint64) << np.uint64(48))
    found = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
    some = np.flatnonzero(key[found] == mine) if len(key) else np.zeros(0, np.int64)
    of, start, windows, value = of[some], start[some], windows[some], value[some]
    place = minimiser_places(gram, start, windows, value)
    hot = np.isin(value, hot_values)
    shard = (value % np.uint64(shards)).astype(np.int64)
    if hot.any():
        each = np.where(hot, windows, 1)
        which = np.repeat(np.arange(len(of)), each)
        start = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        of, windows, place, hot, shard = of[which], np.where(hot, 1, windows)[which], place[which], hot[which], shard[which]
        shard[hot] = (span_hash(data, start[hot], start[hot] + width) % np.uint64(shards)).astype(np.int64)
    return {"row": of, "start": start, "length": windows + width - 1, "place": place - start, "shard": shard}


def _cut(width: int, groups: int, hot):
    """Documents with their shared minimisers -> (shards, chunk, blobs): the distinct segments of a chunk, a row for each group of SHARDS_EACH shards and a blob a shard; and the chunk's own list of where they stand (shards -1)."""
    shards = groups * SHARDS_EACH  # hot: a broadcast

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: dict[str, list] = {}
        size = distinct = number = 0

        def out() -> pa.RecordBatch:
            chunk = (task << 32) + number
            col = {k: np.concatenate(x) for k, x in held.items()}
            start = np.concatenate([[0], np.cumsum(col["length"])])
            ids, first = exact_ids(col["bytes"], start[:-1], start[1:], col["hash"])
            which = ids[col["which"]]
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, which, col["doc"])
            order, cut = _by_group(col["shard"][first], shards)
            rows = []
            for g in range(groups):
                blobs = []
                for k in range(g * SHARDS_EACH, (g + 1) * SHARDS_EACH):
                    mine = order[cut[k] : cut[k + 1]]
                    seg = first[mine]
                    n = col["length"][seg]
                    blobs.append(pack(mine.astype(np.int32), n.astype(np.uint8), col["place"][seg].astype(np.uint8), least[mine], gather(col["bytes"], start[seg], n)) if len(mine) else b"")
                if any(blobs):
                    rows.append((g, chunk, blobs))
            rows.append((-1, chunk, [pack(col["doc"], col["text"], col["at"], which.astype(np.int32))]))
            g, c, blobs = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(c, pa.int64()), pa.array(blobs, pa.list_(pa.binary()))], names=["shards", "chunk", "blobs"])

        for b in batches:
            data, at = text_bytes(b.column(2))
            u = _units(data, at, b.column(3), width, shards, hot.value)
            if not len(u["row"]):
                continue
            key = span_hash(data, u["start"], u["start"] + u["length"])
            ids, first = exact_ids(data, u["start"], u["start"] + u["length"], key)
            doc = b.column(0).to_numpy(zero_copy_only=False)[u["row"]]
            text = b.column(1).to_numpy(zero_copy_only=False)[u["row"]]
            new = {"hash": key[first], "length": u["length"][first], "place": u["place"][first], "shard": u["shard"][first], "bytes": gather(data, u["start"][first], u["length"][first])}
            new |= {"doc": doc, "text": text, "at": u["start"] - at[u["row"]], "which": ids + distinct}
            for k, x in new.items():
                held.setdefault(k, []).append(x)
            size += len(ids)
            distinct += len(first)
            if size > CHUNK_SEGMENTS:
                yield out()
                held, size, distinct, number = {}, 0, 0, number + 1
        if size:
            yield out()

    return kernel


def encode(data: np.ndarray, at: np.ndarray, gram: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(codes, offsets, symbols a byte, digits): the segments data[at[i] : at[i + 1]] as symbols 1 to 255.

    The GRAM bytes at each segment's `place` become the digits of `gram`, their number, in symbols that no byte has; so
    equal symbols mean equal bytes. Bytes are one symbol each, or two if nearly all 256 values occur (never in UTF-8).
    """
    present = np.bincount(data, minlength=256) > 0
    each, used = (1, int(present.sum())) if present.sum() < 250 else (2, 32)
    base, digits = 255 - used, 1
    while base**digits <= int(gram.max(initial=0)):
        digits += 1
    spot = at[:-1] + place
    if each == 1:
        out, keep = np.cumsum(present).astype(np.uint8)[data], np.ones(len(data), bool)
    else:
        out, keep = np.stack([1 + (data >> 4), 17 + (data & 15)], axis=1).astype(np.uint8).ravel(), np.ones(2 * len(data), bool)
    for k in range(digits):
        out[each * spot + k] = used + 1 + gram // base**k % base
    for k in range(digits, each * GRAM):
        keep[each * spot + k] = False
    return out[keep], each * at + np.arange(len(at)) * (digits - each * GRAM), each, digits


def least_docs(codes: np.ndarray, offsets: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For every `width` symbols in a row of every sequence, in order, the least doc of the sequences that hold them: by transform and common prefixes."""
    length = np.diff(offsets)
    out_at = np.concatenate([[0], np.cumsum(length - width + 1)])
    out = np.empty(out_at[-1], np.int64)
    bwt = CollectionBWT(codes, offsets)
    try:
        run = np.cumsum(bwt.read("lcp") < width)
        least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
        where = []
        for n, who, place in bwt.places(int(length.max())):
            if n >= width:
                np.minimum.at(least, run[place], doc[who])
                where.append((out_at[who] + length[who] - n, run[place]))
        for to, r in where:
            out[to] = least[r]
    finally:
        bwt.close()
    return out


def window_docs(data: np.ndarray, length: np.ndarray, place: np.ndarray, doc: np.ndarray, width: int, part_bytes: int | None = None) -> np.ndarray:
    """For every window of every segment, in order, the least doc of the segments that hold it.

    One transform holds segments of `part_bytes` in all; segments of one gram always share one. Only a gram that has
    more than that by itself is cut, into its windows, which are dealt to transforms by their bytes.
    """
    part_bytes = part_bytes or TRANSFORM_BYTES
    at = np.concatenate([[0], np.cumsum(length)])
    windows = length - width + 1
    out_at = np.concatenate([[0], np.cumsum(windows)])
    out = np.empty(out_at[-1], np.int64)
    spot = at[:-1] + place
    gram, _ = exact_ids(data, spot, spot + GRAM)

    def one(seg: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """`count` windows from the `first` on of some segments, in one transform."""
        n = count + width - 1
        begin = np.concatenate([[0], np.cumsum(n)])
        _, number = np.unique(gram[seg], return_inverse=True)
        codes, offsets, each, digits = encode(gather(data, at[seg] + first, n), begin, number, place[seg] - first)
        found = least_docs(codes, offsets, doc[seg], each * (width - GRAM) + digits)
        some = each * (count - 1) + 1
        e = np.cumsum(count)
        nth = np.arange(e[-1]) - np.repeat(e - count, count)
        out[np.repeat(out_at[seg] + first, count) + nth] = found[np.repeat(np.cumsum(some) - some, count) + each * nth]

    size = np.bincount(gram, weights=length)
    large = size > part_bytes
    part = np.cumsum(np.where(large, 0, size)) // part_bytes
    order = np.argsort(part[gram], kind="stable")
    order = order[~large[gram[order]]]
    if len(order):
        for seg in np.split(order, np.flatnonzero(np.diff(part[gram[order]])) + 1):
            one(seg, np.zeros(len(seg), np.int64), windows[seg])
    for g in np.flatnonzero(large):
        seg = np.flatnonzero(gram == g)
        which = np.repeat(seg, windows[seg])
        first = np.arange(len(which)) - np.repeat(np.cumsum(windows[seg]) - windows[seg], windows[seg])
        parts = -(-len(which) * width // part_bytes)
        dealt = span_hash(data, at[which] + first, at[which] + first + width) % np.uint64(parts)
        for k in range(parts):
            mine = np.flatnonzero(dealt == k)
            if len(mine):
                one(which[mine], first[mine], np.ones(len(mine), np.int64))
    return out


def _compare(width: int):
    """Segments of some shards -> (chunk, blobs): runs of windows with the same least document, of each segment of a chunk, a blob a shard."""

    def compare(blobs: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        """The answers to one shard's blobs."""
        held = []
        for chunk, blob in blobs:
            i, n, p, d, x = unpack(blob, np.int32, np.uint8, np.uint8, np.int64, np.uint8)
            held.append((np.full(len(i), chunk), i, n.astype(np.int64), p.astype(np.int64), d, x))
        chunks, index, length, place, doc, data = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.concatenate([[0], np.cumsum(length)])
        which, first = exact_ids(data, at[:-1], at[1:])
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        n = length[first]
        found = window_docs(gather(data, at[first], n), n, place[first], least, width)
        window_at = np.concatenate([[0], np.cumsum(n - width + 1)])
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[window_at[:-1]] = True
        run = np.flatnonzero(new)
        run_length = np.diff(np.append(run, len(found)))
        run_least = found[run]
        runs_at = np.searchsorted(run, window_at)
        order = np.argsort(chunks, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(chunks[order])) + 1):
            seg = which[part]
            k = runs_at[seg + 1] - runs_at[seg]
            e = np.cumsum(k)
            take = np.repeat(runs_at[seg] - (e - k), k) + np.arange(e[-1])
            yield int(chunks[part[0]]), pack(index[part], k.astype(np.uint8), run_length[take].astype(np.uint8), run_least[take])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[tuple, list] = {}  # packed as they came; one shard at a time is unpacked
        for b in batches:
            for group, chunk, blobs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for k, blob in enumerate(blobs):
                    if blob:
                        by_shard.setdefault((group, k), []).append((chunk, blob))
        answers: dict[int, list] = {}
        for shard in sorted(by_shard):
            for chunk, blob in compare(by_shard.pop(shard)):
                answers.setdefault(chunk, []).append(blob)
        if answers:
            yield pa.RecordBatch.from_arrays([pa.array(list(answers), pa.int64()), pa.array(list(answers.values()), pa.list_(pa.binary()))], names=["chunk", "blobs"])

    return kernel


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of the same doc (0, 1, ...) become one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    base = doc * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(doc), bool)
    new[1:] = (base + start)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.append(reach[first[1:] - 1], reach[-1]) - base[first]


def _spans(width: int):
    """(chunk, answers, places) of one chunk a row -> (doc_id, text_key, spans blob)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for answers, places in zip(b.column(0), b.column(1), strict=True):
                doc, text, at, which = unpack(places.as_buffer(), np.int64, np.int64, np.int64, np.int32)
                parts = [unpack(x.as_buffer(), np.int32, np.uint8, np.uint8, np.int64) for x in answers]
                index, k, run_length, run_least = (np.concatenate(x) for x in zip(*parts, strict=True))
                k, run_length = k.astype(np.int64), run_length.astype(np.int64)
                run_end = np.cumsum(k)
                of = np.repeat(np.arange(len(k)), k)
                total = np.cumsum(run_length) - run_length
                run_first = total - total[(run_end - k)[of]]  # the run's first window within its segment
                slot = np.empty(int(which.max()) + 1, np.int64)
                slot[index] = np.arange(len(index))
                seg = slot[which]
                n = k[seg]
                e = np.cumsum(n)
                take = np.repeat((run_end - k)[seg] - (e - n), n) + np.arange(e[-1])
                occ = np.repeat(np.arange(len(seg)), n)
                hit = run_least[take] < doc[occ]
                take, occ = take[hit], occ[hit]
                if not len(occ):
                    continue
                keys, row = np.unique(np.stack([doc[occ], text[occ]], axis=1), axis=0, return_inverse=True)
                start = at[occ] + run_first[take]
                row, start, end = merge_spans(row.ravel(), start, start + run_length[take] + width - 1)
                cut = np.searchsorted(row, np.arange(len(keys) + 1))
                pairs = np.stack([start, end], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([pairs[cut[i] : cut[i + 1]].tobytes() for i in range(len(keys))], pa.binary())], names=["doc_id", "text_key", "spans"])

    return kernel


def _release(spark) -> None:
    """Let Spark delete the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, width: int = WIDTH, hot_segments: int | None = None) -> DataFrame:
    """(doc_id, text_key, spans): of each document with any, the byte spans covered by `width`-byte strings that a document with a smaller doc_id also has.

    width: GRAM to 127. hot_segments: segments beyond which a minimiser is hot; HOT_SEGMENTS, or the mean of all shards
    if that is more, unless given.
    """
    if not GRAM <= width < 128:
        raise ValueError(f"width must be {GRAM} to 127, not {width}")
    spark = ready(docs.sparkSession)
    n = partitions(spark)
    known = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    asked = known.select("doc_id", "text").mapInArrow(tidy(_ask(width, 2 * n)), "shard int, doc_id long, blob binary")
    shared = staged(asked.repartition(n, "shard").mapInArrow(tidy(_answer(n, HOT_SEGMENTS if hot_segments is None else hot_segments)), "block int, blob binary, segments long"), "minimisers")
    _release(spark)
    if hot_segments is None:
        every = shared.where("block = -1").agg(F.coalesce(F.sum("segments"), F.lit(0))).first()[0]
        hot_segments = max(HOT_SEGMENTS, every // (n * SHARDS_EACH))  # so fewer than n * SHARDS_EACH minimisers have more
    hot = [r[0] for r in shared.where((F.col("block") == -2) & (F.col("segments") > hot_segments)).select("blob").collect()]
    hot = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(hot), np.uint64)))
    lists = shared.where("block >= 0").groupBy("block").agg(F.collect_list("blob").alias("blobs")).select("blobs").mapInArrow(tidy(_lists), "doc_id long, minimisers binary")
    texts = known.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(lists.hint("merge"), "doc_id").sortWithinPartitions("doc_id", "text_key")
    cut = staged(texts.select("doc_id", "text_key", "text", "minimisers").mapInArrow(tidy(_cut(width, n, hot)), "shards int, chunk long, blobs array<binary>"), "segments")
    drop(shared)
    _release(spark)
    compared = cut.where("shards >= 0").repartitionById(n, F.col("shards")).mapInArrow(tidy(_compare(width)), "chunk long, blobs array<binary>")
    answers = compared.groupBy("chunk").agg(F.flatten(F.collect_list("blobs")).alias("answers"))
    places = cut.where("shards < 0").select("chunk", F.col("blobs")[0].alias("places"))
    spans = staged(answers.join(places, "chunk").select("answers", "places").mapInArrow(tidy(_spans(width)), "doc_id long, text_key long, spans binary"), "spans")
    drop(cut)
    hot.unpersist()
    _release(spark)
    return spans


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """One row per document: doc_id, `keep`, n_bytes, spans (array of start, end in bytes), kept (binary: the bytes outside the spans).

    whole_characters: a character of which a span takes some bytes goes altogether, so that kept is valid UTF-8.
    Null texts are empty; texts shorter than `width` are kept whole. Rows with equal doc_ids don't remove from one
    another. Rows with a null doc_id are kept whole and remove nothing. An empty table gives an empty table. Columns of
    any name may be there; one in `keep` that is named like a column made here is a ValueError.
    """
    free_names(keep, "doc_id", "n_bytes", "spans", "kept", "text_key", "_text")
    rows = docs.select("doc_id", *keep, F.col("text").alias("_text"), F.xxhash64("text").alias("text_key"))
    joined = rows.join(repeated_spans(docs, width).dropDuplicates(["doc_id", "text_key"]), ["doc_id", "text_key"], "left")
    kept = joined.select("doc_id", *keep, "_text", "spans")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in ("_text", "spans")] + ["n_bytes long", "spans array<struct<start:long,end:long>>", "kept binary"])
    n = 1 + len(keep)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(n))
            found = [(i, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2)) for i, x in enumerate(b.column(n + 1)) if x.is_valid]
            step = np.zeros(len(data) + 1, np.int8)
            count = np.zeros(b.num_rows, np.int64)
            for i, s in found:
                count[i] = len(s)
                step[at[i] + s[:, 0]] += 1
                step[at[i] + s[:, 1]] -= 1
            stay = np.cumsum(step[:-1], dtype=np.int8) == 0
            if whole_characters and len(data):
                character = np.cumsum(chars(data)) - 1
                stay = (np.bincount(character, weights=~stay) == 0)[character]
            total = np.concatenate([[0], np.cumsum(stay, dtype=np.int64)])
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(total[at]), pa.py_buffer(data[stay].tobytes())]).cast(pa.binary())
            pairs = np.concatenate([s for _, s in found]) if found else np.zeros((0, 2), np.int64)
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(np.diff(at)), spans, kept], names=["doc_id", *keep, "n_bytes", "spans", "kept"])

    return kept.mapInArrow(tidy(kernel), schema)


def op2_repeat_removal(spark, sf_dir):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
