"""Benchmark decontamination with suffix arrays over the training documents.

Each shard (an Arrow batch of whole documents) gets a word-level suffix array; every test suffix is looked up in it by
binary search, all at once. The range of suffixes that begin with a test window gives every verbatim occurrence with
its place; windows in a row on one diagonal make the longest match. Words are numbered by their bytes (equal hashes are
compared), so a hash never decides. The benchmark goes round in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import free_names, ready, staged, table, tidy
from loomstone.llm.textkernel import doc_of, exact_ids, lower_words, same_spans, span_hash, text_bytes

WINDOW = 10
#: Bytes of benchmark text in one block: one broadcast, and one pass over the documents.
BLOCK_BYTES = 32 << 20
MATCH = "array<struct<item_id:long,item_word:int,doc_word:int,n_words:int>>"


def suffix_array(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of a word sequence (ids from 0) in order, each read to its document's end; equal ones by place.

    end: for each word the place where its document ends. Prefix doubling; from the second round on only suffixes that
    still tie are sorted.
    """
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    head = np.ones(n, bool)
    head[1:] = ids[sa[1:]] != ids[sa[:-1]]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    tied = np.ones(n, bool)
    tied[:-1] = ~head[1:]
    tied[-1:] = False
    tied |= ~head
    slots, k = np.flatnonzero(tied), 1
    while len(slots):
        at = sa[slots]
        ahead = at + k
        inside = ahead < end[at]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        order = np.argsort(group * (n + 1) + second, kind="stable")
        at, second, group = at[order], second[order], group[order]
        sa[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        heads = np.maximum.accumulate(np.where(new, slots, 0))
        rank[at] = heads
        alike = ~new
        alike[:-1] |= ~new[1:]
        alike &= second > 0  # two that ended together stay as they are
        slots = slots[alike]
        k *= 2
    return sa


class Benchmark:
    """A block of test items: their distinct words with hashes, `word` (of each running word, which one it is), and the windows to look up."""

    def __init__(self, item_ids: list[int], texts: pa.Array, window: int):
        data, at = text_bytes(texts)
        self.low, start, stop = lower_words(data, at)
        item = doc_of(start, at)
        count = np.bincount(item, minlength=len(item_ids))
        first = np.cumsum(count) - count
        key = span_hash(self.low, start, stop)
        self.word, one = exact_ids(self.low, start, stop, key)
        self.key, self.start, self.length = key[one], start[one], (stop - start)[one]
        width = np.minimum(count, window)
        begins = np.maximum(count - width + 1, 0) * (count > 0)
        self.item = np.repeat(np.arange(len(item_ids)), begins)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(begins) - begins, begins) + first[self.item]
        self.width = width[self.item]
        self.first = first
        self.item_ids = np.array(item_ids, np.int64)

    def numbered(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mine): a number for each document word, and for each distinct word of the block its number there or -1. Numbers are equal if and only if the bytes are."""
        key = span_hash(low, start, stop)
        ids, one = exact_ids(low, start, stop, key)
        known, mine = key[one], np.full(len(self.key), -1)
        at, todo = np.searchsorted(known, self.key), np.arange(len(self.key))
        while len(todo := todo[at[todo] < len(known)]) and len(todo := todo[known[at[todo]] == self.key[todo]]):
            theirs = one[at[todo]]
            same = (stop - start)[theirs] == self.length[todo]
            same[same] = same_spans(low, start[theirs[same]], self.low, self.start[todo[same]], self.length[todo[same]])
            mine[todo[same]] = at[todo[same]]
            todo = todo[~same]  # another word of the same hash comes next, if there is one
            at[todo] += 1
        return ids, mine


def find_windows(ids: np.ndarray, mine: np.ndarray, end: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence of every window among the document words."""
    mine = mine[bench.word]
    missing = np.concatenate([[0], np.cumsum(mine < 0)])
    live = np.flatnonzero(missing[bench.at + bench.width] == missing[bench.at])  # the others have a word that no document here has
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa = suffix_array(ids, end)
    at, width = bench.at[live], bench.width[live]

    def search(past_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            place = sa[np.minimum(mid, len(sa) - 1)]
            order = np.zeros(len(live), np.int8)  # of the suffix against the window
            todo = np.flatnonzero(open_)
            for k in range(int(width.max())):
                todo = todo[width[todo] > k]
                if not len(todo):
                    break
                p = place[todo] + k
                ended = p >= end[place[todo]]
                theirs = np.where(ended, -1, ids[np.minimum(p, len(ids) - 1)])
                own = mine[at[todo] + k]
                order[todo] = np.sign(theirs - own)
                todo = todo[theirs == own]
            right = open_ & ((order < 0) | (past_equal & (order == 0)))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    low, high = search(False), search(True)
    count = high - low
    take = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.repeat(live, count), sa[take]


def _kernel(block, window: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = Benchmark(*block.value, window)
        for b in batches:
            data, at = text_bytes(b.column(keep))
            low, start, stop = lower_words(data, at)
            doc = doc_of(start, at)
            n_words = np.bincount(doc, minlength=b.num_rows)
            ends = np.cumsum(n_words)
            hit_doc = np.zeros(0, np.int64)
            if len(start) and len(bench.at):
                which, place = find_windows(*bench.numbered(low, start, stop), ends[doc], bench)
                # One match for each run of windows on one diagonal of one item and document.
                first = ends - n_words
                order = np.lexsort((place, place - bench.at[which], bench.item[which], doc[place]))
                which, place = which[order], place[order]
                new = np.ones(len(which), bool)
                new[1:] = (np.diff(which) != 1) | (np.diff(place) != 1) | (bench.item[which[1:]] != bench.item[which[:-1]]) | (doc[place[1:]] != doc[place[:-1]])
                head = np.flatnonzero(new)
                size = np.diff(np.append(head, len(which))) - 1 + bench.width[which[head]] if len(head) else head
                which, place = which[head], place[head]
                hit_doc = doc[place]
            counts = np.bincount(hit_doc, minlength=b.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            if len(hit_doc):
                item = bench.item[which]
                columns = [bench.item_ids[item], (bench.at[which] - bench.first[item]).astype(np.int32), (place - first[hit_doc]).astype(np.int32), size.astype(np.int32)]
            else:
                columns = [np.zeros(0, np.int64), *[np.zeros(0, np.int32)] * 3]
            matches = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["item_id", "item_word", "doc_word", "n_words"]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep)), pa.array(n_words.astype(np.int64)), matches], names=[*b.schema.names[:keep], "n_words", "matches"])

    return run


def _blocks(benchmark: DataFrame, size: int) -> Iterator[tuple[list[int], pa.Array]]:
    """The items, streamed to the driver one partition at a time, in blocks of a bounded number of bytes."""
    ids, texts, held = [], [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        held += len(r[1])
        if held >= size:
            yield ids, pa.array(texts, pa.large_string())
            ids, texts, held = [], [], 0
    if ids:
        yield ids, pa.array(texts, pa.large_string())


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, `keep`, n_words, matches (item_id, item_word, doc_word, n_words of each longest verbatim run of `window` or more words), n_hit, items.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters; an item of fewer words than a
    window is one window. n_hit: words inside any match. items: the sorted distinct items. Null texts have no words; null
    items, items without words and an empty benchmark match nothing. Repeated documents and items are reported alike
    (repeated item rows twice in matches, once in items). An empty table gives an empty table. Columns of any name may be
    there; one in `keep` that is named like a column made here is a ValueError.
    """
    free_names(keep, "doc_id", "n_words", "matches", "n_hit", "items", "_read", "_text")
    spark = ready(docs.sparkSession)
    send = spark.sparkContext.broadcast
    none = ([], pa.array([], pa.large_string()))
    blocks = _blocks(benchmark, block_bytes)
    first = next(blocks, none)
    second = next(blocks, None)
    rows = docs.select("doc_id", *keep, F.col("text").alias("_read"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    schema = f"{head}, n_words long, matches {MATCH}"
    if second is None:
        out = rows.mapInArrow(tidy(_kernel(send(first), window, 1 + len(keep))), schema)
    else:  # a pass for each block, with that block alone in memory; rows are known by a number that is written with them
        rows = staged(rows.withColumn("_text", F.monotonically_increasing_id()).select(*rows.columns[:-1], "_text", "_read"), "numbered")
        passes = None
        for block in chain((first, second), blocks):
            sent = send(block)
            one = staged(rows.select("_text", "_read").mapInArrow(tidy(_kernel(sent, window, 1)), f"_text long, n_words long, matches {MATCH}").where("size(matches) > 0").drop("n_words"), "pass")
            sent.destroy()
            passes = one if passes is None else passes.union(one)
        found = passes.groupBy("_text").agg(F.flatten(F.collect_list("matches")).alias("matches"))
        counted = rows.mapInArrow(_kernel(send(none), window, 2 + len(keep)), f"{head}, _text long, n_words long, matches {MATCH}").drop("matches")
        out = counted.join(found, "_text", "left").select("doc_id", *keep, "n_words", F.coalesce("matches", F.array().cast(MATCH)).alias("matches"))
    by_place = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    covered = F.aggregate(by_place, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), lambda s, m: F.struct((s["n"] + F.greatest(m["b"] - F.greatest(m["a"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], m["b"]).alias("to")))
    return out.withColumn("n_hit", covered["n"]).withColumn("items", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))))


def op4_decontamination(spark, sf_dir):
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
