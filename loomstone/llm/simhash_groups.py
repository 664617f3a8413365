"""SimHash near-duplicates by multi-index hashing.

Each different fingerprint is entered in one table a segment of its bits. Two fingerprints that differ in few bits
differ in still fewer within at least one segment, so it is enough to look, in each table, at the values within a small
Hamming ball around a fingerprint's own; what is met there is compared over all 64 bits. Of two values the greater asks
for the less, so a pair is met once a segment. Pairs don't become rows: a bucket gives the edges of a spanning forest
of its links, or, while it is tiny, its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import partitions, ready, staged, table, tidy
from loomstone.llm.components import connected_components
from loomstone.llm.textkernel import LOWER, SPACE, doc_of, runs, text_bytes

WORDS, BITS_APART, SEED = 4, 4, 42
#: Rows of a bucket that are compared at once; a greater bucket is dealt out in blocks of pairs of such parts.
BLOCK_ROWS = 8192
#: A bucket of at most so many rows gives its links themselves.
TINY = 32
#: Pairs that are held at once.
PAIRS = 1 << 20

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def fingerprints(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if more than half of the shingles' XXH64 hashes have it.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; shingles are taken with their repeats. A text of
    fewer words, but not none, is one shingle; a text without words, or null, has fingerprint 0.
    """
    data, at = text_bytes(column)
    n = len(at) - 1
    low = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    start, end = runs(~SPACE[low], at)
    doc = doc_of(start, at)
    count = np.bincount(doc, minlength=n)
    # Words with one blank before each that isn't its text's first.
    keep, one = ~SPACE[low], low.copy()
    after = start[1:][doc[1:] == doc[:-1]] - 1
    keep[after], one[after] = True, 0x20
    place = np.cumsum(keep)
    begin, stop = place[start] - 1, place[end - 1]
    flat = one[keep].tobytes()

    width = np.minimum(count, words)
    first = np.cumsum(count) - count
    i = np.arange(len(start))
    i = i[i - first[doc] <= (count - width)[doc]]
    of = doc[i]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], SEED) for a, b in zip(begin[i].tolist(), stop[i + width[of] - 1].tolist())], np.uint64)
    half = np.bincount(of, minlength=n) / 2
    out = np.zeros(n, np.uint64)
    for k in range(8):  # a byte of the hashes at a time: how often each document has each of its values
        byte = (h >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)
        ones = np.bincount(of * 256 + byte, minlength=n * 256).reshape(n, 256) @ _BITS
        out |= ((ones > half[:, None]).astype(np.uint64) << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def choose_segments(n: int, apart: int = BITS_APART) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment, for n fingerprints: whatever the choice, every pair within `apart` is met.

    With s segments, `apart` = s * r + rest: if none of the first rest + 1 segments differs in r bits at most and none
    of the others in r - 1, the pair differs in more than `apart`. Fewer segments have greater balls and smaller
    buckets; those are chosen with the fewest rows and comparisons.
    """

    def segments(s: int) -> list[tuple[int, int, int]]:
        cuts = [64 * k // s for k in range(s + 1)]
        r, rest = divmod(apart, s)
        return [(a, b - a, r if k <= rest else r - 1) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if k <= rest or r > 0]

    def cost(parts: list[tuple[int, int, int]]) -> float:
        balls = [sum(comb(w, d) for d in range(r + 1)) for _, w, r in parts]
        # A row is made, dealt and sorted: some hundred times a comparison.
        return sum(100 * n * ball / 2 + n * n * ball / 2 ** (w + 1) for ball, (_, w, _) in zip(balls, parts))

    return min((segments(s) for s in range(2, max(apart, 2) + 1)), key=cost)


def _entered(prints: DataFrame, segments: list[tuple[int, int, int]]) -> DataFrame:
    """(f) -> (key, asks, f): each fingerprint's own bucket of every segment, and the buckets of lesser values in its ball.

    A key holds the number of its segment above its bits.
    """
    rows = None
    for k, (low, width, radius) in enumerate(segments):
        ball = [sum(1 << b for b in c) for d in range(1, radius + 1) for c in combinations(range(width), d)]
        value = F.shiftrightunsigned("f", low).bitwiseAND(F.lit((1 << width) - 1))
        mine = prints.select("f", value.alias("v"))
        asked = F.filter(F.transform(F.array(*map(F.lit, ball)) if ball else F.array().cast("array<long>"), lambda m: F.col("v").bitwiseXOR(m.cast("long"))), lambda x: x < F.col("v"))
        each = mine.select("f", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("asks"), F.col("v").alias("at"))), F.transform(asked, lambda x: F.struct(F.lit(1).alias("asks"), x.alias("at"))))).alias("e"))
        part = each.select((F.col("e.at") + (k << 40)).alias("key"), F.col("e.asks").cast("byte").alias("asks"), "f")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _dealt(rows: DataFrame, block_rows: int) -> DataFrame:
    """(key, asks, f) -> (key, block, side, asks, f): buckets of more than block_rows rows in blocks of pairs of parts, side 0 or 1, all others in one block, side 2."""
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    hot = staged(hot, "hot")
    if not hot.count():
        return rows.select("key", F.lit(0).alias("block"), F.lit(2).cast("byte").alias("side"), "asks", "f")
    parted = rows.join(hot, "key", "left").withColumn("mine", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    each = parted.select("key", "asks", "f", "parts", "mine", F.explode(other).alias("other"))
    block = F.when(F.col("parts").isNull(), 0).otherwise(F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"))
    side = F.when(F.col("parts").isNull() | (F.col("mine") == F.col("other")), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return each.select("key", block.alias("block"), side.cast("byte").alias("side"), "asks", "f")


def _forest(f: np.ndarray, asks: np.ndarray, side: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between entered fingerprints and all others of one block."""
    order = np.argsort(asks, kind="stable")
    f, side = f[order], side[order]
    label = np.arange(len(f))
    one, two = [], []
    for i in range(int((asks == 0).sum())):
        near = np.bitwise_count(f[i + 1 :] ^ f[i]) <= apart
        if side[i] != 2:
            near &= side[i + 1 :] != side[i]
        to = i + 1 + np.flatnonzero(near)
        to = to[label[to] != label[i]]
        if len(to):
            new, at = np.unique(label[to], return_index=True)
            one += [f[i]] * len(new)
            two += f[to[at]].tolist()
            label[np.isin(label, new)] = label[i]
    return np.array(one, np.uint64), np.array(two, np.uint64)


def _links(key: np.ndarray, asks: np.ndarray, side: np.ndarray, f: np.ndarray, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole buckets, end to end -> links or forests, (fingerprints, fingerprints)."""
    if not len(key):
        return
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    own = np.add.reduceat((asks == 0).astype(np.int64), start)
    met = (own > 0) & (size > 1)
    for a, n in zip(start[met & (size > TINY)].tolist(), size[met & (size > TINY)].tolist()):
        yield _forest(f[a : a + n], asks[a : a + n], side[a : a + n], apart)
    tiny = met & (size <= TINY)
    # Each row of a tiny bucket that is entered meets the rows after it; entered ones come first.
    at = np.repeat(start[tiny], own[tiny]) + np.arange(own[tiny].sum()) - np.repeat(np.cumsum(own[tiny]) - own[tiny], own[tiny])
    after = np.repeat((start + size)[tiny], own[tiny]) - at - 1
    for a in range(0, len(at), PAIRS // TINY):
        one, n = at[a : a + PAIRS // TINY], after[a : a + PAIRS // TINY]
        two = np.repeat(one + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        one = np.repeat(one, n)
        near = (np.bitwise_count(f[one] ^ f[two]) <= apart) & ((side[one] == 2) | (side[one] != side[two]))
        yield f[one[near]], f[two[near]]


def _met(apart: int):
    """A kernel over rows sorted by (key, block, asks): a bucket's rows are held until the next one begins."""

    def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
        key = b.column("key").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.column("block").to_numpy().astype(np.uint64)
        return [key, b.column("asks").to_numpy(), b.column("side").to_numpy(), b.column("f").to_numpy().view(np.uint64)]

    def edges(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for one, two in _links(*rows, apart):
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["a", "b"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of one bucket, or of several that end with one that may go on
        for b in batches:
            rows = arrays(b)
            begins = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
            goes_on = bool(held) and held[-1][0][-1] == rows[0][0]
            if not goes_on or len(begins) > 1:
                last = int(begins[-1])
                yield from edges([np.concatenate(x) for x in zip(*held, [x[:last] for x in rows])])
                held, rows = [], [x[last:] for x in rows]
            held.append(rows)
        if held:
            yield from edges([np.concatenate(x) for x in zip(*held)])

    return tidy(kernel)


def link_fingerprints(prints: DataFrame, apart: int = BITS_APART, block_rows: int = BLOCK_ROWS, segments: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Different fingerprints (f long) -> (a, b): edges that connect exactly those fingerprints that links of at most `apart` bits connect."""
    spark = ready(prints.sparkSession)
    entered = _entered(prints, segments or choose_segments(prints.count(), apart))
    rows = _dealt(entered, block_rows).repartition(partitions(spark), "key", "block").sortWithinPartitions("key", "block", "asks")
    return rows.mapInArrow(_met(apart), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = WORDS, apart: int = BITS_APART, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, fingerprint, component_id), a row a row.

    component_id is the smallest doc_id that is reached over any number of links, the document's own included. Texts
    without words have fingerprint 0 and are linked like others. Rows that share a doc_id each have their own
    fingerprint; a row without doc_id is a row like others, but never the smallest, and where no row of a component has
    one, component_id is null. An empty table has no rows.
    """
    spark = ready(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), words))], names=["doc_id", "f"])

    signed = staged(docs.select("doc_id", "text").mapInArrow(tidy(kernel), "doc_id long, f long"), "prints")
    prints = staged(signed.groupBy("f").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "different")
    members = staged(connected_components(link_fingerprints(prints.select("f"), apart, block_rows)), "members").withColumnsRenamed({"node": "f", "component": "root"})
    rooted = prints.join(members, "f", "left").withColumn("root", F.coalesce("root", "f"))
    of = staged(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("f", "component_id", "copies"), "components")

    # A fingerprint of more rows than a partition's share is hot; fewer than partitions can be, so those may be broadcast.
    n = partitions(spark)
    total = prints.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.broadcast(of.where(F.col("copies") * n > total).select("f", "component_id"))
    rest = of.where(F.col("copies") * n <= total).select("f", "component_id")
    joined = signed.join(hot, "f").unionByName(signed.join(hot, "f", "left_anti").join(rest, "f"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their fingerprints, and the components that links of at most four bits make."""
    return simhash_groups(table(spark, sf_dir, "documents"))
