"""N-gram Jaccard join by MinHash banding.

Documents with equal sets of five-word shingles are one class. Classes meet in buckets of band hashes; classes that
meet, directly or over others, form a candidate component; within a component all pairs are verified on their full
shingle sets, in blocks of bounded size, as products of 0/1 matrices. Pairs never become rows: a block gives each class
the number of its links and an edge of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import partitions, ready, staged, table, tidy
from loomstone.llm.components import connected_components
from loomstone.llm.textkernel import doc_of, lower_words, mix, span_hash, text_bytes

WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Classes and shingles of one side of a verification block.
BLOCK_CLASSES, BLOCK_SHINGLES = 1000, 1_000_000


#: A class: the least doc_id that has its set, and half of the set's key, which tells classes apart whose rows share a doc_id.
NODE, NODE_ARROW = "struct<class_id: long, k1: long>", pa.struct([("class_id", pa.int64()), ("k1", pa.int64())])
KEY = "_loomstone_text_key"


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which a pair at `similarity` meets with probability `recall` within `most` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = ceil(log(1 - recall) / log(1 - similarity**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles, end to end, and their offsets.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. A text of fewer words, but not
    none, is one shingle; a null text has none.
    """
    data, at = text_bytes(column)
    n = len(at) - 1
    low, start, end = lower_words(data, at)
    doc = doc_of(start, at)
    word = span_hash(low, start, end)
    count = np.bincount(doc, minlength=n)
    width = np.minimum(count, words)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    i = np.arange(len(word))
    starts = i[i - first[doc] <= (count - width)[doc]] if len(word) else i
    of = doc[starts]
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            there = k < width[of]
            h = np.where(there, mix(h * np.uint64(0x100000001B3) + word[np.minimum(starts + k, max(len(word) - 1, 0))]), h) if len(word) else h
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def _factors(n: int) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64(5081))
    return r.integers(0, 1 << 63, (n, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(h: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, a row a text with shingles: each of `rows` minima over the text's shingles under random maps."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(full), bands), np.uint64)
    starts = at[full]
    for k, (a, b) in enumerate(_factors(bands * rows)):
        with np.errstate(over="ignore"):
            least = np.minimum.reduceat((h ^ (b >> np.uint64(1))) * a >> np.uint64(16), starts) if len(full) else np.zeros(0, np.uint64)
            out[:, k // rows] = mix(out[:, k // rows] * np.uint64(0x100000001B3) + least + np.uint64(k // rows + 1))
    return out


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = shingles(b.column(2), words)
            size = np.diff(at)
            with np.errstate(over="ignore"):
                keys = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x5A17, 0xC0FFEE)]
                keys = [(k[at[1:]] - k[at[:-1]]).view(np.int64) for k in keys]
            sig = signatures(h, at, bands, rows).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
            band = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(keys[0]), pa.array(keys[1]), band], names=["doc_id", "text_key", "n", "k1", "k2", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidy(kernel), "doc_id long, text_key long, n long, k1 long, k2 long, bands array<long>")


def _verify(sizes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within one block: of each class the first class it is linked to over any links, linked classes, linked documents.

    side: 1 left block, 2 right block, 3 both (a block with itself); a pair counts if it joins left and right.
    """
    m = len(sets)
    length = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(m), length)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, row = flat[order], row[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1
    row, column = row[often], column[often]
    common = np.zeros((m, m), np.float32)
    if len(row):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        step = max(256, (24 << 20) // (4 * m))
        cuts = np.searchsorted(column, np.arange(0, column[-1] + step + 1, step))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a == b:
                continue
            part = np.zeros((m, step), np.float32)
            part[row[a:b], column[a:b] - k * step] = 1
            common += part @ part.T
    need = similarity / (1 + similarity) * (length[:, None] + length[None, :])
    linked = common >= need - 1e-6 * need
    linked &= ((side[:, None] & 1) > 0) & ((side[None, :] & 2) > 0) | ((side[:, None] & 2) > 0) & ((side[None, :] & 1) > 0)
    np.fill_diagonal(linked, False)
    label = np.arange(m)
    a, b = np.nonzero(linked)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            break
        label = new
    return label, linked.sum(axis=1), linked @ sizes


def _links(blocks: DataFrame, similarity: float) -> DataFrame:
    """Blocks (component, i, j, side, class, copies, shingles) -> (class, root, classes, documents), a row a class and block with a link."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None

        def out() -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])
            label, classes, documents = _verify(*(np.array([r[k] for r in held], np.int64) for k in (1, 2)), [r[3] for r in held], similarity)
            some = np.flatnonzero(classes > 0)
            nodes = [pa.array([dict(zip(("class_id", "k1"), held[i][0], strict=True)) for i in x], NODE_ARROW) for x in (some.tolist(), label[some].tolist())]
            return pa.RecordBatch.from_arrays([*nodes, pa.array(classes[some].astype(np.int64)), pa.array(documents[some].astype(np.int64))], names=["class", "root", "classes", "documents"])

        for b in batches:
            keys = [(*c.values(), i, j) for c, i, j in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            side, node, copies = (b.column(i).to_pylist() for i in (3, 4, 5))
            for r in range(b.num_rows):
                if keys[r] != key:
                    if len(held) > 1:
                        yield out()
                    held, key = [], keys[r]
                held.append((tuple(node[r].values()), copies[r], side[r], np.frombuffer(b.column(6)[r].as_buffer(), np.uint64).copy()))
        if len(held) > 1:
            yield out()

    return blocks.select("component", "i", "j", "side", "class", "copies", "shingles").mapInArrow(tidy(kernel), f"class {NODE}, root {NODE}, classes long, documents long")


def ngram_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, n_class_links, group_id.

    class_id: the least doc_id with the same set of shingles. n_links: other documents at `similarity` or more (the rest
    of its own class and all documents of linked classes); n_class_links: the linked classes. group_id: the least doc_id
    reached over links. A link between two different texts is found if they meet in a band (probability `recall` at
    `similarity`, more above) or over a chain of classes that meet; every one found is verified on the full sets, whose
    shingles are 64-bit hashes.

    Null texts and texts without words link to nothing and are classes of their own. Rows that share a doc_id are
    documents of their own: with equal sets they are copies in one class, with others they are in different classes,
    which may then have the same class_id or group_id. Null doc_ids take no part and come back with class_id null. An
    empty table gives an empty table; extra columns are not read.
    """
    return _joined(docs, words, similarity, recall).select("doc_id", "class_id", "class_size", "n_links", "n_class_links", "group_id")


def _joined(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """ngram_join's columns, text_key (of the row's text) and first: is this the row that stands for its group?"""
    spark = ready(docs.sparkSession)
    bands, rows = choose_bands(similarity, recall)
    signed = staged(_signed(docs, words, bands, rows), "signed")
    key = ["n", "k1", "k2"]
    worded = signed.where("n > 0 and doc_id is not null")
    sized = worded.groupBy(*key).agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.count(F.lit(1)).alias("class_size"))
    members = staged(worded.join(sized, key).select("doc_id", "text_key", F.struct(F.col("head.doc_id").alias("class_id"), "k1").alias("class"), "class_size", "n", (F.struct("doc_id", "text_key") == F.col("head")).alias("leads"), F.when(F.struct("doc_id", "text_key") == F.col("head"), F.col("bands")).alias("bands")), "members")
    # One row of each class carries its bands: repeated rows of the head are equal.
    classes = members.where("leads").select("class", "text_key", "class_size", "n", "bands").dropDuplicates(["class"])

    met = classes.select("class", F.explode(F.array_distinct("bands")).alias("bucket"))
    heads = met.groupBy("bucket").agg(F.min("class").alias("head"), F.max("class").alias("last")).where("head < last")
    edges = met.join(heads, "bucket").where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
    candidates = staged(connected_components(edges), "candidates")

    there = staged(classes.drop("bands").join(candidates, classes["class"] == candidates["node"]).select("class", "text_key", "class_size", "component", "n"), "there")
    blocks = there.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = there.join(blocks, "component").select(F.col("class.class_id").alias("doc_id"), "text_key", "class", "class_size", "component", "blocks", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["class", "copies", "component", "blocks", "block", "shingles"]
        for b in batches:
            h, at = shingles(b.column(5), words)
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(at * 8), pa.py_buffer(h.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), blob], names=names)

    # Candidates grow with the corpus: the same shuffle at every size, no broadcast of those that happen to be few.
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(placed.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["class"])
    sets = texts.select("class", F.col("class_size").alias("copies"), "component", "blocks", "block", "text").mapInArrow(tidy(cut), f"class {NODE}, copies long, component {NODE}, blocks int, block int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = sets.select("*", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"), "class", "copies", "shingles")
    paired = paired.repartition(partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = staged(_links(paired, similarity), "links")

    groups = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("class").agg(F.sum("classes").alias("n_class_links"), F.sum("documents").alias("documents"))
    counts = counts.join(groups, counts["class"] == groups["node"], "left").select("class", "n_class_links", "documents", "component")
    linked = members.drop("bands", "n").join(counts, "class", "left").withColumn("root", F.coalesce("component", "class"))
    none = F.lit(0).cast("long")
    linked = linked.select("doc_id", F.col("class.class_id").alias("class_id"), "class_size", (F.coalesce("documents", none) + F.col("class_size") - 1).alias("n_links"), F.coalesce("n_class_links", none).alias("n_class_links"), F.col("root.class_id").alias("group_id"), "text_key", (F.col("leads") & (F.col("class") == F.col("root"))).alias("first"))
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), none.alias("n_links"), none.alias("n_class_links"), F.col("doc_id").alias("group_id"), "text_key", F.lit(True).alias("first"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs, with the document of the least doc_id of each group of linked documents and without the others.

    Of rows with equal doc_id and text one stays; rows that share a doc_id but not a text are judged one by one. Rows
    with a null doc_id, and documents without words, stay.
    """
    others = _joined(docs, **options).where("not first").select("doc_id", "text_key").distinct()
    rows = docs.where("doc_id is not null").withColumn(KEY, F.xxhash64("text"))
    named = rows.join(others.withColumnRenamed("text_key", KEY), ["doc_id", KEY], "left_anti").dropDuplicates(["doc_id", KEY])
    return named.select(*docs.columns).union(docs.where("doc_id is null"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))
