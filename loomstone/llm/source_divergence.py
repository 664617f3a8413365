"""Source divergence audit: how far the vocabularies of a language's sources lie apart, and the terms that mark a source.

The counts of a term are one wide row: an array with a place for each source of the language. Within a row, JVM
higher-order functions turn counts into shares and emit what the term adds to each pair of sources; what is emitted is
summed before the shuffle, so each task sends a row a pair, however many terms it read. All arithmetic is on whole
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.common import ready, staged, table, tidy
from loomstone.llm.textkernel import LOWER as LOWER_CASE
from loomstone.llm.textkernel import doc_of, exact_ids, runs, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of lower-cased terms: letters, and all bytes of characters that aren't ASCII.
TERM = np.array([b >= 0x80 or chr(b) in LOWER for b in range(256)])
LEAST_DOCUMENTS, TOP = 10, 10
SCALE = 1_000_000_000
#: Rows of the table of groups up to which it is broadcast.
MOST_BROADCAST = 20_000

_SHARE = "1 + CAST({scale}BD * ({count} + 2) AS DECIMAL(38, 0)) div CAST({n} + 2 * v AS DECIMAL(38, 0))"
_GAP = "(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, documents) of each batch."""
    for b in batches:
        data, at = text_bytes(b.column(2))
        low = np.frombuffer(data.tobytes().translate(LOWER_CASE), np.uint8)
        start, end = runs(TERM[low], at)
        if not len(start):
            continue
        groups = pa.table({"lang": b.column(0), "source": b.column(1), "doc": np.arange(b.num_rows)})
        names = groups.group_by(["lang", "source"], use_threads=False).aggregate([("doc", "list")])
        group = np.empty(b.num_rows, np.int64)
        lists = names["doc_list"].combine_chunks()
        group[lists.flatten().to_numpy()] = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        doc = doc_of(start, at)
        term, first = exact_ids(low, start, end)
        per_doc, times = np.unique(doc * len(first) + term, return_counts=True)
        key, at_key = np.unique(group[per_doc // len(first)] * len(first) + per_doc % len(first), return_inverse=True)
        n = np.bincount(at_key, weights=times).astype(np.int64)
        begin, length = start[first], end[first] - start[first]
        flat = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32).tobytes()), pa.py_buffer(low[flat].tobytes()))
        of = pa.array(key // len(first))
        yield pa.RecordBatch.from_arrays([names["lang"].combine_chunks().take(of), names["source"].combine_chunks().take(of), texts.take(pa.array(key % len(first))), pa.array(n), pa.array(np.bincount(at_key))], names=["lang", "source", "term", "n", "documents"])


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, text) -> (lang, term, n, counts): the terms in at least that many documents of the language, how often they occur in it, and in each source that has them.

    Within an Arrow batch, terms are numbered by their bytes and counted by (lang, source); Spark then sums by
    (lang, source, term) before the shuffle, so a hot language, source or word sends a row a task.
    """
    each = docs.select("lang", "source", "text").mapInArrow(tidy(_counted), "lang string, source string, term string, n long, documents long")
    by_source = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    wide = by_source.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return wide.where(F.col("documents") >= least_documents).select("lang", "term", "n", "counts")


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, v, n_lang, sources): of each language its terms, their occurrences, and its sources in order with theirs."""
    totals = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"))
    there = docs.groupBy("lang", "source").agg(F.lit(1).alias("there")).drop("there")
    each = there.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
    return each.join(terms, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), "sources")


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Documents -> (lang, source, part, item, value, rank): the distance of each source from the others of its language, and the terms that it has more of than its language.

    Every row is a document, repeated ones too. Null texts, languages and sources are as empty ones. A source without
    terms is as far from others as its smoothed shares are; a language without terms is at 0 everywhere, and one of a
    single source has no pairs. Equal values are in the order of their items' bytes. An empty table has no rows.
    """
    spark = ready(docs.sparkSession)
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = staged(term_counts(plain, least_documents), "terms")
    groups = staged(_groups(plain, kept), "groups")
    small = groups.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0] <= MOST_BROADCAST
    per_lang = F.broadcast(groups) if small else groups

    share = _SHARE.format(scale=SCALE, count="coalesce(counts[s.source], 0)", n="s.n")
    wide = kept.join(per_lang, "lang").select("lang", "term", "v", "n", "n_lang", "counts", "sources", F.expr(f"transform(sources, s -> {share})").alias("p"))

    # What the pair (i, j), i < j, gets stands at place j * (j - 1) / 2 + i.
    gap = _GAP.format(p="x", q="p[j]")
    emitted = wide.where(F.size("p") > 1).select("lang", F.posexplode(F.expr(f"flatten(transform(sequence(1, size(p) - 1), j -> transform(slice(p, 1, j), x -> {gap})))")).alias("place", "gap"))
    sums = emitted.groupBy("lang", "place").agg(F.sum("gap").alias("value"))
    pairs = groups.where(F.size("sources") > 1).select("lang", F.expr("inline(flatten(transform(sequence(1, size(sources) - 1), j -> transform(sequence(0, j - 1), i -> struct(j * (j - 1) div 2 + i AS place, sources[i].source AS one, sources[j].source AS two)))))"))
    valued = pairs.join(sums, ["lang", "place"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    both = valued.select("lang", F.expr("inline(array(struct(one AS source, two AS item), struct(two AS source, one AS item)))"), "value")
    nearest = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))

    of_lang = _SHARE.format(scale=SCALE, count="n", n="n_lang")
    own = wide.withColumn("q", F.expr(of_lang)).select("lang", "term", "q", F.expr("inline(filter(transform(sources, (s, i) -> struct(s.source AS source, p[i] AS p)), x -> x.p > q AND map_contains_key(counts, x.source)))"))
    marks = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_GAP.format(p="p", q="q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    return nearest.unionByName(marks.select(nearest.columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: for each source of a language the others by distance, and the ten terms that mark it."""
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM docs),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}),
sizes AS (
  SELECT g.lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) k USING (lang)),
here AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN here USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(h.n, 0) AS n,
    1 + CAST({SCALE} AS HUGEINT) * (coalesce(h.n, 0) + 2) // (CAST(t.n AS HUGEINT) + 2 * s.v) AS p,
    1 + CAST({SCALE} AS HUGEINT) * (k.n + 2) // (CAST(s.n AS HUGEINT) + 2 * s.v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN here h ON h.lang = t.lang AND h.source = t.source AND h.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
