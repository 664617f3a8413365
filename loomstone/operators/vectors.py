"""Vector search on arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.graph import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and for zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def with_norm(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("norm", F.sqrt(dot(F.col(vector), F.col(vector))))


def similar_to(df: DataFrame, vector: str, target: list[float], n: int, tie: str, least: float = 0.0, where: Column | None = None) -> DataFrame:
    """The n nearest rows to one vector by cosine; the filter comes before the limit. Exact: one pass with a top-k heap per task."""
    t = F.array(*[F.lit(float(x)) for x in target])
    rows = df if where is None else df.where(where)
    scored = rows.withColumn("similarity", cosine(F.col(vector), t))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), tie).limit(n)


def choose_tables(similarity: float, recall: float, bits: int) -> int:
    """Hash tables with which a pair at this cosine meets with this probability, each of `bits` random hyperplanes."""
    meet = (1 - np.arccos(similarity) / np.pi) ** bits
    return ceil(log(1 - recall) / log(1 - meet))


#: A row of a hash table costs about as much as so many comparisons.
TABLE_ROW = 20


def choose_bits(rows: int, similarity: float, recall: float) -> int:
    """The bits of a bucket with the least work for each vector: a row a table, and comparisons with what shares its bucket by chance."""
    return min(range(4, 31), key=lambda bits: choose_tables(similarity, recall, bits) * (TABLE_ROW + rows / 2**bits))


def similar_pairs(df: DataFrame, key: str, vector: str, least: float, recall: float = 0.999, bits: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of the pairs at `least` or more, by random hyperplanes: vectors meet in buckets, met pairs are verified exactly.

    The bits of a bucket are those with the least work (choose_bits); the number of hash tables follows from the bits
    and the recall wanted at the threshold: at 0.85 and 0.999 some 60 tables for 10,000 rows and 700 for 10^8. Low
    thresholds need many more, and are not what this is for. Pairs come from equi-joins
    on buckets and carry ids alone; vectors are fetched once for each distinct pair.
    """
    first = df.select(vector).head()
    if first is None:
        return df.sparkSession.createDataFrame([], "a long, b long, similarity double")
    bits = bits or choose_bits(df.count(), least, recall)
    dim, tables = len(first[0]), choose_tables(least, recall, bits)
    planes = np.random.default_rng(7).normal(size=(tables, bits, dim))

    @F.pandas_udf("array<long>")
    def buckets(v: pd.Series) -> pd.Series:
        m = np.stack(v.map(np.asarray).to_numpy()).astype(float)
        bit = np.einsum("nd,tbd->ntb", m, planes) > 0
        return pd.Series(list((bit.astype(np.int64) << np.arange(bits)).sum(axis=2)))

    placed = df.select(key, F.posexplode(buckets(F.col(vector))).alias("_t", "_b"))
    met = placed.withColumnRenamed(key, "a").join(placed.withColumnRenamed(key, "b"), ["_t", "_b"]).where("a < b").select("a", "b").distinct()
    vectors = with_norm(df.select(key, vector), vector)
    left = vectors.select(F.col(key).alias("a"), F.col(vector).alias("va"), F.col("norm").alias("na"))
    right = vectors.select(F.col(key).alias("b"), F.col(vector).alias("vb"), F.col("norm").alias("nb"))
    both = met.join(left, "a").join(right, "b").where((F.col("na") > 0) & (F.col("nb") > 0))
    return both.withColumn("similarity", dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def similar_links(df: DataFrame, key: str, vector: str, least: float, strong: float, strip: int = 32768) -> DataFrame:
    """(key, class_id, links, strong, similarity): of each vector the least key with an equal one, how many others are at a cosine of `least` or more, how many of those over `strong`, and the greatest.

    Exact at every threshold. Equal vectors are one class and are compared once; classes are dealt into strips, and each
    pair of strips is a group that multiplies them, so a task holds two strips and sends a row a vector besides the pairs.
    The comparisons are quadratic in the classes. Null and zero vectors, and those with a null or NaN in them, link to
    nothing; vectors of different lengths don't link.
    """
    return links_and_pairs(df, key, vector, least, strong, strip).where("other is null").drop("other")


def links_and_pairs(df: DataFrame, key: str, vector: str, least: float, strong: float, strip: int = 32768) -> DataFrame:
    """(key, class_id, other, links, strong, similarity): the rows of similar_links, where other is null, and each pair of classes at `least` or more once: the lesser class_id as key and class_id, the greater as other, and their cosine.

    With the classes of their vectors the pairs are all links; those of copies are not written out. They leave a task by
    blocks of a product.
    """
    known = df.select(key, vector).where(F.col(vector).isNotNull())
    classes = known.groupBy(vector).agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("_size"))
    classes = cut(classes.withColumn("_norm", F.sqrt(dot(F.col(vector), F.col(vector)))).withColumn("_norm", F.when((F.col("_norm") > 0) & ~F.isnan("_norm"), F.col("_norm"))))
    strips = max(1, ceil(classes.count() / strip))
    placed = classes.where("_norm is not null").select("class_id", "_size", F.col(vector).alias("_v"), F.pmod(F.xxhash64("class_id"), F.lit(strips)).alias("_s"))
    dealt = placed.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))))
    dealt = dealt.select(F.size("_v").alias("_d"), F.least("_s", "_o").alias("_a"), F.greatest("_s", "_o").alias("_b"), "_s", "class_id", "_size", "_v")
    kind = classes.schema["class_id"].dataType.simpleString()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        at, ids = group["_s"].to_numpy(), group["class_id"].combine_chunks()
        v = group["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
        size, one = group["_size"].to_numpy().astype(np.float64), group["_a"][0] == group["_b"][0]
        left = np.flatnonzero(at == group["_a"][0].as_py())
        right = left if one else np.flatnonzero(at == group["_b"][0].as_py())
        links, close, best = np.zeros(len(at)), np.zeros(len(at)), np.full(len(at), -2.0)
        for i in range(0, len(left), 1024):
            for j in range(0, len(right), 4096):
                x, y = left[i : i + 1024], right[j : j + 4096]
                c = v[x] @ v[y].T
                if one:
                    c[x[:, None] == y[None, :]] = -2.0
                for most, total in ((least, links), (strong, close)):
                    hit = (c > most if most == strong else c >= most).astype(np.float64)
                    total[x] += hit @ size[y]
                    if not one:
                        total[y] += size[x] @ hit
                best[x] = np.maximum(best[x], c.max(axis=1))
                if not one:
                    best[y] = np.maximum(best[y], c.max(axis=0))
                p, q = np.nonzero((c >= least) & (x[:, None] < y[None, :]) if one else c >= least)
                none = pa.nulls(len(p), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[p])), ids.take(pa.array(y[q])), none, none, pa.array(c[p, q])], names)
        got = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(got)), pa.nulls(len(got), ids.type), pa.array(links[got].astype(np.int64)), pa.array(close[got].astype(np.int64)), pa.array(best[got])], names)

    names = ["class_id", "other", "links", "strong", "similarity"]
    sent = cut(dealt.groupBy("_d", "_a", "_b").applyInArrow(multiply, f"class_id {kind}, other {kind}, links long, strong long, similarity double"))
    found = sent.where("other is null").groupBy("class_id").agg(F.sum("links").alias("_l"), F.sum("strong").alias("_c"), F.max("similarity").alias("_m"))
    others = F.when(F.col("_norm").isNotNull(), F.col("_size") - 1).otherwise(0)
    best = F.when(others > 0, 1.0).otherwise(F.col("_m"))
    per = classes.join(found, "class_id", "left").select(vector, "class_id", (others + F.coalesce("_l", F.lit(0))).alias("links"), (others + F.coalesce("_c", F.lit(0))).alias("strong"), best.alias("similarity"))
    out = df.select(key, vector).join(per, vector, "left")
    out = out.select(key, F.coalesce("class_id", key).alias("class_id"), F.lit(None).cast(kind).alias("other"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("strong", F.lit(0)).alias("strong"), "similarity")
    low = F.least("class_id", "other")
    pairs = sent.where("other is not null").select(low.alias(key), low.alias("class_id"), F.greatest("class_id", "other").alias("other"), "links", "strong", "similarity")
    return out.unionByName(pairs)
