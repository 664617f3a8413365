"""Quality classifier: regularised quadratic discriminant analysis on transformed document statistics.

Each class has its own mean and its own covariance, shrunk towards the pooled covariance and then towards a
multiple of the identity. A document's score comes from the difference of the two Mahalanobis log densities,
computed with Cholesky factors that are factored once on the driver and kept with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import free_names, ready, staged, table, tidy
from loomstone.llm.textstats import COUNTS, count_texts, with_counts

FEATURES = ["log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "same_next_share"]
#: Words or letters of ordinary text that are added to each text.
PRIOR = 20.0
#: Shrinkage: towards the pooled covariance, and towards the identity times the mean variance.
TO_POOLED, TO_IDENTITY = 0.2, 0.02
#: The log-density difference at which a score has gone half way from 0.5 to 1.
SCALE = 10.0


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, a row a text. Each is of the counts plus PRIOR words or letters of ordinary text, so that short texts are near the middle and empty ones finite."""
    f = {k: v.astype(float) for k, v in c.items()}
    words, symbols = f["n_words"], f["word_chars"]

    def share(part: np.ndarray, whole: np.ndarray, usual: float) -> np.ndarray:
        return np.log((part + PRIOR * usual) / (whole - np.minimum(part, whole) + PRIOR))

    return np.stack([
        np.log1p(words),
        np.log((symbols + 5 * PRIOR) / (words + PRIOR)),
        share(f["n_symbols"], symbols, 0.01),
        share(f["n_upper"], f["n_upper"] + f["n_lower"], 0.03),
        share(f["n_digits"], symbols, 0.01),
        share(f["n_marks"], symbols, 0.01),
        share(f["n_same_next"], words, 0.01),
    ], axis=1)


@dataclass
class Discriminant:
    """A fitted model: the standardisation, and of each class its mean, inverse Cholesky factor and log constant."""

    centre: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
        """moments: of class 0 and 1 the row count, the sums and the sums of products. A class without rows gets the moments of all."""
        p = len(FEATURES)
        n = sum(m[0] for m in moments.values())
        if not n:
            return cls(np.zeros(p), np.ones(p), [np.zeros(p)] * 2, [np.eye(p)] * 2, [0.0, 0.0])
        centre = sum(m[1] for m in moments.values()) / n
        every = sum(m[2] for m in moments.values()) / n - np.outer(centre, centre)
        spread = np.sqrt(np.maximum(np.diag(every), 1e-6))
        own = {}
        for k in (0, 1):
            rows, s, ss = moments.get(k, (0, None, None))
            rows, s, ss = (rows, s, ss) if rows else (n, sum(m[1] for m in moments.values()), sum(m[2] for m in moments.values()))
            mean = s / rows
            own[k] = rows, (mean - centre) / spread, (ss / rows - np.outer(mean, mean)) / np.outer(spread, spread)
        pooled = sum(own[k][0] * own[k][2] for k in own) / sum(own[k][0] for k in own)
        means, factors, constants = [], [], []
        for k in (0, 1):
            rows, mean, cov = own[k]
            lean = to_pooled + (1 - to_pooled) * p / (p + rows)  # few rows: nearly all from the pooled covariance
            cov = (1 - lean) * cov + lean * pooled
            cov = (1 - to_identity) * cov + to_identity * np.eye(p) * max(np.trace(cov) / p, 1e-3)
            lower = np.linalg.cholesky(cov)
            means.append(mean)
            factors.append(np.linalg.inv(lower))
            constants.append(-float(np.log(np.diag(lower)).sum()) + float(np.log((rows + 1) / (n + 2))))
        return cls(centre, spread, means, factors, constants)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        density = [self.constants[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return density[1] - density[0]


def score_of(log_odds: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """0 to 1, 0.5 at even odds; never saturates, so documents keep their order."""
    return 0.5 + 0.5 * log_odds / (scale + np.abs(log_odds))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products by class, over all rows of (label, COUNTS): one row a task and class reaches Spark's sum, two the driver."""
    p = len(FEATURES)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False)
            x = features({c: b.column(i + 1).to_numpy(zero_copy_only=False) for i, c in enumerate(COUNTS)})
            for k in (0, 1):
                mine = x[label == k]
                total[k] += np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "m"])

    parts = labelled.select("label", *COUNTS).mapInArrow(kernel, "label int, m array<double>")
    summed = parts.select("label", F.posexplode("m").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"))
    flat = {0: np.zeros(1 + p + p * p), 1: np.zeros(1 + p + p * p)}
    for r in summed.collect():  # 2 x (1 + p + p * p) numbers
        flat[r["label"]][r["i"]] = r["v"]
    return {k: (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for k, v in flat.items()}


def fit_quality(counts: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from counts (doc_id, held_out, COUNTS) and labels (doc_id, quality); held-out rows are never read for learning.

    All other labelled rows count: the model needs only sums, so there is no sample. Null and other labels than 0 and 1 are left out.
    """
    known = labels.where(F.col("quality").isin(0, 1)).where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    return Discriminant.fit(class_moments(counts.where(~F.col("held_out")).join(known, "doc_id")))


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, `keep`, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts are scored like any text, with all counts 0. Repeated rows score alike. A null doc_id is not
    held out and never joins a label. Without any label every score is 0.5. An empty table gives an empty table.
    Repeated labels count as often as they are there, and a document with both labels counts for both classes. Other
    columns may have any name; one in `keep` that is named like a column made here is a ValueError.
    """
    free_names(keep, "doc_id", "held_out", "score", "predicted", "label", *COUNTS)
    ready(docs.sparkSession)
    counts = staged(with_counts(docs, ["doc_id", *keep]).withColumn("held_out", held_out(F.col("doc_id"))), "counts")
    model = fit_quality(counts, labels)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select("doc_id", *keep, "held_out").schema] + ["score double", "predicted int"])
    first = 2 + len(keep)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features({c: b.column(first + i).to_numpy(zero_copy_only=False) for i, c in enumerate(COUNTS)})
            score = score_of(model.log_odds(x))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(first)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", *keep, "held_out", "score", "predicted"])

    return counts.select("doc_id", *keep, "held_out", *COUNTS).mapInArrow(kernel, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier predicts to be good, with all their columns.

    Learns as score_quality does. Texts are read a second time instead of being shuffled, so each row is judged by its
    own text whatever its doc_id.
    """
    ready(docs.sparkSession)
    model = fit_quality(with_counts(docs, ["doc_id"]).withColumn("held_out", held_out(F.col("doc_id"))), labels)
    text = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = score_of(model.log_odds(features(count_texts(b.column(text))))) >= 0.5
            yield b.filter(pa.array(good))

    return docs.mapInArrow(tidy(kernel), docs.schema)


def op5_quality_classifier(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
