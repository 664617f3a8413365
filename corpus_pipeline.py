"""From raw documents to a training mix: every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import staged, table
from loomstone.llm.decontamination import find_leaks
from loomstone.llm.ngram_join import one_of_each
from loomstone.llm.quality_classifier import keep_good
from loomstone.llm.repeat_removal import remove_repeats
from loomstone.llm.source_mix import mix_sources


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be bad go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the least doc_id stays."""
    return one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has go, with the rest of any character they cut; n_chars is counted anew. A document of nothing else goes."""
    out = remove_repeats(docs, keep=("lang", "source", "text"), whole_characters=True)
    out = out.where((F.size("spans") == 0) | (F.octet_length("kept") > 0))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    return out.withColumn("text", text).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    out = find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return out.where("n_hit = 0").select("doc_id", "text", "lang", "source", "n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, lang, source, size, source_size, target, copies, taken."""
    return mix_sources(docs, carry=("lang",)).select("doc_id", "lang", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality_classifier", quality),
    ("ngram_join", near_duplicates),
    ("repeat_removal", repeated_strings),
    ("decontamination", decontamination),
    ("source_mix", mixture),
]

#: The classifier's model and the transform can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
