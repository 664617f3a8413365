"""What the training-data operators share: tables, the shared scratch folder, Python code for executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch. Kernels hold one batch at a time, so these bound a worker's memory.
ARROW_ROWS, ARROW_BYTES = 2048, 4 << 20

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application and bound the Arrow batches."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(), "loomstone.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or with a local master one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomstone-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomstone-{uuid.uuid4().hex[:12]}-{name}"


#: Spark's setting by which a finished query deletes its own shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors.

    Once the table is written nothing reads the shuffle files behind it, so they go at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(os.path.dirname(f))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(keep, *made: str) -> None:
    """Columns to keep must not be named like those that an operator makes."""
    if clash := sorted({k.lower() for k in keep} & {m.lower() for m in made}):
        raise ValueError(f"kept columns {clash} have names of the operator's own columns: rename them first")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(kernel):
    """A kernel that gives its memory back to the system when its task ends: a Python worker serves many tasks of many stages."""

    def run(batches):
        yield from kernel(batches)
        release_memory()

    return run


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
