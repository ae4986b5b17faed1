"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: Rows and bytes of one Arrow batch sent to Python; documents may be long.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20


@contextmanager
def settings(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """For the jobs that run inside: Arrow batches of bounded rows and bytes, and shuffle files that go as soon as their query has ended (while it runs, lost ones are made again as ever).  The session's own settings come back."""
    own = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _place(t: DataFrame, below: str = ""):
    sc = t.sparkSession.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(t._written_to + below)
    return jpath, jpath.getFileSystem(sc._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, rows: int = ARROW_ROWS, by: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder (in a folder for each value of column `by`) and reads it back: cuts the lineage, survives lost executors, and is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with settings(spark, rows):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    jpath, fs = _place(out)
    fs.deleteOnExit(jpath)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read any more: whatever was made of them has been materialized itself."""
    for t in tables:
        jpath, fs = _place(t)
        fs.delete(jpath, True)


def release_part(t: DataFrame, by: str, value: int) -> None:
    """Deletes the rows of one value of the column that a materialized table was written by."""
    jpath, fs = _place(t, f"/{by}={value}")
    fs.delete(jpath, True)


def give_back() -> None:
    """Hands memory that this process has freed back to the system.  Python workers live on from task to task, beside a JVM whose heap is full; what a task of one operator held would otherwise stay theirs while the next ones run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives its memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, for maps whose result is handed on unwritten and so run under the caller's settings."""
    for b in batches:
        for a in range(0, max(1, b.num_rows), rows):
            yield b.slice(a, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_ids(labels: DataFrame, column: str, bound: int, folds: int = 5) -> DataFrame:
    """(label_id, label) to learn from: rows outside fold 0 whose id and label are not null, at most `bound`, in the order of a hash of the id; where an id is repeated, its largest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    one = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("label_id"), "label_id").limit(bound)


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of docs has it (whatever the case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
