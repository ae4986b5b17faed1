"""Indexes and reads raw objects as they arrive in a folder.

Structured Streaming's file source tracks which objects are new (names and sizes only: contents are not read by it); each micro-batch indexes its objects
and hands their records to the given function.  A batch that runs again finds its indexes built and gives the same records.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import api


def arrivals(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """(path, length, modificationTime) of new objects."""
    d = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    return d.select("path", "length", "modificationTime")


def ingest(spark: SparkSession, fmt: str, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*", per_trigger: int = 100, index: dict[str, Any] | None = None, available_now: bool = True, **plan: Any) -> StreamingQuery:
    """sink(records with their _object, batch number) for each micro-batch; the source bounds the number of objects in a new one by per_trigger; one that was logged before a restart keeps its objects."""

    def work(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]
        frames = []
        for p in paths:
            if api.format_of(fmt).needs_index:
                api.build_index(batch.sparkSession, fmt, p, **(index or {}))
            frames.append(api.read(batch.sparkSession, fmt, p, **plan).withColumn("_object", F.lit(p)))
        if frames:
            sink(reduce(DataFrame.unionByName, frames), number)

    writer = arrivals(spark, folder, glob, per_trigger).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
