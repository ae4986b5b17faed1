"""The closed-form planning rules as DataFrames: a plan of millions of slices is made by the executors, without a list on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def byte_chunks(spark: SparkSession, size: int, num_chunks: int, base: int = 0) -> DataFrame:
    """(slice_id, start, end) of exactly num_chunks ranges."""
    cs = -(-(size - base) // num_chunks)
    at = lambda i: F.least(F.lit(base) + F.lit(cs) * i, F.lit(size))
    return spark.range(num_chunks).select(F.col("id").alias("slice_id"), at(F.col("id")).alias("start"), at(F.col("id") + 1).alias("end"))


def line_chunk(line_no: Column, per_chunk: int, total: int, rest: str = "expand") -> Column:
    """The chunk of a 1-based line number."""
    chunk = F.floor((line_no - 1) / per_chunk).cast("long")
    if rest == "merge" and total % per_chunk:
        return F.least(chunk, F.lit(max(0, -(-total // per_chunk) - 2)))
    return chunk


def timestamp_blocks(spark: SparkSession, total_rows: int, rows_per_time: int, num_chunks: int) -> DataFrame:
    """(slice_id, row_0, row_1), inclusive."""
    times = total_rows // rows_per_time
    n = max(1, min(num_chunks, times))
    base, more = divmod(times, n)
    first = lambda i: F.lit(rows_per_time) * (i * base + F.least(i, F.lit(more)))
    i = F.col("id")
    return spark.range(n).select(i.alias("slice_id"), first(i).alias("row_0"), F.when(i == n - 1, F.lit(total_rows)).otherwise(first(i + 1)).alias("_e")).select("slice_id", "row_0", (F.col("_e") - 1).alias("row_1"))


def square_grid(spark: SparkSession, low: tuple[float, float], high: tuple[float, float], num_chunks: int) -> DataFrame:
    """(tile_x, tile_y, min_x, max_x, min_y, max_y) in x-major order."""
    from .rules import grid

    sx, sy = grid(num_chunks)
    wx, wy = (high[0] - low[0]) / sx, (high[1] - low[1]) / sy
    i, j = F.floor(F.col("id") / sy), F.col("id") % sy
    edge = lambda k, n, lo, w, hi: F.when(k == n, F.lit(hi)).otherwise(F.lit(lo) + F.lit(w) * k)
    return spark.range(sx * sy).select(i.cast("int").alias("tile_x"), j.cast("int").alias("tile_y"), edge(i, sx, low[0], wx, high[0]).alias("min_x"), edge(i + 1, sx, low[0], wx, high[0]).alias("max_x"), edge(j, sy, low[1], wy, high[1]).alias("min_y"), edge(j + 1, sy, low[1], wy, high[1]).alias("max_y"))
