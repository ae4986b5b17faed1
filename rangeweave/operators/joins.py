"""As-of and interval joins, and global row numbers.

Spark has neither join natively; a plain range condition becomes a nested-loop join.  Both compose equi-joins, windows and aggregations instead, so
that they partition by key, and split or pre-aggregate skewed keys like any other join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def met(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Every row with what has the same keys in `found`; null keys are the same."""
    there = found.withColumnsRenamed({c: f"_on_{i}" for i, c in enumerate(on)})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(on)]
    return rows.join(there, same, "left").drop(*(f"_on_{i}" for i in range(len(on))))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, suffix: str = "_right", buckets: float | None = None) -> DataFrame:
    """Each left row with the last right row of the same keys at or before it (nulls without one), compared in the columns' own type.  Of right rows at one place the greatest in the
    order of their columns counts (so no column may be a map).

    One sort over the union of both sides within each key carries the last right row forward.  Without keys, or with a key that holds much of the data, give
    `buckets`, a width in units of the ordering column: rows are cut into buckets of that width, each a partition of its own, and what a bucket inherits from
    earlier ones comes from a window over one row for each bucket and key.
    """
    by = by or []
    taken = set(left.columns)
    names = {c: f"{c}{suffix}" if c in taken else c for c in right.columns if c not in by}
    payload = F.struct(*(F.col(c).alias(n) for c, n in names.items()))
    keep = F.struct(*(F.col(c) for c in left.columns))
    a = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), keep.alias("_left"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"))
    b = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), payload.alias("_right"))
    both = a.unionByName(b)
    order = [F.col("_at"), F.col("_side"), F.col("_right")]
    if buckets is None:
        w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
        found = F.last("_right", ignorenulls=True).over(w)
        return both.withColumn("_found", found).where("_side = 1").select("_left.*", *(F.col(f"_found.{n}").alias(n) for n in names.values()))
    both = both.withColumn("_bucket", F.floor(F.col("_at").cast("double") / buckets))
    last = both.where("_side = 0").groupBy(*by, "_bucket").agg(F.max(F.struct("_at", "_right"))["_right"].alias("_carry"))
    every = met(both.select(*by, "_bucket").distinct(), last, [*by, "_bucket"])
    w = (Window.partitionBy(*by) if by else Window).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_before", F.last("_carry", ignorenulls=True).over(w)).drop("_carry")
    w = Window.partitionBy(*by, "_bucket").orderBy(*order)
    found = F.coalesce(F.last("_right", ignorenulls=True).over(w), F.col("_before"))
    return met(both, carried, [*by, "_bucket"]).withColumn("_found", found).where("_side = 1").select("_left.*", *(F.col(f"_found.{n}").alias(n) for n in names.values()))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: float, closed: bool = False) -> DataFrame:
    """Pairs with start <= point < end (closed: <= end).  Intervals spread over the cells of `width` that they meet, points fall into one; the cell is the equi-join key."""
    cell = lambda c: F.floor(c / F.lit(width))
    spread = intervals.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end) if closed else F.col(point) < F.col(end))
    return points.withColumn("_cell", cell(F.col(point))).join(spread, "_cell").where(inside).drop("_cell")


def numbered(frame: DataFrame, order: str | Column, name: str = "row_no", start: int = 0, buckets: int = 200) -> DataFrame:
    """Global row numbers in an order without sorting all rows in one task: ranges of the order, their counts summed over ranges, and a count within each."""
    order = F.col(order) if isinstance(order, str) else order
    dealt = frame.withColumn("_order", order).repartitionByRange(buckets, "_order").withColumn("_part", F.spark_partition_id())
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within") - 1 + start).drop("_order", "_part", "_within", "_before")
