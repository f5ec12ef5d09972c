"""Dense numbers for distinct keys, given out by ranges instead of in one sorted task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginlens.functions.staged import stage


def numbered(df: DataFrame, keys: list[str], number: str, ranges: int | None = None) -> DataFrame:
    """The distinct ``keys`` of ``df`` that are not all NULL, with their 1-based place in sort order as INT column ``number``.

    Keys are dealt out by range, each range is numbered by itself and moved on by the sizes of the ranges before it, of which
    there is one row per range. Ranges and numbers are written down, so every reader and a repeated task see the same ones.
    """
    distinct = df.select(*keys).filter(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()).distinct()
    dealt = distinct.repartitionByRange(ranges, *keys) if ranges else distinct.repartitionByRange(*keys)
    placed = stage(dealt.withColumn("range_id", F.spark_partition_id()), f"{number}-ranges")
    sizes = placed.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    in_range = F.row_number().over(Window.partitionBy("range_id").orderBy(*keys))
    counted = placed.select("*", in_range.alias("n_in_range")).join(F.broadcast(offsets), "range_id")
    return stage(counted.select(*keys, (F.col("n_before") + F.col("n_in_range")).cast("int").alias(number)), number)
