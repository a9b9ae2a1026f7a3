"""Ranks and running sums over a whole table, without one task for all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.plans.scratch import materialize


def running(df: DataFrame, order: Sequence[str], size: str) -> DataFrame:
    """df with rank (from 1), upto (the sum of size up to and with the row), n and total, in the order of some columns.

    The columns of order have to tell rows apart. Rows are dealt to ranges of that order and ranked within
    their range; the ranges' counts and sums, a row for each partition, give the offsets.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    per_range = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(size).alias("_sum"))
    before, every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_range.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_upto"),
        F.sum("_n").over(every).alias("n"),
        F.sum("_sum").over(every).alias("total"),
    )
    here = Window.partitionBy("_range").orderBy(*order)
    out = ranged.withColumns({"rank": F.row_number().over(here), "upto": F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.join(F.broadcast(offsets), "_range")
    return out.withColumns({"rank": (F.col("rank") + F.col("_rank")).cast("long"), "upto": F.col("upto") + F.col("_upto")}).drop("_range", "_rank", "_upto")
