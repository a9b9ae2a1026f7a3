"""Summaries of an object log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.schema import ObjectLog


def log_summary(log: ObjectLog) -> DataFrame:
    """One row: events, objects, relations, activities, object_types."""
    e = log.events.agg(F.count("*").alias("events"), F.count_distinct("activity").alias("activities"))
    o = log.objects.agg(F.count("*").alias("objects"), F.count_distinct("otype").alias("object_types"))
    r = log.relations.agg(F.count("*").alias("relations"))
    return e.join(o).join(r).select("events", "objects", "relations", "activities", "object_types")


def activity_counts(log: ObjectLog) -> DataFrame:
    return log.events.groupBy("activity").agg(F.count("*").alias("events"))


def object_type_counts(log: ObjectLog) -> DataFrame:
    return log.objects.groupBy("otype").agg(F.count("*").alias("objects"))


def _per_event(log: ObjectLog) -> DataFrame:
    objects = F.count("oid") if log.distinct else F.count_distinct("oid")
    return log.relations.groupBy("eid").agg(objects.alias("n_objects"), F.count_distinct("otype").alias("n_types"))


def _described(df: DataFrame, c: str) -> DataFrame:
    q = [F.percentile(c, F.lit(p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    x = F.col(c)
    return df.agg(F.count("*").alias("events"), F.round(F.avg(x), 9).alias("mean"), F.round(F.stddev_samp(x), 9).alias("std"), F.min(x).alias("least"), *q, F.max(x).alias("most"), F.count_if(x > 1).alias("with_several"))


def objects_per_event(log: ObjectLog) -> DataFrame:
    """count, mean, standard deviation, quartiles and extremes of distinct objects of an event."""
    return _described(_per_event(log), "n_objects")


def _described_counts(df: DataFrame, c: str, n: str) -> DataFrame:
    """_described() of rows that stand for n events each."""
    x, k = F.col(c), F.col(n)
    q = [F.percentile(c, F.lit(p), k).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    every = df.agg(F.coalesce(F.sum(k), F.lit(0)).alias("events"), F.sum(x * k).alias("s"), F.sum(x * x * k).alias("ss"), F.min(x).alias("least"), *q, F.max(x).alias("most"), F.coalesce(F.sum(F.when(x > 1, k)), F.lit(0)).alias("with_several"))
    # whole numbers, of which no digit is lost
    e, s, ss = (F.col(v).cast("decimal(19,0)") for v in ("events", "s", "ss"))
    std = F.sqrt(F.try_divide(F.try_divide((e * ss - s * s).cast("double"), F.col("events")), F.col("events") - 1))
    return every.select("events", F.round(F.try_divide(F.col("s").cast("double"), F.col("events")), 9).alias("mean"), F.round(std, 9).alias("std"), "least", "q25", "q50", "q75", "most", "with_several")


def types_per_event(log: ObjectLog) -> DataFrame:
    """The same of distinct object types of an event."""
    t = log.tally
    if t is not None and t.named and t.condition is None and t.types is None:
        return _described_counts(t.event_types(), "n_types", "n")
    return _described(_per_event(log), "n_types")


def activities_by_type(log: ObjectLog) -> DataFrame:
    return log.relations.select("otype", "activity").distinct()
