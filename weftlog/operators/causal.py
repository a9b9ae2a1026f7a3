"""Candidate precedence relations: scores of directly-follows flows and thresholds on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.schema import normal_types, require_columns, require_threshold

#: Default thresholds (fixed values).
DEPENDENCY, SUPPORT, SELF_LOOP = 0.90, 0.05, 0.90
#: Default sensitivity grid (fixed values).
GRID = ((0.80, 0.85, 0.90, 0.95), (0.01, 0.05, 0.10), (0.80, 0.90))

RELATION = ["otype", "src_act", "dst_act"]


def score(ocdfg: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """RELATION with forward, backward, dependency, relative_support and self_loop_score.

    The frequency of a flow is its number of event couples. A self relation has dependency 0 and a
    self-loop score; the others have none. Support is relative to the most frequent flow out of
    the same source, self relations included.
    """
    require_columns(ocdfg, [*RELATION, "event_couples"], "ocdfg")
    if types is not None:
        wanted = normal_types(types)
        there = {r["otype"] for r in ocdfg.where(F.col("otype").isin(*wanted)).select("otype").distinct().collect()}
        if missing := sorted(set(wanted) - there):
            raise ValueError(f"unknown object types: {', '.join(missing)}")
        ocdfg = ocdfg.where(F.col("otype").isin(*wanted))
    f = ocdfg.select(*RELATION, F.col("event_couples").cast("long").alias("forward"))
    own = F.col("src_act") == F.col("dst_act")
    # a pair of activities has two flows at most, one each way
    pair = Window.partitionBy("otype", F.least("src_act", "dst_act"), F.greatest("src_act", "dst_act"))
    both = f.withColumn("backward", F.when(own, 0).otherwise(F.sum("forward").over(pair) - F.col("forward")).cast("long"))
    most = F.max("forward").over(Window.partitionBy("otype", "src_act"))
    return both.select(
        *RELATION,
        "forward",
        "backward",
        F.when(own, 0.0).otherwise((F.col("forward") - F.col("backward")) / (F.col("forward") + F.col("backward") + 1)).alias("dependency"),
        F.when(most == 0, 0.0).otherwise(F.col("forward") / most).alias("relative_support"),
        F.when(own, F.col("forward") / (F.col("forward") + 1)).alias("self_loop_score"),
    )


def _accepted(dependency: Column, support: Column, self_loop: Column) -> Column:
    own = F.col("src_act") == F.col("dst_act")
    return F.when(own, F.col("self_loop_score") >= self_loop).otherwise(F.col("dependency") >= dependency) & (F.col("relative_support") >= support)


def derive(evidence: DataFrame, dependency: float = DEPENDENCY, support: float = SUPPORT, self_loop: float = SELF_LOOP) -> DataFrame:
    """RELATION of the flows at or above the thresholds."""
    t = [F.lit(require_threshold(x, n)) for x, n in ((dependency, "dependency"), (support, "support"), (self_loop, "self_loop"))]
    return evidence.where(_accepted(*t)).select(RELATION)


#: Grid of the exploratory sensitivity (fixed values).
TOPOLOGY_GRID = ((0.80, 0.85, 0.90, 0.95, 0.97, 0.98), (0.01, 0.05, 0.10, 0.20))


def topology_sensitivity(evidence: DataFrame, activities: DataFrame, expected: DataFrame, grid: Sequence[Sequence[float]] = TOPOLOGY_GRID) -> DataFrame:
    """For each dependency and support threshold: edges, missing, additional and exact of the accepted flows as pairs
    of activities, both of them among ``activities`` (activity), against ``expected`` (src_act, dst_act).

    Object types are merged, and self relations, whose dependency is 0, pass no threshold over 0.
    """
    spark = evidence.sparkSession
    rows = [(require_threshold(d), require_threshold(s)) for d in grid[0] for s in grid[1]]
    table = spark.createDataFrame(rows, "dependency_threshold double, support_threshold double")
    known = activities.select("activity").distinct()
    e = evidence.join(known.withColumnRenamed("activity", "src_act"), "src_act", "left_semi").join(known.withColumnRenamed("activity", "dst_act"), "dst_act", "left_semi")
    hit = table.join(e, (F.col("dependency") >= F.col("dependency_threshold")) & (F.col("relative_support") >= F.col("support_threshold"))).select(*table.columns, "src_act", "dst_act", F.lit(True).alias("found")).distinct()
    want = table.join(expected.select("src_act", "dst_act").distinct(), F.lit(True)).withColumn("wanted", F.lit(True))
    key = [*table.columns, "src_act", "dst_act"]
    both = hit.join(want, key, "full_outer").groupBy(*table.columns).agg(F.count("found").alias("edges"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("additional"))
    out = table.join(both, table.columns, "left").na.fill(0, ["edges", "missing", "additional"])
    return out.withColumn("exact", (F.col("missing") == 0) & (F.col("additional") == 0))


def sensitivity(evidence: DataFrame, grid: Sequence[Sequence[float]] = GRID, default: tuple[float, float, float] = (DEPENDENCY, SUPPORT, SELF_LOOP)) -> DataFrame:
    """For each combination of thresholds how many relations it accepts, and how many it lacks or adds against the default.

    The evidence is scanned once: it meets the grid, a table of a few rows, in one query.
    """
    spark = evidence.sparkSession
    rows = [(require_threshold(d), require_threshold(s), require_threshold(o)) for d in grid[0] for s in grid[1] for o in grid[2]]
    table = spark.createDataFrame(rows, "dependency_threshold double, support_threshold double, self_loop_threshold double")
    e = evidence.withColumn("in_default", _accepted(*map(F.lit, default)))
    hit = _accepted(F.col("dependency_threshold"), F.col("support_threshold"), F.col("self_loop_threshold"))
    counted = table.join(e, F.lit(True), "left").groupBy(*table.columns).agg(
        F.count_if(hit).alias("relations"), F.count_if(F.col("in_default") & ~hit).alias("missing"), F.count_if(~F.col("in_default") & hit).alias("additional")
    )
    return counted.withColumn("stable", (F.col("missing") == 0) & (F.col("additional") == 0))
