"""Comparison of sets and of graphs between a training and a test side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_sets(training: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """One row: shared, additional (test only), absent (training only), test_coverage, training_coverage, jaccard.

    Coverages and Jaccard are 1 where there is nothing to cover.
    """
    a, b = training.select(keys).distinct().withColumn("_a", F.lit(1)), test.select(keys).distinct().withColumn("_b", F.lit(1))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = a.alias("l").join(b.alias("r"), on, "full_outer")
    out = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count_if(F.col("_a").isNull()).alias("additional"), F.count_if(F.col("_b").isNull()).alias("absent"))
    share = lambda of: F.when(of == 0, F.lit(1.0)).otherwise(F.col("shared") / of)
    s, more, less = F.col("shared"), F.col("additional"), F.col("absent")
    return out.select("*", share(s + more).alias("test_coverage"), share(s + less).alias("training_coverage"), share(s + more + less).alias("jaccard"))


def set_members(training: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``side``: shared, additional (test only) or absent (training only)."""
    a, b = training.select(keys).distinct().withColumn("_a", F.lit(1)), test.select(keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_a").isNull(), "additional").when(F.col("_b").isNull(), "absent").otherwise("shared").alias("side"))


#: A graph as a table of its elements: kind of node or edge, name, and how often it is there.
ELEMENT = ["kind", "element"]


def _named(df: DataFrame, kind: str | Column, names: list[str], weight: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(kind.alias("kind"), F.concat_ws(" | ", *names).alias("element"), F.col(weight).cast("long").alias("measure"))


def flow_elements(relations: DataFrame, ocdfg: DataFrame) -> DataFrame:
    """Elements of an object-centric directly-follows graph: activities by events, and flows by couples of events,
    those of all object types merged."""
    activities = relations.select("eid", "activity").distinct().groupBy("activity").agg(F.count("*").alias("n"))
    flows = ocdfg.groupBy("src_act", "dst_act").agg(F.sum("event_couples").alias("n"))
    return _named(activities, "activity", ["activity"], "n").unionByName(_named(flows, "flow", ["src_act", "dst_act"], "n"))


def type_elements(relations: DataFrame, otg: DataFrame) -> DataFrame:
    """Elements of an object-type graph: types by objects, and pairs of types by relationship, a kind for each of those."""
    types = relations.select("otype", "oid").distinct().groupBy("otype").agg(F.count("*").alias("n"))
    return _named(types, "type", ["otype"], "n").unionByName(_named(otg, F.col("relationship"), ["otype1", "otype2"], "weight"))


def relation_elements(relations: DataFrame, etot: DataFrame) -> DataFrame:
    """Elements of an activity-type graph: activities by events, types by objects, and relations of both."""
    activities = relations.select("eid", "activity").distinct().groupBy("activity").agg(F.count("*").alias("n"))
    types = relations.select("otype", "oid").distinct().groupBy("otype").agg(F.count("*").alias("n"))
    out = _named(activities, "activity", ["activity"], "n").unionByName(_named(types, "type", ["otype"], "n"))
    return out.unionByName(_named(etot, "relation", ["activity", "otype"], "weight"))


def counted_elements(counts: DataFrame, ocdfg: DataFrame, otg: DataFrame) -> list[DataFrame]:
    """flow_elements(), type_elements() and relation_elements() from OrderTally.counts() for the relations."""
    activities = _named(counts.where("otype is null"), "activity", ["activity"], "n")
    types = _named(counts.where("activity is null"), "type", ["otype"], "n")
    flows = _named(ocdfg.groupBy("src_act", "dst_act").agg(F.sum("event_couples").alias("n")), "flow", ["src_act", "dst_act"], "n")
    between = _named(otg, F.col("relationship"), ["otype1", "otype2"], "weight")
    both = _named(counts.where("activity is not null and otype is not null"), "relation", ["activity", "otype"], "n")
    return [activities.unionByName(flows), types.unionByName(between), activities.unionByName(types).unionByName(both)]


def _shares(graph: DataFrame, name: str) -> DataFrame:
    every = Window.partitionBy("kind")
    return graph.select(*ELEMENT, (F.col("measure") / F.sum("measure").over(every)).alias(name))


def diagnose(normative: DataFrame, real: DataFrame, theta: float | None = 0.1, thetas: Mapping[str, float | None] | None = None) -> DataFrame:
    """ELEMENT with normative_share, real_share, delta and verdict, for every element of either graph.

    Shares are of the measures of a kind in a graph, as logs differ in size; delta is their difference
    relative to the larger one. verdict: missing (the real graph has it not), additional (only the real
    one has it), non_conforming (delta over its kind's theta) or conforming. thetas gives kinds a theta of
    their own; None compares structure alone.
    """
    both = _shares(normative, "normative_share").join(_shares(real, "real_share"), ELEMENT, "full_outer")
    delta = F.abs(F.col("normative_share") - F.col("real_share")) / F.greatest("normative_share", "real_share")
    limit = F.lit(theta).cast("double")
    for kind, t in (thetas or {}).items():
        limit = F.when(F.col("kind") == kind, F.lit(t).cast("double")).otherwise(limit)
    verdict = F.when(F.col("real_share").isNull(), "missing").when(F.col("normative_share").isNull(), "additional").when(F.col("delta") > limit, "non_conforming").otherwise("conforming")
    return both.withColumn("delta", delta).withColumn("verdict", verdict)


def fitness(diagnosed: DataFrame, *by: str) -> DataFrame:
    """elements (of the normative graph), missing, non_conforming, additional and fitness, one row, or one for each of ``by``.

    fitness = 1 - (missing + non_conforming) / elements, 1 for a graph without elements. This definition
    is our own.
    """
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    out = diagnosed.groupBy(*by).agg(F.count_if(F.col("verdict") != "additional").alias("elements"), count("missing"), count("non_conforming"), count("additional"))
    return out.withColumn("fitness", F.when(F.col("elements") == 0, F.lit(1.0)).otherwise(1 - (F.col("missing") + F.col("non_conforming")) / F.col("elements")))


def frequency_deviations(normative: DataFrame, real: DataFrame, over: float = 0.10) -> DataFrame:
    """ELEMENT, both shares and delta of the elements of both graphs whose delta is over a bound."""
    return diagnose(normative, real, None).where(F.col("delta") > over).drop("verdict")


def absent_elements(training: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Elements of the training side that the test side has not, with all their measures."""
    return training.join(test.select(keys).distinct(), keys, "left_anti")
