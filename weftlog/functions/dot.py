"""DOT text of instance graphs, as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(exec_id, dot): left to right, a box for each event with id and activity, edges labelled with their object types."""
    label = F.concat(F.col("eid"), F.lit("\n"), F.col("activity"))
    n = nodes.select("exec_id", F.concat(F.lit("  "), _quoted(F.col("eid")), F.lit(" [label="), F.replace(_quoted(label), F.lit("\n"), F.lit("\\n")), F.lit("];")).alias("line"))
    e = edges.select("exec_id", F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" [label="), _quoted(F.array_join("object_types", ", ")), F.lit("];")).alias("line"))
    lines = lambda df, name: df.groupBy("exec_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias(name))
    both = lines(n, "n").join(lines(e, "e"), "exec_id", "left")
    head = F.lit("digraph {\n  rankdir=LR;\n  node [shape=box];")
    return both.select("exec_id", F.concat_ws("\n", head, "n", "e", F.lit("}")).alias("dot"))
