from __future__ import annotations

import __spark_entry__ as entry


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "causal_scores" in names


def test_entry(spark):
    out = entry.entry(spark)
    assert {"otype", "src_act", "dst_act", "dependency"} <= set(out.columns) and out.count() > 0
