from __future__ import annotations

import pytest

from weftlog.operators import causal, ocdfg

FLOWS = [
    ("items", "book", "saw", 800), ("items", "saw", "crate", 800), ("items", "crate", "saw", 8), ("items", "saw", "haul", 24),
    ("packages", "haul", "knock", 150), ("packages", "knock", "knock", 60), ("packages", "knock", "hand over", 150),
]


@pytest.fixture(scope="module")
def flows(spark):
    return spark.createDataFrame(FLOWS, "otype string, src_act string, dst_act string, event_couples long")


def _scores(flows):
    return {(r.otype, r.src_act, r.dst_act): r for r in causal.score(flows).collect()}


def test_scores(flows):
    s = _scores(flows)
    a = s["items", "saw", "crate"]
    assert (a.forward, a.backward, a.dependency, a.relative_support, a.self_loop_score) == (800, 8, 792 / 809, 1.0, None)
    assert s["items", "crate", "saw"].dependency == -792 / 809
    b = s["items", "saw", "haul"]
    assert (b.dependency, b.relative_support) == (24 / 25, 0.03)
    c = s["packages", "knock", "knock"]
    assert (c.forward, c.backward, c.dependency, c.self_loop_score, c.relative_support) == (60, 0, 0.0, 60 / 61, 60 / 150)


def test_accepted(flows):
    accepted = {tuple(r) for r in causal.derive(causal.score(flows)).collect()}
    assert {r for r in accepted if r[0] == "items"} == {("items", "book", "saw"), ("items", "saw", "crate")}
    assert ("packages", "knock", "knock") in accepted
    strict = {tuple(r) for r in causal.derive(causal.score(flows), self_loop=0.99).collect()}
    assert ("packages", "knock", "knock") not in strict


def test_topology_sensitivity(spark, flows):
    want = spark.createDataFrame([("book", "saw"), ("saw", "crate")], "src_act string, dst_act string")
    acts = spark.createDataFrame([(a,) for a in ("book", "saw", "crate", "haul")], "activity string")
    got = {(r.dependency_threshold, r.support_threshold): (r.edges, r.missing, r.additional, r.exact) for r in causal.topology_sensitivity(causal.score(flows), acts, want, ((0.9, 0.97, 0.99), (0.01, 0.05))).collect()}
    assert got == {(0.9, 0.01): (3, 0, 1, False), (0.9, 0.05): (2, 0, 0, True), (0.97, 0.01): (2, 0, 0, True), (0.97, 0.05): (2, 0, 0, True), (0.99, 0.01): (1, 1, 0, False), (0.99, 0.05): (1, 1, 0, False)}


@pytest.mark.parametrize("bad", [-0.01, 1.01])
@pytest.mark.parametrize("which", ["dependency", "support", "self_loop"])
def test_thresholds(flows, bad, which):
    with pytest.raises(ValueError):
        causal.derive(causal.score(flows), **{which: bad})


def test_unknown_type_and_missing_column(flows):
    with pytest.raises(ValueError, match="customers"):
        causal.score(flows, ["customers"])
    with pytest.raises(ValueError, match="event_couples"):
        causal.score(flows.drop("event_couples"))


def test_sensitivity(spark):
    one = spark.createDataFrame([("orders", "place", "pay", 20)], "otype string, src_act string, dst_act string, event_couples long")
    grid = causal.sensitivity(causal.score(one), ((0.80, 0.90), (0.05,), (0.90,)))
    assert sorted((r.dependency_threshold, r.relations, r.stable) for r in grid.collect()) == [(0.8, 1, True), (0.9, 1, True)]


def test_repeated_relations_do_not_follow_themselves(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([("e1", "o", "orders", "q1", "a", t), ("e1", "o", "orders", "q2", "a", t), ("e2", "o", "orders", "", "b", t)], "eid string, oid string, otype string, qualifier string, activity string, ts timestamp_ntz")
    assert [tuple(x) for x in ocdfg.discover(r).collect()] == [("orders", "a", "b", 1, 1, 1)]
