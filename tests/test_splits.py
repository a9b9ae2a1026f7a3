from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftlog.operators import components, graphs, split
from weftlog.plans.ordered import running
from weftlog.sources.ocel import object_log

#: Cases that share events: p, q and r in a chain, u and v, and w alone; event, cases, activity, day of May.
SHARED = [("e1", "p", "open", 1), ("e2", "pq", "mix", 2), ("e3", "qr", "bake", 3), ("e4", "r", "sell", 9), ("e5", "uv", "open", 4), ("e6", "v", "toss", 5), ("e7", "w", "open", 6), ("e8", "w", "sell", 7)]


@pytest.fixture(scope="module")
def flat(spark):
    return spark.createDataFrame([(e, c, a, dt.datetime(2031, 5, d)) for e, cases, a, d in SHARED for c in cases], "eid string, case_id string, activity string, ts timestamp_ntz")


def test_shared_events_stay_together(flat):
    assert rows(split.case_components(flat)) == [("p", "p"), ("q", "p"), ("r", "p"), ("u", "u"), ("v", "u"), ("w", "w")]
    s = split.split_flat(flat, 0.5)  # 3, 5 and 6 of 6 cases: the first cut is nearest to 3
    assert rows(s.training.select("case_id").distinct()) == [("p",), ("q",), ("r",)]
    assert rows(s.test.select("case_id").distinct()) == [("u",), ("v",), ("w",)]
    n = split.split_summary(s).first()
    assert (n.training_components, n.test_components, n.training_cases, n.test_cases, n.effective_ratio) == (1, 2, 3, 3, 0.5)
    assert rows(split.unseen_variants(s.training, s.test)) == [(["open"], 1), (["open", "sell"], 1), (["open", "toss"], 1)]
    assert n.unseen_variants == 3
    s = split.split_flat(flat, 0.8)
    assert rows(s.parts.select("component", "rank", "upto", "n", "total", "is_training")) == [("p", 1, 3, 3, 6, True), ("u", 2, 5, 3, 6, True), ("w", 3, 6, 3, 6, False)]


def test_naive_leakage(flat):
    # by first day p, q, r, u, v, w: two cases leave q behind, which shares e2 with p and e3 with r
    assert tuple(split.naive_leakage(flat, 0.34).first()) == (1, 8)
    assert tuple(split.naive_leakage(flat, 0.5).first()) == (0, 8)
    assert tuple(split.naive_leakage(flat, 0.1).first()) == (0, 8)


@pytest.mark.parametrize("ratio", [-0.01, 0, 1, 1.01])
def test_ratio(flat, ratio):
    with pytest.raises(ValueError):
        split.split_flat(flat, ratio)


def test_bad_logs(flat):
    with pytest.raises(ValueError, match="case_id"):
        split.split_flat(flat.drop("case_id"))
    with pytest.raises(ValueError, match="two components"):
        split.split_flat(flat.where("case_id in ('u', 'v')"))


def _weeks(spark, n=3):
    """Each week an order with two items of its own; the third is a small one."""
    events = [(f"{a}{w}", dt.datetime(2031, 5, 1) + dt.timedelta(weeks=w, days=d), a) for w in range(n) for d, a in enumerate(("book", "saw", "haul")) if w < 2 or a == "book"]
    return object_log(spark, events, [(f"{a}{w}", f"{o}{w}", t) for w in range(n) for a in ("book", "saw", "haul") for o, t in (("o", "orders"), ("i", "items"), ("j", "items")) if (w < 2 or a == "book") and not (t == "orders" and a == "haul")])


def test_component_split(spark):
    s = split.split_log(_weeks(spark), [" orders", "items", "", "orders"], 0.5)  # 3, 6 and 7 of 7 events
    assert rows(s.training.events.select("eid")) == [("book0",), ("haul0",), ("saw0",)] and rows(s.test.events.select("eid")) == [("book1",), ("book2",), ("haul1",), ("saw1",)]
    assert (s.training.objects.count(), s.test.objects.count()) == (3, 6)
    with pytest.raises(ValueError, match="packages"):
        split.split_log(_weeks(spark), ["packages"])
    with pytest.raises(ValueError, match="two components"):
        split.split_log(_weeks(spark, 1), ["orders", "items"])


def brute_components(edges):
    groups = []
    for a, b in edges:
        mine = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in mine] + [{a, b}.union(*mine)]
    return sorted((x, min(g)) for g in groups for x in g)


@pytest.mark.parametrize("bound", [4, 500_000])
def test_components_shrink_inside_partitions(spark, monkeypatch, bound):
    """A hub, a chain, pairs and repeated edges over many partitions: fewer edges are dealt out, and small forests need no round."""
    monkeypatch.setattr(components, "FOREST", bound)
    chain = [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(300)]
    edges = chain + [("hub", f"s{k:03d}") for k in range(300)] + [(f"p{k}", f"q{k}") for k in range(20)] + [("é", "z"), ("Ω", "z"), ("x", "x"), (None, "y")]
    random.Random(5).shuffle(edges)
    df = spark.createDataFrame(edges * 3, "a string, b string").repartition(7)
    report, plain = [], []
    want = brute_components([(a, b) for a, b in edges if a and a != b])
    assert rows(components.connected_components(df, local=True, report=report)) == want
    assert rows(components.connected_components(df, report=plain)) == want
    assert report[-1] == plain[-1] == len(want) - len({c for _, c in want})
    if bound > 4:
        assert len(report) == 2 and len(plain) > 4
    numbers = df.select(*[F.abs(F.xxhash64(c)).alias(c) for c in "ab"]).where("a is not null")
    assert rows(components.connected_components(numbers, local=True)) == rows(components.connected_components(numbers))
    # in order of their ends, as logs come, partitions have little in common
    near = spark.createDataFrame(sorted(chain), "a string, b string").repartitionByRange(4, "a")
    few = []
    components.connected_components(near.union(near).union(near), local=True, report=few)
    assert few[0] <= 3 * len(chain)


def test_joined_arrays():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (2, 1), (50, 30), (400, 500)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        want = {k: k for k in range(n)} | dict(brute_components([*zip(u.tolist(), v.tolist(), strict=True)]))
        assert components.joined(u, v, n).tolist() == [want[k] for k in range(n)]


def test_running_over_many_ranges(spark):
    n = 2000
    df = spark.createDataFrame([((k * 7919) % n, (k * 7919) % n % 5) for k in range(n)], "k long, x long").repartition(6)
    got = {r.k: (r.rank, r.upto, r.n, r.total) for r in running(df, ["k"], "x").collect()}
    assert got == {k: (k + 1, sum(j % 5 for j in range(k + 1)), n, 2 * n) for k in range(n)}
    assert running(df.limit(0), ["k"], "x").count() == 0


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("ab", "bc"))
    r = graphs.compare_sets(a, b, ["k"]).first()
    assert tuple(r) == (1, 1, 1, 0.5, 0.5, 1 / 3)
    empty = a.where("false")
    assert tuple(graphs.compare_sets(empty, empty, ["k"]).first()) == (0, 0, 0, 1.0, 1.0, 1.0)
    assert rows(graphs.set_members(a, b, ["k"])) == [("a", "absent"), ("b", "shared"), ("c", "additional")]
