"""Fall-throughs of the miner, nets as automata, quality over the prefix tree."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlog.operators import conformance, petri
from weftlog.plans.scan import scan
from weftlog.sources.ocel import object_log

DAY = dt.datetime(2033, 3, 1)


def tree_of(*traces, noise=0.0):
    return petri.mine_tree(petri.Variants({tuple(t): 1 for t in traces}), noise)


def precision_of(tree, traces):
    """Escaping edges, plainly."""
    r = petri.Replayer(petri.net_of(tree))
    nexts, weight, enabled = {}, Counter(), {}
    for t, n in traces.items():
        known = r.choices_until_misfit(t)
        for k, options in enumerate(known):
            nexts.setdefault(t[:k], set()).add(t[k])
            weight[t[:k]] += n
            enabled[t[:k]] = set(options)
    total = sum(weight[p] * len(enabled[p]) for p in weight)
    return 1 - sum(weight[p] * len(enabled[p] - nexts[p]) for p in weight) / total


@pytest.mark.parametrize(
    ("traces", "tree"),
    [
        # x is once in each trace, anywhere; a and b make a loop without it
        (["xab", "axbab", "abxab", "ababx"], ("par", [("act", "x"), ("loop", [("seq", [("act", "a"), ("act", "b")]), ("tau",)])])),
        # without a, c comes before b
        (["ab", "acbab"], ("par", [("loop", [("act", "a"), ("tau",)]), ("seq", [("xor", [("tau",), ("act", "c")]), ("loop", [("act", "b"), ("tau",)])])])),
        # an end is followed by a start
        (["abab", "aabb", "ab"], ("loop", [("seq", [("loop", [("act", "a"), ("tau",)]), ("loop", [("act", "b"), ("tau",)])]), ("tau",)])),
    ],
)
def test_fall_throughs(traces, tree):
    got = tree_of(*traces)
    assert got == tree
    log = {tuple(t): 1 for t in traces}
    flower = ("loop", [("xor", [("act", a) for a in sorted(set("".join(traces)))]), ("tau",)])
    assert precision_of(got, log) > precision_of(flower, log)
    assert all(petri.Replayer(petri.net_of(got)).replay(t).is_fit for t in log)


def test_noise_leaves_out_rare_starts_and_ends():
    log = petri.Variants({tuple("abc"): 50, tuple("acb"): 50, tuple("bac"): 1})
    # b is first once: only with it are a and b side by side
    assert petri.find_cut(log.summary(), 0.0)[0] == "par"
    assert petri.find_cut(log.summary(), 0.2) == ("seq", [{"a"}, {"b", "c"}])
    seen = petri.Variants({tuple("ab"): 50, tuple("ba"): 50, tuple("a"): 2}).summary()
    assert (seen.starts, seen.ends, seen.once) == ({"a": 52, "b": 50}, {"b": 50, "a": 52}, {"a": 102, "b": 100})


traces = st.lists(st.lists(st.sampled_from("abcd"), max_size=8).map(tuple), min_size=1, max_size=5)


def test_a_run_that_the_shortest_paths_miss():
    """After d, c by the inner loop is shorter, but only the outer loop leads to another i."""
    net = petri.net_of(("loop", [("par", [("loop", [("act", "c"), ("tau",)]), ("seq", [("xor", [("tau",), ("act", "i")]), ("loop", [("act", "d"), ("tau",)])])]), ("tau",)]))
    r = petri.Replayer(net)
    trace = list("cdcid")
    assert not r._greedy(trace, False).is_fit
    got = r.replay(trace)
    assert (got.is_fit, got.missing, got.remaining, got.fitness) == (True, 0, 0, 1.0)
    assert [net.transitions[k][0] for k in got.fired if net.transitions[k][0]] == trace
    assert r.run_of("cc") is None and not r.replay("cc").is_fit and r.run_of(["odd"]) is None
    a, state = petri.language(net), 0
    for x in trace:
        state = a.after[state * len(a.names) + a.names.index(x)]
    assert a.ends[state][0]


@settings(max_examples=200, deadline=None)
@given(traces, st.lists(st.sampled_from("abcd"), max_size=6).map(tuple))
def test_the_language_is_that_of_all_runs(log, other):
    net = petri.mine({t: 1 for t in log})
    a, r = petri.language(net), petri.Replayer(net)
    for t in [*log, other]:
        state, enabled = 0, []
        for x in t:
            enabled.append(a.enabled[state])
            state = a.after[state * len(a.names) + a.names.index(x)] if x in a.names else -1
            if state < 0:
                break
        assert enabled == [len(c) for c in r.choices_until_misfit(t)]
        assert (state >= 0 and a.ends[state][0]) == (r.run_of(t) is not None) == r.replay(t).is_fit


@settings(max_examples=200, deadline=None)
@given(traces, st.lists(st.sampled_from("abcde"), max_size=6).map(tuple))
def test_an_automaton_counts_as_token_replay_does(log, other):
    net = petri.mine({t: 1 for t in log})
    a, r = petri.compiled(net), petri.Replayer(net)
    for t in [*log, other]:
        state, consumed, produced, fired = 0, 0, 1, []
        for x in t:
            if x not in a.names or a.after[at := state * len(a.names) + a.names.index(x)] < 0:
                state = -1
                break
            consumed, produced, fired, state = consumed + a.consumed[at], produced + a.produced[at], fired + a.fired[at], a.after[at]
        want = r.replay(t)
        fits = state >= 0 and a.ends[state][0]
        assert fits == r._greedy(list(t), False).is_fit
        assert want.is_fit or not fits
        if fits:
            _, c, p, last = a.ends[state]
            assert (consumed + c + 1, produced + p, fired + last) == (want.consumed, want.produced, want.fired)


LOGS = [["xab", "axbab", "abxab", "ababx"], ["ab", "acbab"], ["abcabc", "abc", "acbabc", "acb"], ["abab", "aabb", "bbaa", "ba"], ["abcd", "bcda", "cdab", "dabc", "dcba", "acac"]]


@pytest.mark.parametrize("log", LOGS)
def test_fall_throughs_over_a_table(spark, log):
    kept = {tuple(t): k + 1 for k, t in enumerate(log)}
    table = spark.createDataFrame([(list(t), n) for t, n in kept.items()], "variant array<string>, cases long")
    assert conformance.VariantTable(table).around() == petri.Variants(kept).around()
    assert petri.mine_tree(conformance.VariantTable(table)) == petri.mine_tree(petri.Variants(kept))


def test_too_many_activities_are_an_error(spark, monkeypatch):
    """One more than the miner holds, where the rows that are read would not show it."""
    monkeypatch.setattr(conformance, "MAX_ACTIVITIES", 20)
    wide = spark.createDataFrame([([f"a{k:02d}", f"a{j:02d}"], 1) for k in range(21) for j in range(21)], "variant array<string>, cases long")
    with pytest.raises(ValueError, match="more than 20 activities"):
        conformance.VariantTable(wide).summary()
    few = conformance.VariantTable(wide.where("variant[0] < 'a20' and variant[1] < 'a20'")).summary()
    assert len(few.activities) == 20 and len(few.follows) == 400
    monkeypatch.setattr(conformance, "MAX_AROUND", 10)
    with pytest.raises(ValueError, match="combinations"):
        conformance.VariantTable(wide).around()


def flat_of(spark, log):
    """A flat log of traces, as often as they are to be there."""
    events, k = [], 0
    for t, n in log.items():
        for _ in range(n):
            events += [(f"{k}-{j}", f"c{k}", a, DAY + dt.timedelta(hours=j)) for j, a in enumerate(t)]
            k += 1
    return spark.createDataFrame(events, "eid string, case_id string, activity string, ts timestamp_ntz")


def brute_quality(net, log):
    r = petri.Replayer(net)
    visits = Counter()
    for t, n in log.items():
        for k in r.replay(t).fired:
            visits[k] += n
    general = 1 - sum(1 / math.sqrt(visits[k]) if visits[k] else 1 for k in range(len(net.transitions))) / len(net.transitions)
    nexts, weight, enabled = {}, Counter(), {}
    for t, n in log.items():
        for k, options in enumerate(r.choices_until_misfit(t)):
            nexts.setdefault(t[:k], set()).add(t[k])
            weight[t[:k]] += n
            enabled[t[:k]] = set(options)
    precision = 1 - sum(weight[p] * len(enabled[p] - nexts[p]) for p in weight) / sum(weight[p] * len(enabled[p]) for p in weight)
    return round(precision, 9), round(general, 9)


@pytest.mark.parametrize("automata", [True, False])
def test_quality_with_traces_that_do_not_fit(spark, monkeypatch, automata):
    """Fitting prefixes of unfit traces count; both ways of replay agree with a plain one, in all token counts too."""
    if not automata:
        monkeypatch.setattr(conformance, "compiled", lambda net: None)
        monkeypatch.setattr(conformance, "language", lambda net: None)
    net = petri.net_of(("seq", [("act", "a"), ("par", [("xor", [("tau",), ("act", "b")]), ("loop", [("act", "c"), ("tau",)])]), ("xor", [("act", "d"), ("act", "e")])]))
    log = {("a", "b", "c", "d"): 4, ("a", "c", "c", "c", "d"): 2, ("a", "c"): 3, ("a", "z", "c", "d"): 2, ("c", "a"): 1, ("a", "b", "b", "c", "e"): 2, ("z",): 1, tuple("a" + "c" * 600 + "d"): 1}
    flat = flat_of(spark, log)
    q = conformance.quality(flat, net).first()
    assert (q.precision, q.generalization) == brute_quality(net, log)
    r = petri.Replayer(net)
    got = {tuple(x.activities): (x.missing_tokens, x.consumed_tokens, x.remaining_tokens, x.produced_tokens, x.trace_is_fit, x.trace_fitness) for x in conformance.replay(flat, net, "cases").collect()}
    want = {t: (x.missing, x.consumed, x.remaining, x.produced, x.is_fit, x.fitness) for t in log for x in [r.replay(t)]}
    assert got == want and sum(w[4] for w in want.values()) == 3


def test_quality_by_hand(spark):
    """a, then b or c: an unfit a-z counts at the empty prefix and after a."""
    net = petri.net_of(("seq", [("act", "a"), ("xor", [("act", "b"), ("act", "c")])]))
    q = conformance.quality(flat_of(spark, {("a", "b"): 3, ("a", "z"): 1}), net).first()
    # 4 cases at the start (1 enabled), 4 after a (b and c enabled, c never taken); visits a 4, b 3, c 0
    assert (q.precision, q.generalization) == (round(1 - 4 / 12, 9), round(1 - (1 / 2 + 1 / math.sqrt(3) + 1) / 3, 9))


def test_rows_of_the_prefix_tree_are_linear(spark):
    log = {tuple(f"s{k}" for k in range(300)): 2, tuple(f"s{k}" for k in range(150)) + ("x",): 1}
    counts = spark.createDataFrame([(list(t), n) for t, n in log.items()], "variant array<string>, cases long")
    net = petri.net_of(("seq", [("act", f"s{k}") for k in range(300)]))
    tree = conformance.prefix_tree(conformance.variant_steps(counts, net))
    assert tree.count() == 301 and tree.agg(F.sum("cases")).first()[0] == 751


def test_scan(spark):
    rng = random.Random(1)
    arrays = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    d = spark.createDataFrame([(a,) for a in arrays], "xs array<int>")
    got = [r.s for r in d.select("xs", scan(F.col("xs"), F.lit(7), lambda s, x: (s * 3 + x) % 1001).alias("s")).collect()]
    for a, s in zip(arrays, got, strict=True):
        want = [7]
        for x in a:
            want.append((want[-1] * 3 + x) % 1001)
        assert s == want


def test_many_objects_of_many_types_in_one_plan(spark):
    events, relations = [], []
    for k in range(6):
        for h, (a, kinds) in enumerate([("open", "xy"), ("work", "x"), ("close", "y")] if k != 5 else [("close", "y"), ("work", "x"), ("open", "xy")]):
            events.append((f"{a}{k}", DAY + dt.timedelta(days=k, hours=h), a))
            relations += [(f"{a}{k}", f"{t}{k}", t) for t in kinds]
    log = object_log(spark, events, relations)
    nets = {"x": petri.net_of(("seq", [("act", "open"), ("act", "work")])), "y": petri.net_of(("seq", [("act", "open"), ("act", "close")]))}
    ids = spark.createDataFrame([("x", "x1"), ("x", "x5"), ("y", "y2"), ("y", "y5"), ("y", "y5")], "otype string, case_id string")
    got = rows(conformance.check_projections(log, nets, ids).select("object_type", "object_id", "event_count", "trace_is_fit", "missing_tokens"))
    assert got == [("x", "x1", 2, True, 0), ("x", "x5", 2, False, 1), ("y", "y2", 2, True, 0), ("y", "y5", 2, False, 1)]
    assert rows(conformance.check_projections(log, nets, {"x": ["x1", "x5"], "y": "y2"}).select("object_id")) == [("x1",), ("x5",), ("y2",)]
    with pytest.raises(ValueError, match="x x9"):
        conformance.check_projections(log, nets, ids.unionByName(spark.createDataFrame([("x", "x9")], ids.schema)))
