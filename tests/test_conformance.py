from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlog.operators import conformance, petri
from weftlog.sources.ocel import object_log

PACKAGE = ("create package", "send package", "package delivered")


def test_replay_of_changed_traces():
    r = petri.Replayer(petri.mine({PACKAGE: 3}))
    assert r.replay(PACKAGE).is_fit and r.replay(PACKAGE).fitness == 1.0
    cut = r.replay(PACKAGE[:2])
    assert (cut.is_fit, cut.missing, cut.remaining, round(cut.fitness, 9)) == (False, 1, 1, round(2 / 3, 9))
    assert round(r.replay(("create package", "odd", "package delivered")).fitness, 9) == round(2 / 3, 9)
    assert r.replay(PACKAGE[::-1]).fitness == 0.5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=6).map(tuple), min_size=1, max_size=5))
def test_what_a_net_is_mined_from_fits_it(traces):
    log = {t: 1 for t in traces}
    r = petri.Replayer(petri.mine(log))
    for t in log:
        assert r.replay(t).is_fit, t


def test_projections_and_quality(spark):
    t = dt.datetime(2024, 1, 1)
    events = [(f"{a[:2]}{k}", t + dt.timedelta(days=k, hours=j), a) for k in range(4) for j, a in enumerate(PACKAGE)]
    log = object_log(spark, events, [(f"{a[:2]}{k}", f"p-{k}", "packages") for k in range(4) for a in PACKAGE])
    nets = conformance.discover_nets(log, ["packages"])
    one = conformance.check_projections(log, nets, {"packages": "p-1"}).collect()
    assert [(r.object_id, r.event_count, r.trace_is_fit, r.missing_tokens) for r in one] == [("p-1", 3, True, 0)]
    for bad in ({"packages": "p-9"}, {"orders": "o"}, {"packages": []}):
        with pytest.raises(ValueError):
            conformance.check_projections(log, nets, bad)
    q = conformance.quality(log.flat("packages"), nets["packages"]).first()
    assert (q.precision, q.generalization) == (1.0, 0.5)
    both = {r.side: r for r in conformance.structural_holdout(log, ["packages"], 0.5).collect()}
    assert both["training"].traces == both["test"].traces == 2 and both["test"].fitting == 2
