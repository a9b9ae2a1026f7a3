from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from conftest import rows

from weftlog.functions.dot import dot_text
from weftlog.operators import extract, igraph
from weftlog.sources.ocel import object_log, read_executions, read_relations

DAY = dt.datetime(2031, 5, 6)
#: A joiner's workshop: hour, event, activity, objects as type and id.
EVENTS = [
    (1, "book-A", "book", [("orders", "A"), ("items", "A-leg"), ("items", "A-top"), ("people", "kim")]),
    (2, "quote-A", "quote", [("orders", "A"), ("people", "kim")]),
    (3, "saw-leg", "saw", [("items", "A-leg")]),
    (4, "saw-top", "saw", [("items", "A-top"), ("people", "sam")]),
    (5, "crate-X", "crate", [("items", "A-leg"), ("items", "A-top"), ("packages", "X")]),
    (9, "haul-X", "haul", [("packages", "X"), ("people", "sam")]),
    (2, "sweep", "sweep", [("people", "sam")]),
    (3, "book-B", "book", [("orders", "B"), ("items", "B-lid")]),
    (6, "crate-Y", "crate", [("items", "B-lid"), ("packages", "Y")]),
    (4, "book-C", "book", [("orders", "C"), ("items", "C-door")]),
    (4, "book-D", "book", [("orders", "D"), ("items", "D-sill")]),
    (7, "crate-Z", "crate", [("items", "C-door"), ("items", "D-sill"), ("packages", "Z")]),
]
FLOWS = [("orders", "book", "quote"), ("items", "book", "saw"), ("items", "saw", "crate"), ("items", "book", "crate"), ("packages", "crate", "haul")]
A = ["book-A", "crate-X", "haul-X", "quote-A", "saw-leg", "saw-top"]


def workshop(spark, more=()):
    events = [(e, DAY + dt.timedelta(hours=h), a) for h, e, a, _ in reversed(EVENTS)]
    return object_log(spark, events, [*((e, o, t) for _, e, _, objects in EVENTS for t, o in objects), *more])


def test_executions_and_exclusions(spark):
    found = extract.extract(workshop(spark, [("crate-Y", "spare", "items")]))
    assert rows(found.events().select("exec_id", "eid")) == [("order-centred:A", e) for e in A]
    x = {r.exec_oid: (r.reason_code, r.foreign_items, r.foreign_orders) for r in found.exclusions.collect()}
    assert x == {"B": ("foreign_items", ["spare"], []), "C": ("foreign_items_and_orders", ["D-sill"], ["D"]), "D": ("foreign_items_and_orders", ["C-door"], ["C"])}
    assert [r.exec_oid for r in extract.exclusion_report(found, 2).collect()] == ["B", "C"]
    table = {r.exec_oid: r for r in extract.candidates(found).collect()}
    assert (table["A"].events, table["A"].items, table["A"].packages, table["A"].complete, table["A"].simple) == (6, 2, 1, False, True)
    assert (table["C"].items, table["C"].foreign_items, table["C"].foreign_orders, table["C"].activities) == (2, 1, 1, "book, crate")
    assert rows(extract.objects_by_type(found.events(), found.log.relations)) == [("order-centred:A", t, n) for t, n in (("items", 2), ("orders", 1), ("packages", 1), ("people", 2))]


def test_some_orders_only(spark):
    log = workshop(spark)
    named = spark.createDataFrame([("B",), ("B",)], "oid string")
    assert rows(extract.extract(log, only=named).events().select("eid")) == [("book-B",), ("crate-Y",)]
    with pytest.raises(ValueError, match="Q"):
        extract.extract(log, only=spark.createDataFrame([("Q",)], "oid string"))
    twice = type(log)(log.events.unionByName(log.events.where("eid = 'sweep'")), log.objects, log.relations)
    with pytest.raises(ValueError, match="sweep"):
        extract.extract(twice)


def test_objects_of_executions(spark):
    log = workshop(spark)
    nodes = extract.extract(log).events()
    assert [r.eid for r in extract.events_for_object(nodes, log.relations, "items", "A-leg").collect()] == ["book-A", "saw-leg", "crate-X"]
    assert rows(extract.involves_object(nodes, log.relations, "people", "sam")) == [("order-centred:A", True), ("order-centred:B", False)]
    assert extract.events_for_object(nodes, log.relations, "orders", "A-leg").count() == 0


def documents(spark, tmp_path, shift=()):
    """The execution of A as JSON, events at other hours where shift says so."""
    at = dict(shift)
    events = [{"event_id": e, "activity": a, "timestamp": (DAY + dt.timedelta(hours=at.get(e, h))).isoformat(), "objects": [{"object_type": t, "object_id": o} for t, o in objects]} for h, e, a, objects in EVENTS if e in A]
    (tmp_path / "x.json").write_text(json.dumps({"execution_id": "A", "events": events}))
    (tmp_path / "r.json").write_text(json.dumps([{"source_activity": s, "target_activity": d, "object_type": t} for t, s, d in [*FLOWS, FLOWS[0]]]))
    return *read_executions(spark, str(tmp_path / "x.json")), read_relations(spark, str(tmp_path / "r.json"))


@pytest.mark.parametrize("shift", [(), (("quote-A", 8), ("saw-leg", 4.5))])
def test_graph_whatever_the_order_of_independent_events(spark, tmp_path, shift):
    nodes, relations, accepted = documents(spark, tmp_path, shift)
    assert accepted.count() == len(FLOWS)
    edges, reach, objects = igraph.instance_graph(nodes, relations, accepted)
    assert rows(edges.select("src", "dst")) == [("book-A", "quote-A"), ("book-A", "saw-leg"), ("book-A", "saw-top"), ("crate-X", "haul-X"), ("saw-leg", "crate-X"), ("saw-top", "crate-X")]
    assert rows(igraph.incomparable_pairs(nodes, reach).select("eid1", "eid2")) == [("crate-X", "quote-A"), ("haul-X", "quote-A"), ("quote-A", "saw-leg"), ("quote-A", "saw-top"), ("saw-leg", "saw-top")]
    s = igraph.screening(nodes, edges, reach, objects).first()
    assert (s.nodes, s.edges, s.sources, s.sinks, s.isolated, s.incomparable, s.valid) == (6, 6, 1, 2, 0, 5, True)
    assert "saw-leg\\nsaw" in dot_text(nodes, edges).first().dot
    assert rows(igraph.relevant_relations(nodes, accepted)) == sorted(("A", *r) for r in FLOWS)
    igraph.require_valid(nodes, relations, edges)


def test_edge_differences(spark):
    one, other = (spark.createDataFrame([("x", a, b) for a, b in pairs], "exec_id string, src string, dst string") for pairs in (("ab", "bc"), ("ab", "cd", "ce")))
    assert rows(igraph.edge_differences(one, other)) == [("x", 2, 1, False)]
    assert rows(igraph.edge_differences(one, one)) == [("x", 0, 0, True)]


def test_invalid_executions(spark, tmp_path):
    nodes, relations, accepted = documents(spark, tmp_path)
    edges, reach, objects = igraph.instance_graph(nodes, relations, accepted)
    blank = nodes.withColumn("activity", nodes["activity"].substr(9, 2))
    again = nodes.unionByName(nodes.where("eid = 'saw-top'"))
    bare = relations.where("eid <> 'quote-A'")
    assert rows(igraph.execution_violations(again, bare)) == [("A", "no objects", "quote-A"), ("A", "repeated event", "saw-top")]
    for bad, rel, what in ((blank, relations, "blank activity"), (again, relations, "repeated event, saw-top"), (nodes, bare, "no objects, quote-A"), (nodes.limit(0), relations, "without events")):
        with pytest.raises(ValueError, match=what):
            igraph.require_valid(bad, rel)
    loop = edges.unionByName(edges.where("src = 'crate-X'").selectExpr("exec_id", "dst as src", "src as dst", "object_types", "object_ids"))
    with pytest.raises(ValueError, match="haul-X to crate-X"):
        igraph.require_valid(nodes, relations, loop)
    s = igraph.screening(nodes, loop, reach, objects).first()
    assert (s.is_dag, s.valid) == (False, False)
    # an edge that a path makes needless
    more = edges.unionByName(edges.where("src = 'crate-X'").selectExpr("exec_id", "'saw-leg' as src", "dst", "object_types", "object_ids"))
    s = igraph.screening(nodes, more, reach, objects).first()
    assert (s.is_dag, s.reduced, s.valid) == (True, False, False)


def test_self_relation_leaves_a_chain(spark):
    n = 6
    nodes = spark.createDataFrame([("x", f"try{k}", DAY + dt.timedelta(hours=k), "knock") for k in range(n)], "exec_id string, eid string, ts timestamp_ntz, activity string")
    relations = spark.createDataFrame([(f"try{k}", "p", "packages") for k in range(n)], "eid string, oid string, otype string")
    accepted = spark.createDataFrame([("packages", "knock", "knock")], "otype string, src_act string, dst_act string")
    edges, reach, objects = igraph.instance_graph(nodes, relations, accepted)
    assert rows(edges.select("src", "dst")) == [(f"try{k}", f"try{k + 1}") for k in range(n - 1)]
    assert igraph.path_pairs(reach).count() == n * (n - 1) // 2
    assert rows(igraph.activity_chain(nodes, "knock").select("place", "eid")) == [(k + 1, f"try{k}") for k in range(n)]
    c = igraph.chain_is_consecutive(nodes, edges, "knock").first()
    assert (c.chain_edges, c.missing, c.additional) == (n - 1, 0, 0)
    c = igraph.chain_is_consecutive(nodes, edges.where("src <> 'try2'"), "knock").first()
    assert (c.chain_edges, c.missing, c.additional) == (n - 1, 1, 0)
    again = igraph.paths(edges)
    assert igraph.path_pairs(again).exceptAll(igraph.path_pairs(reach)).count() == 0 and igraph.reduced(edges, again).count() == n - 1


def plain_paths(edges):
    """Pairs with a path, and those with one of two or more edges, by going on until nothing is new."""
    some = set(edges)
    while new := {(x, a, d) for x, a, b in some for y, c, d in edges if x == y and b == c} - some:
        some |= new
    return some, {(x, a, d) for x, a, b in edges for y, c, d in some if x == y and b == c}


@pytest.mark.parametrize("small", [0, 12, 20_000])
def test_paths_as_bits(spark, monkeypatch, small):
    """Random graphs of up to 150 events and a cycle, in one task each, over the cluster, and some of both."""
    monkeypatch.setattr(igraph, "SMALL", small)
    rng = random.Random(8)
    edges = {("loop", "a", "b"), ("loop", "b", "a"), ("loop", "b", "c")}
    for x, (n, m) in {"tiny": (2, 1), "chain": (150, 0), "wide": (40, 90), "some": (70, 60)}.items():
        names = [f"e{k:03d}" for k in rng.sample(range(n), n)]
        edges |= {(x, a, b) for a, b in zip(names, names[1:], strict=False)} if x == "chain" else {(x, names[i], names[j]) for i, j in (sorted(rng.sample(range(n), 2)) for _ in range(m))}
    df = spark.createDataFrame([*edges, *list(edges)[:5]], "exec_id string, src string, dst string")
    reach = igraph.paths(df)
    want, beyond = plain_paths(edges)
    assert rows(igraph.path_pairs(reach)) == sorted(want)
    assert rows(igraph.reduced(df.distinct(), reach)) == sorted(edges - beyond)
    nodes = spark.createDataFrame([(x, e) for x, e in {(x, e) for x, a, b in edges for e in (a, b)} | {("tiny", "alone"), ("bare", "one"), ("bare", "two")}], "exec_id string, eid string")
    names = [(r.exec_id, r.eid) for r in nodes.collect()]
    pairs = {(x, a, b) for x, a in names for y, b in names if x == y and a < b and (x, a, b) not in want and (x, b, a) not in want}
    assert rows(igraph.incomparable_pairs(nodes, reach)) == sorted(pairs)
    groups = {}
    for x, e in names:
        groups.setdefault(x, []).append({e})
    for x, a, b in edges:
        mine = [g for g in groups[x] if a in g or b in g]
        groups[x] = [g for g in groups[x] if g not in mine] + [set().union(*mine)]
    assert rows(igraph.weakly_connected(nodes, df)) == sorted((x, len(g)) for x, g in groups.items())
