"""Classes of executions against all permutations of small graphs."""

from __future__ import annotations

import random
from itertools import permutations

from conftest import rows

from weftlog.operators import igraph
from weftlog.operators.isomorphism import isomorphism_classes, same_graph


def plainly_same(one, other):
    (n1, e1), (n2, e2) = one, other
    if len(n1) != len(n2) or len(e1) != len(e2):
        return False
    ids = sorted(n1)
    return any(all(n1[a] == n2[b] for a, b in zip(ids, p, strict=True)) and {(dict(zip(ids, p, strict=True))[s], dict(zip(ids, p, strict=True))[d], t) for s, d, t in e1} == e2 for p in permutations(sorted(n2)))


def made(rng, n):
    nodes = {f"e{k}": rng.choice("aab") for k in range(n)}
    edges = {(f"e{i}", f"e{j}", rng.choice("xxy")) for j in range(n) for i in range(j) if rng.random() < 0.35}
    return nodes, {(s, d, min(t for a, b, t in edges if (a, b) == (s, d))) for s, d, _ in edges}


def renamed(rng, graph):
    names = dict(zip(sorted(graph[0]), rng.sample([f"f{k}" for k in range(20)], len(graph[0])), strict=True))
    return {names[e]: a for e, a in graph[0].items()}, {(names[s], names[d], t) for s, d, t in graph[1]}


def test_classes(spark):
    rng = random.Random(12)
    graphs = [made(rng, n) for n in (1, 2, 3, 4, 5, 5, 6, 6) for _ in range(4)]
    graphs += [renamed(rng, g) for g in graphs]
    # two rings of three and one of six: colours are all the same, graphs are not
    ring = lambda *names: {(a, b, "x") for a, b in zip(names, names[1:] + names[:1], strict=True)}
    six = {f"e{k}": "a" for k in range(6)}
    graphs += [(six, ring("e0", "e1", "e2") | ring("e3", "e4", "e5")), (six, ring("e0", "e1", "e2", "e3", "e4", "e5")), (six, ring("e0", "e3", "e1", "e4", "e2", "e5")), (six, ring("e0", "e3", "e1") | ring("e4", "e2", "e5"))]
    graphs = {f"g{k:02d}": g for k, g in enumerate(graphs)}
    nodes = spark.createDataFrame([(x, e, a) for x, (n, _) in graphs.items() for e, a in n.items()], "exec_id string, eid string, activity string")
    edges = spark.createDataFrame([(x, s, d, [t, "o"]) for x, (_, es) in graphs.items() for s, d, t in es], "exec_id string, src string, dst string, object_types array<string>")
    want = {x: min(y for y, h in graphs.items() if plainly_same(g, h)) for x, g in graphs.items()}
    assert rows(isomorphism_classes(nodes, edges)) == sorted(want.items())
    assert len(set(want.values())) < len(graphs) / 2 + 3
    assert rows(isomorphism_classes(nodes.limit(0), edges.limit(0))) == []


def test_large_alike_graphs():
    """A chain of 3,000 and a star of 2,000 leaves are mapped without trying their permutations."""
    chain = lambda p: ([(f"{p}{k:04d}", "a", k) for k in range(3000)], [(f"{p}{k:04d}", f"{p}{k + 1:04d}", "t") for k in range(2999)])
    star = lambda p: ([(p, "hub", 0)] + [(f"{p}{k}", "leaf", 1) for k in range(2000)], [(p, f"{p}{k}", "t") for k in range(2000)])
    assert same_graph(chain("x"), chain("y")) and same_graph(star("x"), star("y")) and not same_graph(chain("x"), star("x"))


def test_next_only_leaves_the_same_graph(spark):
    """An activity that follows itself: reduced edges and paths stay, rows are linear."""
    n = 400
    objects = spark.createDataFrame([("x", f"e{k:04d}", k, "knock" if k % 7 else "open", t, f"{t}{k % 3 if t == 'p' else 0}") for k in range(n) for t in "pq"], "exec_id string, eid string, ts int, activity string, otype string, oid string")
    accepted = spark.createDataFrame([("p", "knock", "knock"), ("q", "knock", "knock"), ("q", "open", "knock")], "otype string, src_act string, dst_act string")
    every, few = igraph.candidate_edges(objects, accepted), igraph.candidate_edges(objects, accepted, next_only=True)
    assert every.count() > 50_000 and few.where("src > 'e0001' and dst like 'e%'").count() < every.count() / 3
    paths = [igraph.paths(c) for c in (every, few)]
    assert rows(igraph.reduced(every, paths[0])) == rows(igraph.reduced(few, paths[1]))
    assert igraph.path_pairs(paths[0]).exceptAll(igraph.path_pairs(paths[1])).count() == 0
    chain = igraph.candidate_edges(objects.where("activity = 'knock' and otype = 'q'"), accepted, next_only=True)
    assert chain.count() == n - len(range(0, n, 7)) - 1
