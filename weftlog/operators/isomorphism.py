"""Classes of executions whose graphs are the same but for the ids of their events.

Colours of events are refined by joins over all executions at once: a colour is a hash of the activity, and then of the
colours and object types at both ends of its edges, until no execution tells more of its events apart. Executions with
the same colours are then compared event by event with the smallest of them, those that differ with the smallest
of the rest. Colours are the same in graphs that are the same, so they only ever save comparisons.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.plans.scratch import materialize, measured
from weftlog.plans.sizing import sized


def colours(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(exec_id, eid, activity, colour) of nodes (exec_id, eid, activity), with edges (exec_id, src, dst, object_types).

    What surrounds an event is summed, not gathered, so an event may have any number of edges.
    """
    ends = materialize(edges.select("exec_id", "src", "dst", F.array_join(F.sort_array("object_types"), "\u0001").alias("types")).distinct(), "iso-edges")
    now = nodes.select("exec_id", "eid", "activity").distinct().withColumn("colour", F.xxhash64("activity"))
    distinct = -1
    for _ in range(max_rounds):
        now = materialize(now, "iso-colours")
        _, seen = measured(now.select("exec_id", "colour").distinct(), "iso-count", F.count("*").alias("n"))
        if seen["n"] == distinct:
            return now
        distinct = seen["n"]
        at = now.select("exec_id", "eid", "colour")
        sides = [ends.join(at.withColumnRenamed("eid", far), ["exec_id", far]).select("exec_id", F.col(near).alias("eid"), F.xxhash64(F.lit(near), "types", "colour").cast("decimal(38,0)").alias("h")) for near, far in (("src", "dst"), ("dst", "src"))]
        around = sides[0].unionByName(sides[1]).groupBy("exec_id", "eid").agg(F.sum("h").alias("h"))
        now = now.join(around, ["exec_id", "eid"], "left").select("exec_id", "eid", "activity", F.xxhash64("colour", "h").alias("colour"))
    raise RuntimeError(f"colours did not settle in {max_rounds} rounds")


def same_graph(one: tuple[list, list], other: tuple[list, list]) -> bool:
    """Whether events (eid, activity, colour) and edges (src, dst, types) of two graphs can be mapped onto each other."""
    (nodes1, edges1), (nodes2, edges2) = one, other
    label1, label2 = ({e: (a, c) for e, a, c in nodes} for nodes in (nodes1, nodes2))
    if Counter(label1.values()) != Counter(label2.values()) or Counter((label1[s], label1[d], t) for s, d, t in edges1) != Counter((label2[s], label2[d], t) for s, d, t in edges2):
        return False
    type1, type2 = ({(s, d): t for s, d, t in edges} for edges in (edges1, edges2))
    size = Counter(label1.values())
    beside: dict[str, list[str]] = {e: [] for e in label1}
    for s, d in type1:
        beside[s].append(d)
        beside[d].append(s)
    # events with rare labels first, and then those next to what has been mapped
    order: list[str] = []
    known: set[str] = set()
    for start in sorted(label1, key=lambda e: (size[label1[e]], e)):
        todo = [start]
        while todo:
            e = todo.pop()
            if e not in known:
                known.add(e)
                order.append(e)
                todo += sorted((x for x in beside[e] if x not in known), key=lambda x: (-size[label1[x]], x))
    like: dict[tuple, list[str]] = {}
    for e in sorted(label2):
        like.setdefault(label2[e], []).append(e)
    onto: dict[str, str] = {}
    used: set[str] = set()

    def fits(e: str, f: str) -> bool:
        return f not in used and all(type1.get((e, x)) == type2.get((f, onto[x])) and type1.get((x, e)) == type2.get((onto[x], f)) for x in beside[e] if x in onto)

    # as both graphs have as many edges, a map that keeps every edge of the one is onto those of the other
    choices = [iter(like[label1[order[0]]])] if order else []
    while choices:
        e = order[len(choices) - 1]
        if e in onto:
            used.discard(onto.pop(e))
        f = next((f for f in choices[-1] if fits(e, f)), None)
        if f is None:
            choices.pop()
            continue
        onto[e] = f
        used.add(f)
        if len(choices) == len(order):
            return True
        choices.append(iter(like[label1[order[len(choices)]]]))
    return not order


def isomorphism_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(exec_id, class): class is the smallest exec_id of the executions with the same graph, whose events have the same
    activities and whose edges the same object types. An execution's graph is one row where graphs are compared."""
    coloured = colours(nodes, edges)
    events = coloured.groupBy("exec_id").agg(F.collect_list(F.struct("eid", "activity", "colour")).alias("events"), F.sum(F.xxhash64("colour").cast("decimal(38,0)")).alias("sum"))
    types = F.array_join(F.sort_array("object_types"), "\u0001").alias("types")
    arcs = edges.select("exec_id", F.struct("src", "dst", types).alias("e")).groupBy("exec_id").agg(F.collect_set("e").alias("arcs"))
    graphs = events.join(arcs, "exec_id", "left").withColumn("arcs", F.coalesce("arcs", F.array().cast("array<struct<src:string,dst:string,types:string>>")))
    rest = materialize(graphs.withColumn("alike", F.concat_ws("-", F.size("events"), F.size("arcs"), F.col("sum").cast("string"))).drop("sum"), "iso-graphs")
    out = None

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda rows, names: [tuple(r[n] for n in names) for r in rows]
        graph = lambda events, arcs: (plain(events, ("eid", "activity", "colour")), plain(arcs, ("src", "dst", "types")))
        for frame in frames:
            same = [same_graph(graph(a, b), graph(c, d)) for a, b, c, d in zip(frame["events"], frame["arcs"], frame["events1"], frame["arcs1"], strict=True)]
            yield pd.DataFrame({"exec_id": frame["exec_id"], "class": frame["class"], "same": same})

    while True:
        first = rest.groupBy("alike").agg(F.min("exec_id").alias("class"))
        model = rest.join(sized(materialize(first.select(F.col("class").alias("exec_id"), "alike"), "iso-first")), ["exec_id", "alike"]).select("alike", F.col("exec_id").alias("class"), F.col("events").alias("events1"), F.col("arcs").alias("arcs1"))
        pairs = rest.join(model, "alike")
        done, seen = measured(pairs.mapInPandas(compared, "exec_id string, class string, same boolean"), "iso-compared", F.count_if(~F.col("same")).alias("left"))
        found = done.where("same").select("exec_id", "class")
        out = found if out is None else out.unionByName(found)
        if not seen["left"]:
            return out
        rest = materialize(rest.join(done.where("not same").select("exec_id"), "exec_id", "left_semi"), "iso-graphs")


def classes_of_forms(forms: DataFrame, nodes: Column, arcs: Column) -> DataFrame:
    """isomorphism_classes() of executions whose graphs have a form: forms (exec_id, kinds, arcs), equal ones of the same graphs,
    nodes and arcs an array of the events (eid, activity) and of the edges (src, dst, object_types) of a form.

    One execution of each form is compared with the others. Forms are told apart by 128 bits of hashes, and the equality
    of those that share them is checked.
    """
    key = [F.xxhash64(F.lit(k), "kinds", "arcs").alias(f"h{k}") for k in (1, 2)]
    forms = materialize(forms.select("exec_id", *key, "kinds", "arcs"), "iso-forms")
    form = F.struct("kinds", "arcs")
    seen = forms.groupBy("h1", "h2").agg(F.min("exec_id").alias("exec_id"), F.min(form).alias("form"), (F.min(form) != F.max(form)).alias("differ"))
    some, found = measured(seen.select("h1", "h2", "exec_id", "form.*", "differ"), "iso-form", F.count_if("differ").alias("differ"))
    if found["differ"]:
        raise RuntimeError("two forms have the same hashes")
    events = some.select("exec_id", F.explode(nodes).alias("x")).select("exec_id", "x.*")
    edges = some.select("exec_id", F.explode(arcs).alias("x")).select("exec_id", "x.*")
    classes = isomorphism_classes(events, edges).withColumnRenamed("exec_id", "first")
    named = materialize(some.select("h1", "h2", F.col("exec_id").alias("first")).join(classes, "first").select("h1", "h2", "class"), "iso-named")
    return forms.select("exec_id", "h1", "h2").join(sized(named), ["h1", "h2"]).select("exec_id", "class")
