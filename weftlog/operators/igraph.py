"""Instance graphs: candidate edges on shared objects, transitive reduction, and what follows from them.

Graphs of all executions are one table of nodes and one of edges, keyed by exec_id. An edge always
goes forward in the order of (ts, eid), so the graphs have no cycles.

Paths are bit sets: a row for each event, whose array of longs has a bit for each event of the execution. An
execution of up to SMALL edges is worked out in one task, all of them in one shuffle, and those of a batch over whole
arrays; larger ones by doubling over the whole cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.operators.components import connected_components
from weftlog.plans.scratch import materialize, measured
from weftlog.plans.sizing import sized
from weftlog.schema import STRUCTURAL_TYPES

#: Edges of an execution that one task holds: at most as many events, with 50 MB of bits.
SMALL = 20_000
#: Longs of bits of executions that are worked out at a time.
HELD = 4_000_000

KEY = ["exec_id", "src", "dst"]


def execution_objects(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(exec_id, eid, ts, activity, otype, oid) of nodes (exec_id, eid, ts, activity)."""
    return nodes.select("exec_id", "eid", "ts", "activity").join(relations.select("eid", "oid", "otype").distinct(), "eid")


def candidate_edges(objects: DataFrame, accepted: DataFrame, next_only: bool = False) -> DataFrame:
    """(exec_id, src, dst, object_types, object_ids): pairs of events on one object, the earlier first, whose
    activities are an accepted relation of that object's type.

    The accepted relations, one row for each pair of activities of a type, meet the earlier event
    first, so that only pairs with a possible target are joined. With ``next_only`` a relation of an activity with
    itself joins an event to the next of its activity on the object alone: the reduced graph and the paths are the same,
    as the later ones are reached through it, and a chain of events has as many rows as events.
    """
    a = objects.select("exec_id", "otype", "oid", F.col("eid").alias("src"), F.col("ts").alias("ts1"), F.col("activity").alias("src_act"))
    b = objects.select("exec_id", "otype", "oid", F.col("eid").alias("dst"), F.col("ts").alias("ts2"), F.col("activity").alias("dst_act"))
    joined = accepted.where("src_act <> dst_act") if next_only else accepted
    pairs = a.join(sized(joined), ["otype", "src_act"]).join(b, ["exec_id", "otype", "oid", "dst_act"]).where("struct(ts1, src) < struct(ts2, dst)")
    pairs = pairs.select(*KEY, "otype", "oid")
    if next_only:
        w = Window.partitionBy("exec_id", "otype", "oid", "src_act").orderBy("ts1", "src")
        repeats = a.join(sized(accepted.where("src_act = dst_act").select("otype", "src_act")), ["otype", "src_act"]).withColumn("dst", F.lead("src").over(w))
        pairs = pairs.unionByName(repeats.where("dst is not null").select(*KEY, "otype", "oid"))
    return pairs.groupBy(KEY).agg(F.sort_array(F.collect_set("otype")).alias("object_types"), F.sort_array(F.collect_set("oid")).alias("object_ids"))


def _by_size(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """edges of the executions with up to SMALL of them, and of the others, if any."""
    counts, seen = measured(edges.groupBy("exec_id").agg(F.count("*").alias("n")).where(F.col("n") > SMALL), "large-executions", F.count("*").alias("n"))
    if not seen["n"]:
        return edges, None
    return edges.join(counts, "exec_id", "left_anti"), edges.join(counts, "exec_id", "left_semi")


def _closed(ahead: list[list[int]]) -> list[int]:
    """For each node of a graph given by its edges ahead, the nodes that paths lead to, as bits."""
    waiting = [0] * len(ahead)
    for targets in ahead:
        for j in targets:
            waiting[j] += 1
    order = [k for k, n in enumerate(waiting) if not n]
    for k in order:
        for j in ahead[k]:
            waiting[j] -= 1
            if not waiting[j]:
                order.append(j)
    order += [k for k, n in enumerate(waiting) if n]  # on cycles, or behind them
    bits, again = [0] * len(ahead), True
    while again:
        again = False
        for k in reversed(order):
            new = bits[k]
            for j in ahead[k]:
                new |= 1 << j | bits[j]
            again |= new != bits[k] and len(order) > 1 and any(waiting)
            bits[k] = new
    return bits


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at starts and have counts numbers, one range after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _bits(src: np.ndarray, dst: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ahead and beyond of the nodes of some graphs, each with its rank in its own, over whole arrays, from the nodes
    that lead nowhere on; and which nodes lie on cycles or lead there, whose bits are not worked out."""
    n = len(rank)
    direct = np.zeros(n * width, "<i8")
    np.bitwise_or.at(direct, src * width + rank[dst] // 64, np.left_shift(np.int64(1), rank[dst] % 64))
    ahead, beyond = direct.reshape(n, width), np.zeros((n, width), "<i8")
    out, back = np.argsort(src, kind="stable"), np.argsort(dst, kind="stable")
    leaving, entering = np.bincount(src, minlength=n), np.bincount(dst, minlength=n)
    first_out, first_in = np.cumsum(leaving) - leaving, np.cumsum(entering) - entering
    waiting = leaving.copy()
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        some = ready[leaving[ready] > 0]
        if len(some):
            reached = ahead[dst[out[_spread(first_out[some], leaving[some])]]]
            beyond[some] = np.bitwise_or.reduceat(reached, np.cumsum(leaving[some]) - leaving[some], axis=0)
            ahead[some] |= beyond[some]
        from_, times = np.unique(src[back[_spread(first_in[ready], entering[ready])]], return_counts=True)
        waiting[from_] -= times
        ready = from_[waiting[from_] == 0]
    return ahead, beyond, waiting > 0


def _bits_on_cycles(src: np.ndarray, dst: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ahead and beyond of one graph of n nodes that may have cycles."""
    targets: list[list[int]] = [[] for _ in range(n)]
    for x, y in set(zip(src.tolist(), dst.tolist(), strict=True)):
        targets[x].append(y)
    bits = _closed(targets)
    over = [0] * n
    for k, ys in enumerate(targets):
        for y in ys:
            over[k] |= bits[y]
    return tuple(np.frombuffer(b"".join(x.to_bytes(8 * width, "little") for x in sets), "<i8").reshape(n, width) for sets in (bits, over))


def _paths_of_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of paths() for executions (exec_id, e), e an array of edges (src, dst), HELD longs at a time."""
    for batch in batches:
        lists = batch.column("e")
        owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        ends = [pc.struct_field(lists.flatten(), c) for c in ("src", "dst")]
        names = pc.unique(pa.chunked_array(ends))
        names = names.take(pc.sort_indices(names))
        keys = [owner * len(names) + np.asarray(pc.index_in(x, names)) for x in ends]
        nodes = np.unique(np.concatenate(keys))
        of, (src, dst) = nodes // len(names), (np.searchsorted(nodes, k) for k in keys)
        sizes = np.bincount(of, minlength=len(lists))
        starts = np.cumsum(sizes) - sizes
        rank = np.arange(len(nodes)) - starts[of]
        widths = -(-sizes // 64)
        edges = np.bincount(owner, minlength=len(lists))
        first = np.cumsum(edges) - edges
        for width in np.unique(widths[widths > 0]).tolist():
            alike = np.flatnonzero(widths == width)
            part = np.cumsum(sizes[alike]) * width // HELD
            for k in np.unique(part):
                some = alike[part == k]
                here, arcs = _spread(starts[some], sizes[some]), _spread(first[some], edges[some])
                s, d = np.searchsorted(here, src[arcs]), np.searchsorted(here, dst[arcs])
                ahead, beyond, cyclic = _bits(s, d, rank[here], width)
                for x in np.unique(of[here[cyclic]]).tolist():
                    a, z = np.searchsorted(here, [starts[x], starts[x] + sizes[x]])
                    inside = (s >= a) & (s < z)
                    ahead[a:z], beyond[a:z] = _bits_on_cycles(s[inside] - a, d[inside] - a, z - a, width)
                lists_of = lambda bits: pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, width), pa.int32()), pa.array(bits.reshape(-1), pa.int64()))  # noqa: E731, B023
                yield pa.record_batch([batch.column("exec_id").take(pa.array(of[here])), names.take(pa.array(nodes[here] % len(names))), pa.array(rank[here], pa.int32()), lists_of(ahead), lists_of(beyond)], ["exec_id", "eid", "rank", "ahead", "beyond"])


_PATHS = "exec_id string, eid string, rank int, ahead array<long>, beyond array<long>"


def paths(edges: DataFrame) -> DataFrame:
    """(exec_id, eid, rank, ahead, beyond) of all events on edges: the ranks to which paths lead, and those to which
    paths of two or more edges do, as bits of arrays of longs. Ranks go from 0, in the order of eid."""
    small, large = _by_size(edges.select(KEY))
    gathered = small.groupBy("exec_id").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    out = gathered.mapInArrow(_paths_of_some, _PATHS)
    return materialize(out if large is None else out.unionByName(_paths_by_doubling(large.distinct())), "paths")


def _paths_by_doubling(edges: DataFrame) -> DataFrame:
    ends = edges.select("exec_id", F.explode(F.array("src", "dst")).alias("eid")).distinct()
    ranked = ends.withColumn("rank", F.row_number().over(Window.partitionBy("exec_id").orderBy("eid")) - 1)
    width = ranked.groupBy("exec_id").agg(F.floor(F.max("rank") / 64).cast("int").alias("last"))
    ranked = materialize(ranked.join(width, "exec_id"), "path-ranks")
    reach = closure(edges)
    grid = ranked.select("exec_id", F.col("eid").alias("src"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("word"))

    def words(pairs: DataFrame, name: str) -> DataFrame:
        to = pairs.join(ranked.select("exec_id", F.col("eid").alias("dst"), "rank"), ["exec_id", "dst"])
        masks = to.groupBy("exec_id", "src", F.floor(F.col("rank") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rank") % 64)).alias("mask"))
        full = grid.join(masks, ["exec_id", "src", "word"], "left").groupBy("exec_id", F.col("src").alias("eid"))
        return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))), lambda w: w["mask"]).alias(name))

    return ranked.drop("last").join(words(reach, "ahead"), ["exec_id", "eid"]).join(words(_bypassed(edges, reach), "beyond"), ["exec_id", "eid"])


def has(bits: Column, rank: Column) -> Column:
    """Whether a rank is among bits; false for nulls."""
    word = F.get(bits, F.floor(rank / 64).cast("int"))
    return F.coalesce(F.call_function("shiftright", word, (rank % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def path_pairs(reach: DataFrame) -> DataFrame:
    """KEY of all pairs of events with a path between them, from paths()."""
    ranks = F.filter(F.sequence(F.lit(0), 64 * F.size("ahead") - 1), lambda k: has(F.col("ahead"), k))
    pairs = reach.select("exec_id", F.col("eid").alias("src"), F.explode(ranks).alias("rank"))
    return pairs.join(reach.select("exec_id", "rank", F.col("eid").alias("dst")), ["exec_id", "rank"]).select(KEY)


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """KEY of all pairs with a path, by doubling: paths of any length up to 2**k after k rounds.

    Each round joins only the pairs that the round before found with all pairs, and is one job.
    """
    reach = materialize(edges.select(KEY).distinct().withColumn("round", F.lit(0)), "reach")
    for k in range(1, max_rounds):
        new = reach.where(F.col("round") == k - 1)
        ahead = new.select("exec_id", "src", F.col("dst").alias("mid")).join(reach.select("exec_id", F.col("src").alias("mid"), "dst"), ["exec_id", "mid"])
        behind = reach.where(F.col("round") < k - 1).select("exec_id", "src", F.col("dst").alias("mid")).join(new.select("exec_id", F.col("src").alias("mid"), "dst"), ["exec_id", "mid"])
        both = ahead.unionByName(behind).select(*KEY, F.lit(k).alias("round")).unionByName(reach)
        reach, seen = measured(both.groupBy(KEY).agg(F.min("round").alias("round")), "reach", F.count_if(F.col("round") == k).alias("new"))
        if not seen["new"]:
            return reach.select(KEY)
    raise RuntimeError(f"paths did not end in {max_rounds} rounds")


def _bypassed(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """KEY of pairs that an edge and a path behind it lead over."""
    return edges.select("exec_id", "src", F.col("dst").alias("mid")).join(reach.select("exec_id", F.col("src").alias("mid"), "dst"), ["exec_id", "mid"]).select(KEY).distinct()


def _with_needless(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """edges with needless: whether a path of two or more edges leads over it."""
    out = edges.join(reach.select("exec_id", F.col("eid").alias("src"), F.col("beyond").alias("_beyond")), ["exec_id", "src"], "left")
    out = out.join(reach.select("exec_id", F.col("eid").alias("dst"), F.col("rank").alias("_rank")), ["exec_id", "dst"], "left")
    return out.withColumn("needless", has(F.col("_beyond"), F.col("_rank")))


def reduced(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Edges without those that a longer path makes needless; the others keep their columns."""
    return _with_needless(edges, reach).where("not needless").select(edges.columns)


class Graphs(NamedTuple):
    """edges: the reduced edges of every execution; reach: its paths(); objects: its events with their objects."""

    edges: DataFrame
    reach: DataFrame
    objects: DataFrame


def instance_graph(nodes: DataFrame, relations: DataFrame, accepted: DataFrame) -> Graphs:
    """The graphs of all executions."""
    return graphs_of(execution_objects(nodes, relations), accepted)


def graphs_of(objects: DataFrame, accepted: DataFrame) -> Graphs:
    """The graphs of all executions, from execution_objects()."""
    objects = materialize(objects, "execution-objects")
    cand = materialize(candidate_edges(objects, accepted, next_only=True), "edges-raw")
    reach = paths(cand)
    return Graphs(reduced(cand, reach), reach, objects)


def _ordered(a: str, b: str) -> Column:
    """Whether a path leads from one of two events to the other, whose paths are in columns with a and b."""
    return has(F.col(f"ahead{a}"), F.col(f"rank{b}")) | has(F.col(f"ahead{b}"), F.col(f"rank{a}"))


def _two(events: DataFrame, reach: DataFrame, same: list[str]) -> DataFrame:
    """Pairs of events with the same exec_id and columns in ``same``, eid1 < eid2, with no path either way."""
    at = events.select(*same, "eid").join(reach.select("exec_id", "eid", "rank", "ahead"), ["exec_id", "eid"], "left")
    a, b = (at.select(*same, *[F.col(c).alias(f"{c}{k}") for c in ("eid", "rank", "ahead")]) for k in (1, 2))
    return a.join(b, same).where("eid1 < eid2").where(~_ordered("1", "2"))


def incomparable_pairs(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """(exec_id, eid1, eid2), eid1 < eid2: events of an execution with no path either way."""
    return _two(nodes, reach, ["exec_id"]).select("exec_id", "eid1", "eid2")


def suspicious_repetitions(objects: DataFrame, reach: DataFrame, types: tuple[str, ...] = STRUCTURAL_TYPES) -> DataFrame:
    """(exec_id, activity, eid1, eid2): incomparable events of one activity on a structural object; objects as execution_objects() gives them."""
    return _two(objects.where(F.col("otype").isin(*types)), reach, ["exec_id", "otype", "oid", "activity"]).select("exec_id", "activity", "eid1", "eid2").distinct()


def activity_chain(nodes: DataFrame, activity: str) -> DataFrame:
    """(exec_id, place, eid, ts): the events of one activity of each execution, from 1 in order of ts and eid."""
    w = Window.partitionBy("exec_id").orderBy("ts", "eid")
    return nodes.where(F.col("activity") == activity).select("exec_id", F.row_number().over(w).alias("place"), "eid", "ts")


def chain_is_consecutive(nodes: DataFrame, edges: DataFrame, activity: str) -> DataFrame:
    """(exec_id, chain_edges, missing, additional): edges between the events of one activity against its chain."""
    e = activity_chain(nodes, activity)
    nxt = e.select("exec_id", (F.col("place") - 1).alias("place"), F.col("eid").alias("dst"))
    chain = e.select("exec_id", "place", F.col("eid").alias("src")).join(nxt, ["exec_id", "place"]).select(*KEY, F.lit(1).alias("c"))
    own = edges.select(KEY).join(e.select("exec_id", F.col("eid").alias("src")), ["exec_id", "src"], "left_semi").join(e.select("exec_id", F.col("eid").alias("dst")), ["exec_id", "dst"], "left_semi").withColumn("g", F.lit(1))
    both = chain.join(own, KEY, "full_outer")
    return both.groupBy("exec_id").agg(F.count("c").alias("chain_edges"), F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("additional"))


def _joined(rows: pa.Table) -> pa.Table:
    """(exec_id, linked, groups): events on the edges of one execution, and how many components they make."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    groups = 0
    for x, y in zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True):
        groups += (x not in up) + (y not in up and y != x)
        a, b = root(x), root(y)
        groups -= a != b
        up[a] = b
    return pa.table({"exec_id": [rows.column("exec_id")[0].as_py()], "linked": pa.array([len(up)], pa.int64()), "groups": pa.array([groups], pa.int64())})


def weakly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(exec_id, components): 1 where all its events hang together. Executions of up to SMALL edges are one task's work each."""
    small, large = _by_size(edges.select(KEY))
    joined = small.groupBy("exec_id").applyInArrow(_joined, "exec_id string, linked long, groups long")
    if large is not None:
        name = lambda c: F.struct("exec_id", F.col(c).alias("eid"))
        labels = connected_components(large.select(name("src").alias("a"), name("dst").alias("b")))
        joined = joined.unionByName(labels.groupBy(F.col("node.exec_id").alias("exec_id")).agg(F.count("*").alias("linked"), F.count_distinct("component").alias("groups")))
    counts = nodes.groupBy("exec_id").agg(F.count_distinct("eid").alias("events"))
    out = counts.join(joined, "exec_id", "left").na.fill(0, ["linked", "groups"])
    return out.select("exec_id", (F.col("events") - F.col("linked") + F.col("groups")).alias("components"))


def backward_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """KEY of the edges that do not go forward in the order of (ts, eid)."""
    at = nodes.select("exec_id", "eid", "ts")
    return edges.select(KEY).join(at.select("exec_id", F.col("eid").alias("src"), F.col("ts").alias("t1")), ["exec_id", "src"]).join(at.select("exec_id", F.col("eid").alias("dst"), F.col("ts").alias("t2")), ["exec_id", "dst"]).where("struct(t1, src) >= struct(t2, dst)").select(KEY)


def screening(nodes: DataFrame, edges: DataFrame, reach: DataFrame, objects: DataFrame, types: tuple[str, ...] = STRUCTURAL_TYPES) -> DataFrame:
    """One row an execution: sizes, degrees, connectivity, reducedness, repetitions, incomparable pairs, valid.

    reach and objects are those of instance_graph().

    valid: acyclic, weakly connected, every event on an edge, reduced, no suspicious repetition. An
    execution of one event is connected, but has an event on no edge.
    """
    out_d = edges.groupBy("exec_id", F.col("src").alias("eid")).agg(F.count("*").alias("out"))
    in_d = edges.groupBy("exec_id", F.col("dst").alias("eid")).agg(F.count("*").alias("in"))
    n = nodes.select("exec_id", "eid", "ts").join(out_d, ["exec_id", "eid"], "left").join(in_d, ["exec_id", "eid"], "left").na.fill(0, ["in", "out"])
    per_node = n.groupBy("exec_id").agg(
        F.count("*").alias("nodes"),
        F.sum("out").alias("edges"),
        F.count_if((F.col("in") == 0) & (F.col("out") > 0)).alias("sources"),
        F.count_if((F.col("out") == 0) & (F.col("in") > 0)).alias("sinks"),
        F.count_if((F.col("in") == 0) & (F.col("out") == 0)).alias("isolated"),
    )
    back = backward_edges(nodes, edges).groupBy("exec_id").agg(F.count("*").alias("backward"))
    needless = _with_needless(edges.select(KEY), reach).where("needless").groupBy("exec_id").agg(F.count("*").alias("needless"))
    repeats = suspicious_repetitions(objects, reach, types).groupBy("exec_id").agg(F.count("*").alias("suspicious"))
    bits = F.aggregate("ahead", F.lit(0).cast("long"), lambda n, word: n + F.bit_count(word))
    pairs = reach.groupBy("exec_id").agg(F.sum(bits).alias("ordered"))
    out = per_node.join(weakly_connected(nodes, edges), "exec_id")
    for part in (back, needless, repeats, pairs):
        out = out.join(part, "exec_id", "left")
    out = out.na.fill(0, ["backward", "needless", "suspicious", "ordered"])
    flags = {"is_dag": F.col("backward") == 0, "connected": F.col("components") == 1, "covered": F.col("isolated") == 0, "reduced": F.col("needless") == 0}
    out = out.withColumns(flags).withColumn("incomparable", (F.col("nodes") * (F.col("nodes") - 1) / 2 - F.col("ordered")).cast("long"))
    valid = F.col("is_dag") & F.col("connected") & F.col("covered") & F.col("reduced") & (F.col("suspicious") == 0)
    return out.withColumn("valid", valid).select("exec_id", "nodes", "edges", "sources", "sinks", "isolated", "is_dag", "connected", "covered", "reduced", "suspicious", "incomparable", "valid")


def execution_violations(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(exec_id, violation, eid): repeated events, blank activities, events without objects."""
    repeated = nodes.groupBy("exec_id", "eid").count().where("count > 1").select("exec_id", F.lit("repeated event").alias("violation"), "eid")
    blank = nodes.where("activity is null or trim(activity) = ''").select("exec_id", F.lit("blank activity").alias("violation"), "eid")
    bare = nodes.join(relations, "eid", "left_anti").select("exec_id", F.lit("no objects").alias("violation"), "eid")
    return repeated.unionByName(blank).unionByName(bare)


def require_valid(nodes: DataFrame, relations: DataFrame, edges: DataFrame | None = None) -> None:
    """A ValueError if there is no event, on execution_violations(), and on an edge that does not go forward: a cycle needs one."""
    if nodes.isEmpty():
        raise ValueError("an execution without events")
    bad = execution_violations(nodes, relations).orderBy("exec_id", "violation", "eid").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['exec_id']}: {bad[0]['violation']}, {bad[0]['eid']}")
    if edges is not None and (back := backward_edges(nodes, edges).orderBy(*KEY).limit(1).collect()):
        raise ValueError(f"{back[0]['exec_id']}: {back[0]['src']} to {back[0]['dst']} does not go forward")


def relevant_relations(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """(exec_id, otype, src_act, dst_act): accepted relations both of whose activities an execution has."""
    acts = nodes.select("exec_id", "activity").distinct()
    return acts.join(sized(accepted), acts["activity"] == accepted["src_act"]).drop("activity").join(acts.withColumnsRenamed({"exec_id": "x", "activity": "a"}), (F.col("x") == F.col("exec_id")) & (F.col("a") == F.col("dst_act"))).select("exec_id", "otype", "src_act", "dst_act")


def edge_differences(one: DataFrame, other: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per exec_id: edges of ``other`` that ``one`` lacks (missing), and the other way round (additional)."""
    keys = keys or KEY
    both = one.select(keys).distinct().withColumn("_1", F.lit(1)).join(other.select(keys).distinct().withColumn("_2", F.lit(1)), keys, "full_outer")
    out = both.groupBy("exec_id").agg(F.count_if(F.col("_1").isNull()).alias("missing"), F.count_if(F.col("_2").isNull()).alias("additional"))
    return out.withColumn("exact", (F.col("missing") == 0) & (F.col("additional") == 0))
