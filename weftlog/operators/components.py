"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.plans.scratch import materialize, measured

#: Edges of a partition that are joined to a forest at a time.
FOREST = 500_000


def _neighbour_min(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def joined(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the edges u-v, by hooking and jumping over whole arrays."""
    up = np.arange(n)
    while len(u):
        a, b = up[u], up[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to stars that join the same nodes, FOREST edges at a time: a partition hands on no more rows than it has nodes."""

    def shrunk(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(parts).combine_chunks()
        names = pc.unique(pa.chunked_array([*both.column("u").chunks, *both.column("v").chunks]))
        names = names.take(pc.sort_indices(names))
        place = [np.asarray(pc.index_in(both.column(c), names)) for c in ("u", "v")]
        up = joined(*place, len(names))
        inner = np.flatnonzero(up != np.arange(len(names)))
        return pa.record_batch([names.take(pa.array(inner)), names.take(pa.array(up[inner]))], ["u", "v"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FOREST:
            held = [shrunk(held)]
            if held[0].num_rows > FOREST // 2:  # a forest that stays large is handed on
                yield held.pop()
            rows = sum(b.num_rows for b in held)
    if held:
        yield shrunk(held)


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, strings or integers, that join the same nodes as edges (u, v): each partition's, shrunk to stars before anything is dealt out."""
    kind = edges.schema["u"].dataType.simpleString()
    return edges.mapInArrow(_forest, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, local: bool = False, report: list[int] | None = None) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternating star contraction: in a large-star step every neighbour larger than a node is
    hooked to the smallest neighbour, in a small-star step the smaller neighbours and the node
    itself are. The edges shrink to stars in a number of rounds logarithmic in practice, and a
    node with very many neighbours is only ever aggregated with min() and joined, never
    gathered in one row. Null ends and loops are ignored; repeated edges count once. The rounds
    are separated by tables in the shared folder.

    With ``local`` each partition joins its edges to a forest of stars first, so that no more rows are dealt out than
    partitions have nodes, and if no more than FOREST are left, one task joins those: there are no rounds then.
    ``report`` gets the number of edges before each round, and after the last.
    """
    e = (
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    )
    report = [] if report is None else report
    count = F.count("*").alias("n")
    e, seen = measured(forest(e) if local else e.distinct(), "cc-edges", count)
    report.append(seen["n"])
    if local and seen["n"] <= FOREST:
        e, seen = measured(forest(e.coalesce(1)), "cc-stars", count)
        report.append(seen["n"])
        return _labels(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_neighbour_min(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        small = (
            large.join(_neighbour_min(large), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where("u <> v")
            .distinct()
        )
        # hashes are summed as decimals: order-insensitive, no overflow
        e, now = measured(small, "cc-edges", count, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash"))
        report.append(now["n"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _labels(e)


def _labels(stars: DataFrame) -> DataFrame:
    ends = [stars.select(F.col(c).alias("node"), F.col("v").alias("component")) for c in ("u", "v")]
    return ends[0].unionByName(ends[1].distinct())
