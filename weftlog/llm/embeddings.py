"""Embedding near-dedup by an exact metric range join (operator 6).

Vectors are scaled to length one, where cosine >= c is the same as a distance of at most
r = sqrt(2 - 2c). The steps:

1.  Equal vectors of one label form a class; copies are counted, not paired.
2.  Pivots, a bounded sample of the vectors, divide the sphere into cells: a vector is at home with
    its nearest pivot. By the triangle inequality a vector within r of some vector at home with
    pivot p has (d(x, p)^2 - d(x, home)^2) <= 2 r d(p, home): it is copied to just the cells where
    that holds. The number of pivots is the one, of powers of two up to a bound, that makes the
    fewest comparisons on the sample while a vector is in MAX_COPIES cells at most on average; it is
    one where more would not halve the comparisons. Where vectors are spread so evenly that every
    cell borders on all others, that is so, and the blocks of step 3 are all there is to divide the work.
3.  Cells join independently: each cell (of a label) is cut into blocks in the order of the distance
    to its pivot, and a block is one row of packed vectors. Two blocks are compared once, as one
    matrix product in double precision, unless their distances differ by more than r (the triangle
    inequality again). All partners of a vector are in its home cell, where its links are
    counted. A group of near copies as large as the table makes many block pairs, never one large
    task, and gives for each block pair only counts and the links of a spanning forest.
4.  Components of the links and of the copies.

Rounding: products close to the threshold are summed again exactly before they are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.operators.components import connected_components
from weftlog.plans.ordered import running
from weftlog.plans.scratch import materialize, passing_tables
from weftlog.plans.sizing import sized

#: Rows of a block, rows of the sample that pivots and their number are taken from, most pivots, most copies of a vector on average.
BLOCK, SAMPLE, MAX_PIVOTS, MAX_COPIES = 4096, 4000, 1024, 8.0
_MARGIN = 1e-9


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, unit (binary, doubles; null where the vector or label can't link) and set_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units: list[bytes | None] = []
            for v, label in zip(batch.column("embedding"), batch.column("label"), strict=True):
                unit = None
                if label.is_valid and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and (big := np.abs(x).max()) > 0:
                        x = x / big  # no overflow in squares
                        unit = (x / math.sqrt(math.fsum((x * x).tolist()))).tobytes()
                units.append(unit)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(units, pa.binary())], ["vec_id", "label", "unit"])

    kind, label = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    out = rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind}, label {label}, unit binary")
    return out.withColumn("set_key", F.xxhash64("label", "unit"))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * np.clip(x @ pivots.T, -1, 1)))


def _cells(x: np.ndarray, pivots: np.ndarray, radius: float, d: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and by pivot whether the row has to be in its cell; d: the distances, where known."""
    d = _angles(x, pivots) if d is None else d
    home = d.argmin(1)
    own = d[np.arange(len(x)), home][:, None]
    between = _angles(pivots, pivots)[home]
    return home, d * d - own * own <= 2 * radius * between + _MARGIN


def choose_pivots(sample: np.ndarray, radius: float, most: int = MAX_PIVOTS) -> np.ndarray:
    """The first 2**k vectors of the sample, k such that the expected comparisons are fewest; one unless that halves them."""
    best, cost, n = sample[:1], float(len(sample)) ** 2 / 2, 2
    while n <= min(most, len(sample)):
        home, inside = _cells(sample, sample[:n], radius)
        here = float(np.bincount(home, minlength=n) @ inside.sum(0)) + len(sample) * n
        if here < cost and inside.sum() <= MAX_COPIES * len(sample):
            best, cost = sample[:n], here
        n *= 2
    return best


def _exactly(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    return math.fsum((x * y).tolist()) >= least


def _links(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    hit = np.empty((len(x), len(y)), bool)
    for k in range(0, len(x), 512):
        cos = x[k : k + 512] @ y.T
        hit[k : k + 512] = cos >= least
        for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12), strict=True):
            hit[k + i, j] = _exactly(x[k + i], y[j], least)
    return hit


def near_duplicates(rows: DataFrame, least: float = 0.93, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of rows (vec_id, label, embedding).

    Rows of equal label (not null) are linked when the cosine of their vectors is at least
    ``least``. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Vectors that repeat a vec_id share a
    component and the links of all of them; a null vec_id takes no part and is kept with a null
    component. Other columns are ignored; an
    empty table gives an empty result.
    """
    with passing_tables(rows.sparkSession):
        return materialize(_near_duplicates(rows, least, block, sample), "vector-components", keep=True)


def _near_duplicates(rows: DataFrame, least: float, block: int, sample: int) -> DataFrame:
    kind, label_kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    units = materialize(unit_vectors(rows), "vectors")
    able = units.where("unit is not null and vec_id is not null")
    classes = materialize(able.groupBy("label", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("dim", F.length("unit")), "vector-classes")
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    # pivots by length of vector, from a sample that a hash orders
    pivots = {}
    for d in [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").limit(100).collect()]:
        got = classes.where(F.col("dim") == d).select("unit").orderBy(F.xxhash64("unit"), "unit").limit(sample).collect()
        pivots[d] = choose_pivots(np.stack([np.frombuffer(r["unit"], np.float64) for r in got]), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = np.stack([np.frombuffer(u, np.float64) for u in part.column("unit").to_pylist()])
                far = _angles(x, pivots[d]) if d in pivots else np.zeros((len(x), 1))
                home, inside = _cells(x, pivots[d], radius, far) if d in pivots else (np.zeros(len(x), int), np.ones((len(x), 1), bool))
                row, cell = np.nonzero(inside)
                for k in range(0, len(row), 10_000):  # no batch grows with the copies
                    r, c = row[k : k + 10_000], cell[k : k + 10_000]
                    out = part.take(pa.array(r, pa.int64()))
                    yield pa.record_batch([*out.columns, pa.array(c, pa.int32()), pa.array(home[r] == c), pa.array(far[r, c])], [*batch.schema.names, "cell", "home", "far"])

    schema = f"label {label_kind}, unit binary, vec_id {kind}, n long, dim int, cell int, home boolean, far double"
    dealt = classes.select("label", "unit", "vec_id", "n", "dim").mapInArrow(deal, schema).withColumn("one", F.lit(1)).withColumnRenamed("n", "copies")
    # ranks over all cells in their order: a block is a stretch of ranks within a cell
    ranked = running(dealt, ["label", "dim", "cell", "far", "vec_id", "unit"], "one").withColumn("block", F.floor((F.col("rank") - 1) / block))
    cell = ["label", "dim", "cell"]

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        column = {c: group.column(c) for c in group.column_names}
        far = np.array(column["far"])
        one = {c: column[c][:1].combine_chunks() for c in (*cell, "block")}
        one["ids"] = pa.ListArray.from_arrays(pa.array([0, group.num_rows], pa.int32()), column["vec_id"].combine_chunks())
        one["n"] = pa.array([np.array(column["n"], np.int64).tobytes()])
        one["home"] = pa.array([np.array(column["home"], bool).tobytes()])
        one["units"] = pa.array([b"".join(column["unit"].to_pylist())], pa.binary())
        one |= {"lo": pa.array([far.min()]), "hi": pa.array([far.max()])}
        return pa.table(one)

    packed = ranked.select(*cell, "block", "vec_id", F.col("copies").alias("n"), "home", "unit", "far").groupBy(*cell, "block")
    packed = materialize(packed.applyInArrow(pack, f"label {label_kind}, dim int, cell int, block long, ids array<{kind}>, n binary, home binary, units binary, lo double, hi double"), "vector-blocks")
    ends = packed.select(*cell, "block", "lo", "hi")
    p, q = (ends.select(*cell, *[F.col(c).alias(f"{c}{k}") for c in ("block", "lo", "hi")]) for k in (1, 2))
    near = p.join(q, cell).where((F.col("block1") <= F.col("block2")) & (F.col("lo2") - F.col("hi1") <= radius + _MARGIN))
    pairs = near.select(*cell, F.col("block1").alias("p"), F.col("block2").alias("q"), F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
    sent = packed.drop("lo", "hi").join(sized(materialize(pairs, "vector-pairs")), [*cell, "block"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        ids, n, home, x = [], [], [], []
        for r in group.itertuples():
            ids.append(np.asarray(r.ids))
            n.append(np.frombuffer(r.n, np.int64))
            home.append(np.frombuffer(r.home, bool))
            x.append(np.frombuffer(r.units, np.float64).reshape(len(ids[-1]), -1))
        i, j = ids[0], ids[-1]
        out = {"a": [], "b": [], "n": []}
        hit = _links(x[0], x[-1], least)
        hit &= i[:, None] != j[None, :]
        rows_, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if len(rows_):
            sub = hit[np.ix_(rows_, cols)]
            found, inverse = np.unique(np.concatenate([i[rows_], j[cols]]), return_inverse=True)
            at_row, at_col, root = inverse[: len(rows_)], inverse[len(rows_) :], np.arange(len(found))
            while True:  # smallest index reachable, by rounds
                before, far = root.copy(), len(found)
                np.minimum.at(root, at_row, np.where(sub, root[at_col][None, :], far).min(1))
                np.minimum.at(root, at_col, np.where(sub, root[at_row][:, None], far).min(0))
                root = root[root]
                if (root == before).all():
                    break
            linked = np.flatnonzero(root != np.arange(len(found)))
            own = home[0][rows_]
            counted = [(i[rows_][own], (sub @ n[-1][cols])[own])]
            if len(ids) == 2:  # a block that meets itself has counted all its rows
                own = home[1][cols]
                counted.append((j[cols][own], (n[0][rows_] @ sub)[own]))
            a, k = (np.concatenate([c[m] for c in counted]) for m in (0, 1))
            out["a"] = [*a, *found[linked]]
            out["b"] = [None] * len(a) + list(found[root[linked]])
            out["n"] = [*k, *[0] * len(linked)]
        dtype = "Int64" if i.dtype.kind == "i" else object
        return pd.DataFrame({"a": pd.Series(out["a"], dtype=dtype), "b": pd.Series(out["b"], dtype=dtype), "n": pd.Series(out["n"], dtype="int64")})

    found = sent.groupBy(*cell, "p", "q").applyInPandas(compare, f"a {kind}, b {kind}, n long")
    found = materialize(found, "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    reps = classes.select("label", "unit", F.col("vec_id").alias("rep"), "n").join(counts, F.col("rep") == F.col("a"), "left").drop("a")
    whole = materialize(able.join(reps, ["label", "unit"]).select("vec_id", "rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "vector-counts")
    edges = found.where("b is not null").select("a", "b").unionByName(whole.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    components = connected_components(edges).withColumnsRenamed({"node": "vec_id"})
    linked = whole.select("vec_id", "n_links").unionByName(units.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    root = F.coalesce("component", "vec_id")
    return linked.join(components, "vec_id", "left").select("vec_id", "n_links", root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))


#: The same by comparing all pairs of a label.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS m FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.m * b.m) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
