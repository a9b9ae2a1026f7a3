"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (operator 5).

1.  Sizes (words) are summed by source, and targets are shared out by weight; a target stops at
    ``cap`` times its source's size and the excess goes to the others by weight.
2.  Each source is dealt into blocks by a hash of its documents. A target is some whole passes over
    the source and a rest: blocks in permuted order that fit into the rest, then the one block left
    whose size comes nearest to the gap. That gives an exact number of blocks, the quota of the source.
3.  The splitting tree: all quotas are at the root; a node's left half of the output shards gets a
    multivariate-hypergeometric draw from the node's quotas, the right half what is left, down to
    single shards. So every shard has the composition that one global shuffle of the blocks would
    give it, and quotas are met exactly.
4.  A shard takes the next stretch of each source's permuted blocks, disjoint from the others', and
    its documents are put in a random order within the shard alone.

Blocks are hash buckets, so a source with a third of all rows is spread over as many keys as it has
blocks. Sizes are first summed by small buckets; how many of them make a block, and how many shards
there are, follows from the sums. The quota tree has a number for each source and shard that meet, at
most one for each block that is taken; no rows of documents ever meet on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import BLANKS, pieces
from weftlog.plans.scratch import materialize, passing_tables
from weftlog.plans.sizing import sized

#: Words of a block of the whole and of a shard, where the numbers of both lie within their bounds.
BLOCK_WORDS, SHARD_WORDS = 1 << 16, 1 << 22
#: Blocks of a source: the least, and the number of small buckets, the most. Shards at most.
LEAST_BLOCKS, MOST_BLOCKS, MOST_SHARDS = 1 << 11, 1 << 16, 1 << 16
#: The seed of permutations and draws, sources that a mix may have, rows of a plan that is broadcast (under 100 bytes each).
SEED, MAX_SOURCES, BROADCAST_ROWS = 20240607, 100_000, 500_000
#: Rounds in which blocks are looked for that still fit.
FILLS = 4


def size_of(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space (null: 0)."""
    return F.size(pieces(text, BLANKS)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources stand by code point, null last, and take the weights in turn. With the sources in
    order of cap * size / weight, those before some place are capped: the first k for which the
    rest, shared by weight, leaves the next one below its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(order) - 1) % len(weights)
    w = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("long"))
    w = w.withColumn("limit", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("total", F.sum("source_size").over(everything) * share).withColumn("all", F.sum("weight").over(everything))
    w = w.withColumn("level", (F.col("total") - F.col("used")) / (F.col("all") - F.col("gone")))
    # the level holds from the first source on that it leaves at or below its cap
    w = w.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("gone"), F.col("level")))).over(everything)["level"])
    return w.select("source", "source_size", "weight", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("final")).alias("target"))


def _key(source: Column) -> Column:
    """The source as a string that is not null; null is apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def block_of(docs: DataFrame, blocks: int, seed: int) -> Column:
    """The block of a row: a hash of its doc_id and text, spread over the blocks."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(blocks)).cast("int")


def choose_blocks(sized: DataFrame, wanted: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, block, passes, extra): how often each block is taken whole, and whether once more.

    sized: (key, block, words); wanted: (key, source_size, target). A round takes blocks in permuted order
    as long as they fit into what the rounds before have left, passing over those that are larger than
    all of that; after the last, one block is added if that comes nearer to the target.
    """
    b = sized.join(wanted, "key").withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    b = b.withColumn("gap", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("in", F.lit(False))
    permuted = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key")
    for _ in range(FILLS):
        # without a gap nothing is taken once more, not even a block without words
        fits = ~F.col("in") & (F.col("words") <= F.col("gap")) & (F.col("gap") > 0)
        b = b.withColumn("upto", F.when(fits, F.sum(F.when(fits, F.col("words")).otherwise(0)).over(permuted)))
        b = b.withColumn("new", F.coalesce(F.col("upto") <= F.col("gap"), F.lit(False)))
        b = b.withColumn("gap", F.col("gap") - F.coalesce(F.max(F.when(F.col("new"), F.col("upto"))).over(whole), F.lit(0))).withColumn("in", F.col("in") | F.col("new"))
    out = F.when(~F.col("in"), F.struct(F.abs(F.col("gap") - F.col("words")).alias("off"), F.col("block")))
    b = b.withColumn("best", F.min(out).over(whole))
    top_up = (F.col("best.block") == F.col("block")) & ~F.col("in") & (F.col("best.off") < F.col("gap"))
    return b.select("key", "block", "passes", F.coalesce(F.col("in") | top_up, F.lit(False)).alias("extra"))


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The splitting tree: quotas of the sources to (source, shard, quota), without the zeros, in order of shard and source.

    Shards get equal numbers of blocks, give or take one. A node draws from a generator of its own
    seed, so that the outcome depends on nothing but the quotas, the shards and the seed.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = sum(quotas)
    edge = [total * k // shards for k in range(shards + 1)]

    def node(lo: int, hi: int, source: np.ndarray, have: np.ndarray) -> None:
        source, have = source[have > 0], have[have > 0]
        if not len(source):
            return
        if hi - lo == 1:
            out.append((source, np.full(len(source), lo), have))
            return
        mid = (lo + hi) // 2
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, edge[mid] - edge[lo], method="marginals")
        node(lo, mid, source, draw)
        node(mid, hi, source, have - draw)

    node(0, shards, np.arange(len(quotas)), np.array(quotas, np.int64))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _within(n: float, least: int, most: int) -> int:
    """The power of two that is not below n, within bounds that are such powers."""
    return min(most, max(least, 1 << max(0, math.ceil(n) - 1).bit_length()))


def _placed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, blocks: int | None = None, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, int]:
    """placed() and the number of shards."""
    spark = docs.sparkSession
    named = docs.withColumns({"mix_size": size_of(F.col("text")), "mix_key": _key(F.col("source")), "mix_bucket": block_of(docs, blocks or MOST_BLOCKS, seed)})
    buckets = named.groupBy("source", F.col("mix_bucket").alias("bucket")).agg(F.sum("mix_size").alias("words")).withColumn("key", _key(F.col("source")))
    buckets = materialize(buckets, "mix-buckets")
    per_source = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = materialize(targets(per_source, weights, share, cap).withColumn("key", _key(F.col("source"))), "mix-targets")
    whole = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("taken")).first()
    blocks = blocks or _within(whole["words"] / BLOCK_WORDS, LEAST_BLOCKS, MOST_BLOCKS)
    shards = shards or min(MOST_SHARDS, max(1, math.ceil(whole["taken"] / SHARD_WORDS)))
    per_block = buckets.groupBy("key", (F.col("bucket") % blocks).alias("block")).agg(F.sum("words").alias("words"))
    chosen = materialize(choose_blocks(per_block, goal.select("key", "source_size", "target"), seed), "mix-chosen")
    # each source's taken blocks in permuted order; a pass is a permutation of its own
    tokens = chosen.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("passes") + F.col("extra").cast("int"))).alias("copy")).where("copy > 0")
    tokens = materialize(tokens.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("copy", F.xxhash64(F.lit(seed + 2), "key", "copy", "block"), "block"))), "mix-tokens")
    quotas = tokens.groupBy("key").agg(F.count("*").alias("n")).orderBy("key").limit(MAX_SOURCES + 1).collect()
    if len(quotas) > MAX_SOURCES:
        raise ValueError(f"a mix may have {MAX_SOURCES} sources")
    source, shard, n = split_quotas([q["n"] for q in quotas], shards, seed)
    drawn = spark.createDataFrame(pa.table({"number": pa.array(source, pa.int32()), "shard": pa.array(shard, pa.int32()), "n": pa.array(n, pa.int64())}))
    names = spark.createDataFrame([(k, q["key"]) for k, q in enumerate(quotas)], "number int, key string")
    before = F.sum("n").over(Window.partitionBy("number").orderBy("shard")) - F.col("n")
    stretches = drawn.withColumn("lo", before + 1).join(F.broadcast(names), "number")
    by_place = stretches.select("key", "shard", F.explode(F.sequence(F.col("lo").cast("int"), (F.col("lo") + F.col("n") - 1).cast("int"))).alias("at"))
    by_block = tokens.join(by_place, ["key", "at"]).groupBy("key", "block").agg(F.sort_array(F.collect_list("shard")).alias("mix_shards"))
    plan = materialize(by_block.withColumnsRenamed({"key": "mix_key", "block": "mix_block"}), "mix-plan", keep=True)
    goal = materialize(goal.select(F.col("key").alias("mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")), "mix-goal", keep=True)
    at_block = named.withColumn("mix_block", F.col("mix_bucket") % blocks).drop("mix_bucket")
    out = at_block.join(sized(plan, BROADCAST_ROWS), ["mix_key", "mix_block"], "left").join(sized(goal), "mix_key", "left").drop("mix_key", "mix_block")
    return out.withColumn("mix_shards", F.coalesce("mix_shards", F.array().cast("array<int>"))), shards


def placed(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs once, with mix_size, mix_source_size, mix_target and mix_shards.

    mix_shards is an array of the output shards that take the row, one entry for each time it is
    taken (none: the mix leaves it out; at most ``cap``). A null or empty text has size 0. A null
    source is a source of its own, last in order. Columns of docs stay as they are; ties and
    repeated rows go the same way, as a block is a hash of doc_id and text. An empty table, and
    one whose texts have no words, gives targets of 0. Options are weights, share, cap, seed, and
    the numbers of blocks of a source and of shards, which otherwise follow from the sizes.
    """
    with passing_tables(docs.sparkSession):
        return _placed(docs, **options)[0]


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: columns of docs and mix_shard, a row for each time it is taken, a partition for each shard, shuffled within it.

    For nulls, ties and empty tables see placed(); an empty table gives no rows.
    """
    with passing_tables(docs.sparkSession):
        rows, shards = _placed(docs, seed=seed, **options)
    taken = rows.select(*docs.columns, F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    order = F.xxhash64(F.lit(seed + 3), "doc_id", "mix_copy", "mix_shard")
    return taken.repartitionById(shards, F.col("mix_shard")).sortWithinPartitions(order).drop("mix_copy")


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; see placed()."""
    return placed(docs.select("doc_id", "text", "source"), **options).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.coalesce("mix_source_size", F.lit(0)).alias("source_size"),
        F.coalesce("mix_target", F.lit(0.0)).alias("target"),
        (F.col("mix_size") * F.coalesce(F.size("mix_shards"), F.lit(0))).alias("taken"),
    )
