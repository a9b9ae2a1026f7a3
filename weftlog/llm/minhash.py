"""MinHash near-dedup by a signature-coordinate inverted join (operator 10).

Every distinct set of word shingles gets a signature of K minima. A (coordinate, value) pair is a
token, and a signature is a set of exactly K tokens, so two signatures that agree in at least T
coordinates share a token among the first K - T + 1 of each in any common order of tokens, and M
tokens among the first K - T + M. The order here is rarest first, which keeps the posting lists
short. The steps:

1.  One pass over the texts: shingle hashes, a 128-bit key of the whole set, the signature. Equal
    sets form a class, and only its smallest document goes on: copies are never paired.
2.  Token counts; the prefix of each signature is posted under its tokens. A token that only one
    signature has links nothing, so only shared ones are posted.
3.  Lists of up to ``short_list`` signatures are merged: the collisions of each pair are counted,
    skipping pairs whose set sizes already rule the threshold out. Longer lists are skipped, so a
    pair stays if its collisions and the skipped lists in its prefixes can make M. Pairs that meet
    in a longer list of the first K - T + 1 come from there: every member is linked with the member
    whose tokens are the most frequent (the hub) first, a number of pairs linear in the list.
4.  Candidates that agree in at least T coordinates are confirmed on the full shingle sets, which
    are read again for the documents concerned only.
5.  Longer lists whose members are by then not all in one component are compared block by block,
    pairs of different components only: first on signatures, then, for the documents that still
    have a possible partner, on the full sets. No list is capped; no pair that could link two
    components is left out.
6.  Components of copies and confirmed links.

T follows from the threshold: the largest for which a pair that just reaches it is missed with a
chance of MISS at most, and less at any larger J (39 of 64 at 0.85, 34 at 0.80). A shingle is a
64-bit hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import Powers, shingles, word_hashes
from weftlog.operators.components import connected_components
from weftlog.plans.scratch import materialize, passing_tables
from weftlog.plans.sizing import sized

#: Coordinates of a signature, and the chance at most that a pair at the threshold agrees in too few of them.
K, MISS = 64, 1e-6
SHORT_LIST, BLOCK = 24, 512
#: Collisions that a pair needs within the prefixes, which are longer by one less than that.
MEETINGS = 3
_FACTORS = np.random.default_rng(98317).integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_agreement(percent: int) -> int:
    """T: the most coordinates that a pair at the threshold agrees in with a chance of 1 - MISS."""
    p, missed, t = percent / 100, 0.0, 0
    while t < K and (missed := missed + math.comb(K, t) * p**t * (1 - p) ** (K - t)) <= MISS:
        t += 1
    if not t:
        raise ValueError(f"{K} coordinates are too few for a threshold of {percent} percent")
    return t


def signature(x: np.ndarray) -> np.ndarray:
    """K minima of a set of 64-bit hashes, in blocks that stay in cache."""
    out = np.full(K, 2**64 - 1, np.uint64)
    for k in range(0, len(x), 512):
        np.minimum(out, (x[k : k + 512, None] * _FACTORS).min(axis=0), out=out)
    return out


def _sets(batch: pa.RecordBatch, n_words: int, powers: Powers) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield shingles(word_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", powers), n_words)


def _key(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) for each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            n, keys, sig = [], [], []
            for x in _sets(batch, n_words, powers):
                n.append(len(x))
                keys.append(_key(x))
                sig.append(signature(x).view(np.int64) if len(x) else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "signature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, signature array<long>")


def _sets_of(docs: DataFrame, reps: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, shingles) for the classes named in ids: their texts are read and hashed again.

    Up to a number of ids that is counted, texts are not shuffled for that.
    """
    wanted = sized(materialize(reps.join(ids.distinct(), "doc_id", "left_semi").select("doc_id", "set_key"), "minhash-wanted"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keep, sets = [], []
            for k, (x, key) in enumerate(zip(_sets(batch, n_words, powers), batch.column("set_key").to_pylist(), strict=True)):
                if _key(x) == key:  # a doc_id may stand on several rows
                    keep.append(k)
                    sets.append(x.tobytes())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(again, f"doc_id {kind}, shingles binary")
    return materialize(sets.dropDuplicates(["doc_id"]), "minhash-sets")


def _confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = _sets_of(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), n_words)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                same = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}")


def _size_ok(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 85, short_list: int = SHORT_LIST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (columns doc_id and text).

    Documents are linked when 100 * intersection >= percent * union of their word shingles, and
    component_id is the smallest doc_id reachable by links. Null and empty texts, and texts of
    white space, have no shingles and are linked with nothing. Rows of one doc_id count as one
    document with the links of all its texts. A null doc_id stands alone: its component is null
    and it is kept. Further columns of docs are ignored; an empty table gives an empty result.
    """
    with passing_tables(docs.sparkSession):
        return materialize(_near_duplicates(docs, n_words, percent, short_list), "minhash-components", keep=True)


def _near_duplicates(docs: DataFrame, n_words: int, percent: int, short_list: int) -> DataFrame:
    kind, least = docs.schema["doc_id"].dataType.simpleString(), least_agreement(percent)
    sig = materialize(signatures(docs, n_words), "minhash-signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    reps = materialize(classes, "minhash-classes")
    # 2. postings of the prefixes, rarest tokens first
    tokens = reps.select("doc_id", "n", F.posexplode("signature").alias("i", "v")).select("doc_id", "n", F.xxhash64("i", "v").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    need = min(MEETINGS, least)
    prefix = (
        tokens.join(shared, "token")
        .groupBy("doc_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("ts"), F.sum("freq").alias("weight"))
        .withColumn("size", F.size("ts"))
        .withColumn("ts", F.slice("ts", 1, F.greatest(F.lit(0), F.col("size") - least + need)))
        .withColumn("skipped", F.size(F.filter("ts", lambda t: t["freq"] > short_list)))
        .select("doc_id", "n", "weight", "size", "skipped", F.posexplode("ts").alias("k", "t"))
        .select("doc_id", "n", "weight", "skipped", (F.col("k") <= F.col("size") - least).alias("first"), "t.freq", "t.token")
    )
    posts = materialize(prefix, "minhash-postings")
    # 3. short lists are merged by counting; pairs of hub and member of long ones
    lists = posts.where(F.col("freq") <= short_list)
    p, q = (lists.select("token", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("skipped").alias(f"skipped{x}")) for x in "ab")
    met = p.join(q, "token").where(f"a < b and {_size_ok('na', 'nb', percent)}").groupBy("a", "b")
    met = met.agg(F.count("*").alias("collisions"), F.max("skippeda").alias("skippeda"), F.max("skippedb").alias("skippedb"))
    pairs = met.where(F.col("collisions") + F.least("skippeda", "skippedb") >= need).select("a", "b")
    long = posts.where((F.col("freq") > short_list) & F.col("first"))
    hubs = long.groupBy("token").agg(F.max(F.struct("weight", -F.xxhash64("doc_id"), "doc_id", "n")).alias("h")).select("token", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("nh"))
    spokes = (
        long.join(hubs, "token")
        .where(f"doc_id <> hub and {_size_ok('n', 'nh', percent)}")
        .select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))
        .distinct()
    )
    # 4. counted collisions, then full sets
    half = [reps.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab"]
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    counted = pairs.unionByName(spokes).distinct().join(half[0], "a").join(half[1], "b").where(same >= least).select("a", "b")
    links = materialize(_confirm(docs, reps, materialize(counted, "minhash-candidates"), n_words, percent), "minhash-links")
    # 5. long lists that are still in several components
    labels = connected_components(links)
    labelled = long.select("token", "doc_id", "n").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    labelled = materialize(labelled.select("token", "doc_id", "n", "label"), "minhash-labelled")
    split = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    members = materialize(labelled.join(split.select("token"), "token"), "minhash-unsettled")
    more = _blocks(docs, reps, members, n_words, percent, least)
    # 6. components of copies and links
    copies = sig.where("n_shingles > 0").join(reps.select("set_key", F.col("doc_id").alias("rep")), "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = connected_components(links.unionByName(more).unionByName(copies))
    found = sig.select("doc_id", "n_shingles").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    root = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"))


def _shared(sets: list[np.ndarray], at: int) -> np.ndarray:
    """Sizes of the intersections of sets[:at] with sets[at:], by products of 0/1 matrices."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(column) > 1  # what one set alone has is in no intersection
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column, out = row[order], column[order], np.zeros((at, len(sets) - at), np.float32)
    for k in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(column, (k, k + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[lo:hi], column[lo:hi] - k] = 1
        out += m[:at] @ m[at:].T
    return out


def _block_pairs(members: DataFrame) -> DataFrame:
    """members (token, doc_id, n, label) once for every pair of blocks of their list: with p, q and left.

    A label with many members in a list has blocks of its own, the others share blocks by a hash of the label,
    and two blocks of one and the same label are no pair: what a list costs is its members times those
    outside its largest component, in blocks of about BLOCK rows.
    """
    sizes = members.groupBy("token", "label").agg(F.count("*").alias("size"))
    small = sizes.where(F.col("size") < BLOCK // 2).groupBy("token").agg(F.ceil(F.sum("size") / BLOCK).alias("shared"))
    own = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / BLOCK))
    block = F.when(F.col("size") < BLOCK // 2, F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("label"), F.col("shared")))).otherwise(F.xxhash64(F.lit("own"), "label", own))
    dealt = members.join(sizes, ["token", "label"]).join(small, "token", "left").withColumn("block", block).select("token", "doc_id", "n", "label", "block")
    dealt = materialize(dealt, "minhash-dealt")
    blocks = materialize(dealt.groupBy("token", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "minhash-blocks")
    one, two = (blocks.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("block", "lo", "hi")]) for k in (1, 2))
    pairs = one.join(two, "token").where("block1 <= block2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)").select("token", F.col("block1").alias("p"), F.col("block2").alias("q"))
    left = dealt.join(pairs.withColumn("block", F.col("p")), ["token", "block"]).withColumn("left", F.lit(True))
    right = dealt.join(pairs.where("p <> q").withColumn("block", F.col("q")), ["token", "block"]).withColumn("left", F.lit(False))
    columns = ["token", "p", "q", "left", "doc_id", "n", "label"]
    return left.select(columns).unionByName(right.select(columns))


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the left and the right rows; the same ones where a block meets itself."""
    left = np.flatnonzero(group["left"])
    return left, left if group["p"].iloc[0] == group["q"].iloc[0] else np.flatnonzero(~group["left"])


def _blocks(docs: DataFrame, reps: DataFrame, members: DataFrame, n_words: int, percent: int, least: int) -> DataFrame:
    """Links between different labels within a token's list, found block against block.

    First signatures are compared, and each pair of blocks names the documents that agree with another in at
    least T coordinates, have sizes that allow the threshold and a different label. The full sets of these
    alone are then compared. A pair of blocks gives only as many links as it takes to join what it
    finds linked.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = materialize(_block_pairs(members), "minhash-block-rows")

    def promising(group: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(group)
        hit = np.zeros(len(group), bool)
        if len(left) and len(right) and group["label"].nunique() > 1:
            sig, n, label = np.stack(group["signature"].to_numpy()), group["n"].to_numpy(), group["label"].to_numpy()
            for k in range(0, len(left), 64):
                rows = left[k : k + 64]
                ok = (sig[rows][:, None, :] == sig[right][None, :, :]).sum(2) >= least
                low, high = np.minimum.outer(n[rows], n[right]), np.maximum.outer(n[rows], n[right])
                ok &= (100 * low >= percent * high) & (label[rows][:, None] != label[right][None, :])
                hit[rows] |= ok.any(1)
                hit[right] |= ok.any(0)
        return group.loc[hit, ["token", "p", "q", "left", "doc_id", "n", "label"]]

    rows = dealt.join(reps.select("doc_id", "signature"), "doc_id")
    some = rows.groupBy("token", "p", "q").applyInPandas(promising, dealt.schema)
    some = materialize(some, "minhash-promising")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable").reset_index(drop=True)
        left, right = _sides(group)
        out: list[tuple] = []
        if len(left) and len(right):
            sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
            n, label, ids = group["n"].to_numpy(), group["label"].to_numpy(), group["doc_id"].to_numpy()
            same = _shared([sets[k] for k in (*left, *right)], len(left))
            ok = (100 * same >= percent * (n[left][:, None] + n[right][None, :] - same)) & (label[left][:, None] != label[right][None, :])
            up = {x: x for x in label}

            def root(x):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for i, j in zip(*np.nonzero(ok), strict=True):
                x, y = root(label[left[i]]), root(label[right[j]])
                if x != y:
                    up[x] = y
                    out.append((ids[left[i]], ids[right[j]]))
        return pd.DataFrame({c: pd.Series([x[k] for x in out], dtype=group["doc_id"].dtype) for k, c in enumerate("ab")})

    whole = some.join(_sets_of(docs, reps, some.select("doc_id"), n_words), "doc_id")
    return whole.groupBy("token", "p", "q").applyInPandas(compare, f"a {kind}, b {kind}")
