"""Merkle manifest of a dataset (operator 12), with the upper tree built on the driver and broadcast.

Each row is a leaf, a digest of its fields. The leaves of a group (a language) stand in order of their id,
and every ARITY consecutive nodes become their parent until one is left, the group's root; the groups' roots,
in order of the group's name, become the root of the dataset in the same way.

Leaves are ranked over ranges of (group, id), so a group of any size is cut into blocks of ARITY**height
leaves. A first pass reduces every block to its root in tasks. The block roots, at most TOP of them, are the
leaves of a small tree that the driver builds and broadcasts. In a second pass tasks finish the paths of
their blocks with it: every row gets its siblings up to the root, and is folded along them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from weftlog.llm.common import ascii_lower
from weftlog.plans.ordered import running
from weftlog.plans.scratch import materialize, measured, passing_tables

#: Nodes that become one, the least and the most levels of a block, and the block roots that the driver may hold.
#: The height follows from the number of rows; at the most, blocks of 262,144 leaves, they are enough for 6 * 10**10 rows.
ARITY, LOW, HIGH, TOP = 8, 4, 6, 262_144

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_HEX = 64


def leaf_of(fields: Iterable[Column]) -> Column:
    """The digest of fields: each is `-` if null, otherwise its length in bytes, a colon, and its value."""
    one = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*one), 256)


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def grown(nodes: list[bytes], height: int | None = None) -> list[list[bytes]]:
    """The runs of each level over nodes, up to ``height`` levels (None: until one node is left); the last entry is the nodes on top."""
    out: list[list[bytes]] = []
    while len(nodes) > 1 if height is None else len(out) < height:
        runs = [b"".join(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]
        out.append(runs)
        nodes = [digest(r) for r in runs]
    return [*out, nodes]


def path(levels: list[list[bytes]], k: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after node k, and after the nodes over it, in their runs."""
    out = []
    for runs in levels[:-1]:
        run, at = runs[k // ARITY], _HEX * (k % ARITY)
        out.append((run[:at], run[at + _HEX :]))
        k //= ARITY
    return out


def fold(leaf: bytes, siblings: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in siblings:
        leaf = digest(before + leaf + after)
    return leaf


def _levels_needed(n: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def manifest(leaves: DataFrame, proofs: bool = False) -> DataFrame:
    """(doc_id, lang, place, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves (doc_id, lang, leaf, shown).

    ``shown`` is the digest that a row presents now: it is folded along the siblings of the tree, which is
    over ``leaf``; verified where that gives the root. Rows with one doc_id stand in order of their digests,
    a null doc_id before others; a null group is the first. With ``proofs`` also the proof, an array of
    (before, after): the run's other nodes at each level up to the root. More than TOP block roots, from more
    groups or rows than the driver's tree is made for, are an error. An empty table gives an empty result.
    """
    spark = leaves.sparkSession
    with passing_tables(spark):
        return materialize(_manifest(leaves, proofs), "merkle-manifest", keep=True)


def _manifest(leaves: DataFrame, proofs: bool) -> DataFrame:
    spark = leaves.sparkSession
    leaves, seen = measured(leaves.select("doc_id", "lang", "leaf", "shown"), "merkle-leaves", F.count("*").alias("rows"))
    per_group = leaves.groupBy("lang").agg(F.count("*").alias("size")).limit(TOP + 1).collect()
    height = next((h for h in range(LOW, HIGH) if seen["rows"] // ARITY**h + len(per_group) <= TOP), HIGH)
    if seen["rows"] // ARITY**height + len(per_group) > TOP:
        raise ValueError(f"{seen['rows']} rows in {len(per_group)} groups have more than {TOP} blocks")
    groups = sorted(((r["lang"], r["size"]) for r in per_group), key=lambda g: (g[0] is not None, (g[0] or "").encode()))
    starts, at = [], 0
    for number, (lang, size) in enumerate(groups):
        starts.append((lang, number, at, size))
        at += size
    starts = spark.createDataFrame(starts, "g string, number int, first long, size long")
    ranked = running(leaves.withColumn("one", F.lit(1)), ["lang", "doc_id", "leaf", "shown"], "one")
    ranked = ranked.join(F.broadcast(starts), F.col("lang").eqNullSafe(F.col("g"))).withColumn("place", F.col("rank") - 1 - F.col("first"))
    blocks = materialize(ranked.select("doc_id", "lang", "leaf", "shown", "number", "size", "place", F.floor(F.col("place") / ARITY**height).alias("block")), "merkle-blocks")

    def rooted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        levels = grown([x.encode() for x in rows.column("leaf").to_pylist()], min(height, _levels_needed(rows.column("size")[0].as_py())))
        return pa.table({"number": rows.column("number")[:1], "block": rows.column("block")[:1], "digest": [levels[-1][0].decode()]})

    roots = blocks.groupBy("number", "block").applyInArrow(rooted, "number int, block long, digest string").collect()
    by_group: list[list[tuple[int, bytes]]] = [[] for _ in groups]
    for r in roots:
        by_group[r["number"]].append((r["block"], r["digest"].encode()))
    trees = [grown([d for _, d in sorted(nodes)]) for nodes in by_group]
    over = grown([t[-1][0] for t in trees])
    top = spark.sparkContext.broadcast((trees, over))
    schema = blocks.select("doc_id", "lang").schema.add("place", "long")
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(c, "string")
    schema = schema.add("verified", "boolean")
    if proofs:
        schema = schema.add("proof", ArrayType(StructType().add("before", "string").add("after", "string")))

    def proven(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        trees, over = top.value
        number, block, size = (rows.column(c)[0].as_py() for c in ("number", "block", "size"))
        inside = grown([x.encode() for x in rows.column("leaf").to_pylist()], min(height, _levels_needed(size)))
        upper = path(trees[number], block) + path(over, number)
        root = over[-1][0]
        out: dict[str, list] = {"proof_sha256": [], "folded_root": [], "verified": []}
        paths = []
        for k, shown in enumerate(rows.column("shown").to_pylist()):
            siblings = path(inside, k) + upper
            folded = fold(shown.encode(), siblings)
            out["proof_sha256"].append(digest(b"".join(b + a for b, a in siblings)).decode())
            out["folded_root"].append(folded.decode())
            out["verified"].append(folded == root)
            if proofs:
                paths.append([{"before": b.decode(), "after": a.decode()} for b, a in siblings])
        n = rows.num_rows
        whole = {c: rows.column(c) for c in ("doc_id", "lang", "place", "leaf")} | {"subroot": [trees[number][-1][0].decode()] * n, "root": [root.decode()] * n} | out
        return pa.table(whole | ({"proof": pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))} if proofs else {}))

    return blocks.groupBy("number", "block").applyInArrow(proven, schema)


def tampered_manifest(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The manifest of docs, with the rows whose crc32 of doc_id 3 divides shown with A-Z of their text in lower case.

    Nulls in any field are leaves of their own kind; a row with a null doc_id is never tampered with. Other
    columns are ignored; repeated rows have equal leaves, and each its own proof.
    """
    fields = fields or FIELDS
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    shown = leaf_of([text if c == "text" else F.col(c) for c in fields])
    return manifest(docs.select("doc_id", "lang", leaf_of(map(F.col, fields)).alias("leaf"), shown.alias("shown")))


def _oracle(levels: int = 12) -> str:
    """The same in SQL, a level at a time; trees of up to 8**levels leaves."""
    field = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR) END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in FIELDS) + ")"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_prepend(CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), list_transform(range(8), lambda x: CAST(-1 AS BIGINT)))))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT))"
    ctes = [
        f"d AS (SELECT *, {crc} AS crc FROM documents)",
        f"l0 AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM d)",
        "n0 AS (SELECT CAST(lang AS VARCHAR) AS g, place, leaf AS digest FROM l0)",
        "p0 AS (SELECT lang AS g, place AS row_place, place, shown AS folded, '' AS proof, leaf, doc_id FROM l0)",
    ]

    def level(k: int, nodes: str, rows: str) -> None:
        # a group of one node has no level left
        ctes.append(f"r{k} AS (SELECT g, place // 8 AS run, list(digest ORDER BY place) AS ds, sum(count(*)) OVER (PARTITION BY g) > 1 AS more FROM {nodes} GROUP BY g, place // 8)")
        ctes.append(f"n{k + 1} AS (SELECT g, run AS place, CASE WHEN more THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS digest FROM r{k})")
        at = "CAST(place % 8 AS BIGINT)"
        ctes.append(f"p{k + 1} AS (SELECT p.g, p.row_place, p.place // 8 AS place, CASE WHEN more THEN sha256(array_to_string(ds[1:{at}], '') || folded || array_to_string(ds[{at} + 2:], '')) ELSE folded END AS folded, CASE WHEN more THEN proof || array_to_string(ds[1:{at}], '') || array_to_string(ds[{at} + 2:], '') ELSE proof END AS proof, leaf, doc_id FROM {rows} p JOIN r{k} r ON p.g IS NOT DISTINCT FROM r.g AND p.place // 8 = r.run)")

    for k in range(levels):
        level(k, f"n{k}", f"p{k}")
    m = levels
    ctes.append(f"subs AS (SELECT g AS lang, digest, row_number() OVER (ORDER BY (g IS NOT NULL), encode(g)) - 1 AS place FROM n{m})")
    ctes.append(f"n{m + 1} AS (SELECT 'all' AS g, place, digest FROM subs)")
    ctes.append(f"p{m + 1} AS (SELECT 'all' AS g, p.row_place, s.place, p.folded, p.proof, p.leaf, p.doc_id FROM p{m} p JOIN subs s ON p.g IS NOT DISTINCT FROM s.lang)")
    for k in range(m + 1, m + 4):
        level(k, f"n{k}", f"p{k}")
    end = m + 4
    return f"""
WITH {", ".join(ctes)}
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = t.digest AS verified
FROM p{end} p JOIN l0 ON p.doc_id = l0.doc_id JOIN subs s ON s.lang IS NOT DISTINCT FROM l0.lang CROSS JOIN n{end} t
"""


ORACLE_SQL = _oracle()
