"""Operator 12 against a plain tree, and what a proof shows."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from conftest import rows

from weftlog.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def level(nodes):
    return [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]


def proof(nodes, k):
    """Siblings of node k level by level, what is on top, and a function that folds another leaf."""
    parts = []
    while len(nodes) > 1:
        run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
        parts.append((run[: k % 8], run[k % 8 + 1 :]))
        nodes, k = level(nodes), k // 8
    return parts, nodes[0]


def brute(table):
    groups = {}
    for k, t, lang, source, n in table:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)}) if t is not None else None
        hit = k is not None and zlib.crc32(str(k).encode()) % 3 == 0
        groups.setdefault(lang, []).append((k is not None, k or 0, leaf(k, source, lang, n, t), leaf(k, source, lang, n, low if hit else t), k))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: r[:4])
    tops = [proof([r[2] for r in groups[g]], 0)[1] for g in names]
    out = []
    for number, g in enumerate(names):
        upper, root = proof(tops, number)
        for k, r in enumerate(groups[g]):
            inside, sub = proof([x[2] for x in groups[g]], k)
            folded = r[3]
            for before, after in inside + upper:
                folded = sha("".join([*before, folded, *after]))
            siblings = "".join(x for before, after in inside + upper for x in (*before, *after))
            out.append((r[4], r[2], sub, root, sha(siblings), folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def made(spark, table):
    return spark.createDataFrame([(k, t, lang, s, n, "x", "y") for k, t, lang, s, n in table], SCHEMA)


def table_of(n):
    """Groups of 1, 8, 9 and about n rows, nulls everywhere, ids repeated."""
    table = [(k, f"Text {k} É" if k % 7 else None, "en", f"s{k % 3}" if k % 5 else None, k if k % 4 else None) for k in range(n)]
    table += [(1000 + k, "Abc", None, "s", 3) for k in range(9)] + [(2000 + k, "", "äö", "s", 0) for k in range(8)] + [(5, "Lone", "Z", "s", 4)]
    return [*table, table[3], table[3], (None, "No Id", "en", "s", 5), (3, "Other Text", "en", "s", 1)]


@pytest.mark.parametrize("low", [1, 4])
def test_manifest(spark, monkeypatch, low):
    """With blocks of 8 leaves, whose roots make a tree of three levels on the driver, and with whole groups in a block."""
    monkeypatch.setattr(merkle, "LOW", low)
    table = table_of(700)
    got = sorted((tuple(r) for r in merkle.tampered_manifest(made(spark, table)).select(COLUMNS).collect()), key=str)
    want = brute(table)
    assert got == want
    assert len({r[3] for r in got}) == 1 and any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_edges_of_the_manifest(spark):
    assert rows(merkle.tampered_manifest(made(spark, []))) == []
    for table in ([(7, "A", "en", "s", 1)], [(6, "ABC", None, None, None), (6, "ABC", None, None, None)]):
        assert sorted((tuple(r) for r in merkle.tampered_manifest(made(spark, table)).select(COLUMNS).collect()), key=str) == brute(table)
    long = [(k, "Very Long " * 500_000, "en", "s", 5_000_000) for k in range(3)]
    assert sorted((tuple(r) for r in merkle.tampered_manifest(made(spark, long)).select(COLUMNS).collect()), key=str) == brute(long)


def test_proofs_and_bound(spark, monkeypatch):
    """A proof folds its own leaf to the root and no other; more blocks than the driver may hold are an error."""
    leaves = spark.createDataFrame([(k, "g", sha(str(k)), sha(str(k))) for k in range(100)], "doc_id long, lang string, leaf string, shown string")
    for r in merkle.manifest(leaves, proofs=True).collect():
        siblings = [(p.before.encode(), p.after.encode()) for p in r.proof]
        assert merkle.fold(r.leaf.encode(), siblings).decode() == r.root and r.verified
        assert merkle.fold(sha("x").encode(), siblings).decode() != r.root
    monkeypatch.setattr(merkle, "TOP", 4)
    monkeypatch.setattr(merkle, "HIGH", 1)
    monkeypatch.setattr(merkle, "LOW", 1)
    with pytest.raises(ValueError, match="blocks"):
        merkle.manifest(leaves)


def test_string_ids(spark):
    d = spark.createDataFrame([(f"d{k}", "T", "en", "s", 1) for k in range(20)], "doc_id string, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.place for r in merkle.tampered_manifest(d).collect()}
    assert got == {k: n for n, k in enumerate(sorted(f"d{k}" for k in range(20)))}
