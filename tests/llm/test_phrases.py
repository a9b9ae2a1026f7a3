"""Operator 13 against counting all phrases of all pieces."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import EDGES, docs, lower

from weftlog.llm import collocations as co


def brute(table, least=10, first=2000, inside=50):
    f, n = Counter(), Counter()
    for lang, text in table:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f.update((lang, *w[k : k + size]) for k in range(len(w) - size + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if len(w) == 2 and any(q[0] == lang and len(q) == 4 and w in (q[1:3], q[2:4]) and 100 * b >= inside * a for q, b in cand.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, all_of in out.items() for r, (s, a, p, x, y) in enumerate(sorted(all_of)[:first]))


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Été", "éÉ", "x\x00y", "ü"] + [f"rare{k}" for k in range(400)]
    weights = [40 / (k + 1) for k in range(16)] + [0.05] * 400
    out = []
    for _ in range(n):
        w = rng.choices(vocabulary, weights, k=rng.randrange(60))
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for x in w)
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), text.upper() if rng.random() < 0.2 else text))
    return [*out, *(("en", e) for e in EDGES), *[("en", "click here now")] * 40, *[("fr", "un deux")] * 9, *[("fr", "trois. quatre cinq six")] * 10]


def got_of(spark, table, **how):
    lang = dict(enumerate(x for x, _ in table))
    return rows(co.collocations(docs(spark, [(k, t) for k, (_, t) in enumerate(table)], lang=lang), **how))


@pytest.mark.parametrize("tokens", [40, 2_000_000])
def test_collocations(spark, tokens, monkeypatch):
    """In chunks that hold a few texts, and texts that run over several, and in one."""
    if tokens == 40:
        monkeypatch.setattr(co, "SLICE", 60)
    table = corpus(1)
    want = brute(table)
    assert len({r[0] for r in want}) == 4 and max(r[7] for r in want) == 1_000_000
    assert got_of(spark, table, tokens=tokens) == want
    assert got_of(spark, table, tokens=tokens, least=3, first=5, inside=80) == brute(table, 3, 5, 80)


def test_ranges_cut_phrases(spark):
    """Ranges so small that phrases of two words go on from one to the next."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = corpus(2, 150)
        assert got_of(spark, table, tokens=300) == brute(table)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_batches_cut_runs():
    """Batches of every size count the same."""
    import pyarrow as pa

    rng = random.Random(3)
    keys = sorted((rng.randrange(1, 4), rng.randrange(1, 4), rng.randrange(0, 4)) for _ in range(300))
    want = Counter(keys)
    pairs = Counter(k[:2] for k in keys)
    for size in (1, 2, 7, 1000):
        batches = [pa.record_batch([pa.array([b"".join(x.to_bytes(4, "big") for x in k) for k in keys[s : s + size]], pa.binary()), pa.array([1] * len(keys[s : s + size]), pa.int64())], ["key", "n"]) for s in range(0, len(keys), size)]
        got = Counter()
        for b in co._counted(5)(iter([batches[0].slice(0, 0), *batches])):
            for r in b.to_pylist():
                got[r["id1"], r["id2"], r["id3"]] += r["f"]
        assert {k: v for k, v in got.items() if k[2]} == {k: v for k, v in want.items() if k[2] and v >= 5}
        assert {k[:2]: v for k, v in got.items() if not k[2] and v >= 5} == {k: v for k, v in pairs.items() if v >= 5}


def test_radix_and_exact_scores(spark):
    keys = np.array([random.Random(4).getrandbits(64) for _ in range(5000)], np.uint64)
    assert (co.radix_sorted(keys) == np.sort(keys)).all() and len(co.radix_sorted(keys[:0])) == 0
    cases = [(10, 10, 10), (999_999_999_999, 10**12, 10**12 + 7), (123_456_789_012, 987_654_321_098, 555_555_555_555), (10**12, 10**12, 10**12), (3, 7, 11)]
    d = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r.s for r in d.select(co.score_of(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in cases]


def test_edges_of_collocations(spark):
    assert got_of(spark, [("en", None), ("en", ""), ("en", "a b")]) == []
    assert rows(co.collocations(docs(spark, [(1, "a b")], lang={1: "en"}).limit(0))) == []
    table = [("en", "ab cd " * 300_000), ("en", "x" * 3_000_000), (None, "ab cd " * 10)]
    assert got_of(spark, table, tokens=100_000) == brute(table)
