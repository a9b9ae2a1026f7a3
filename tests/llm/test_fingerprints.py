"""Operator 11 against a plain SimHash and a scan of all pairs of fingerprints."""

from __future__ import annotations

import hashlib
import random

import pytest
import xxhash
from conftest import rows
from pyspark.sql import functions as F
from test_operators import EDGES, WORD, docs, lower, words

from weftlog.llm import simhash


def h64(*parts):
    """What Spark's xxhash64 gives: a hash of each part with the one before as its seed."""
    out = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p
        out = xxhash.xxh64_intdigest(data, out)
    return out


def plain(text):
    w = WORD.findall(lower(text))
    pairs = list(zip(w, w[1:], strict=False)) if len(w) > 1 else [(x,) for x in w]
    terms = {(h64(*p) & ~31) | min(sum(map(len, p)), 31) for p in pairs}
    votes = [0] * 128
    for t in terms:
        raw = t.to_bytes(8, "little")
        bits = h64(raw) | xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h64(raw)) << 64
        for k in range(128):
            votes[k] += (t & 31) * (1 if bits >> k & 1 else -1)
    return sum(1 << k for k in range(128) if votes[k] > 0)


def wanted(pairs, radius):
    """Of distinct rows, in order of id and hash."""
    distinct = sorted({(k, t or "") for k, t in pairs}, key=lambda r: (r[0] is not None, r[0] or 0, h64(r[1]) - (h64(r[1]) >> 63 << 64)))
    prints = [plain(t) for _, t in distinct]
    out = {}
    for n, (k, t) in enumerate(distinct):
        nxt, half = distinct[n - 1], len(t) // 2
        edited = t[: len(t) - half] + nxt[1][:half]
        p, q = prints[n], plain(edited)
        near = sum(bin(p ^ x).count("1") <= radius for x in prints) - 1
        out[k, t] = (k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{p:032x}", f"{q:032x}", 1 - bin(p ^ q).count("1") / 128, 1 - bin(p ^ prints[n - 1]).count("1") / 128, near if k is not None and k % 20 == 0 else None)
    return out


def test_simhash(spark):
    rng = random.Random(5)
    base = [words(rng, 300, 5000) for _ in range(8)]
    near = [" ".join([*b.split()[:-1], "changed"]) for b in base for _ in range(3)]
    texts = [(k * 5, t) for k, t in enumerate([*EDGES, *base, *near, base[0], base[0].upper(), "\U0001f600" * 9, *[base[1]] * 30])]
    texts += [(0, "other text of this id"), (None, base[2]), (None, None), (20, texts[4][1]), (20, texts[4][1])]
    want = wanted(texts, simhash.RADIUS)
    assert any(v[-1] and v[-1] > 3 for v in want.values())
    got = rows(simhash.digests(docs(spark, texts)).na.fill(-1))
    assert got == sorted(tuple(-1 if x is None else x for x in want[k, t or ""]) for k, t in texts)
    assert rows(simhash.digests(docs(spark, texts).limit(0))) == []
    assert rows(simhash.digests(docs(spark, [(7, "only one here")]))) == [(7, 13, hashlib.sha256(b"only on" + b"only o").hexdigest(), f"{plain('only one here'):032x}", f"{plain('only ononly o'):032x}", got_like("only one here", "only ononly o"), 1.0, None)]
    assert {r.fingerprint for r in simhash.fingerprints(docs(spark, texts)).collect()} == {v[3] for v in want.values()}


def got_like(a, b):
    return 1 - bin(plain(a) ^ plain(b)).count("1") / 128


def test_search_is_whole_at_every_distance(spark):
    """Around 40 fingerprints, others 0 to 8 bits away: all within the radius are found once, none beyond."""
    rng = random.Random(6)
    some = [rng.getrandbits(128) for _ in range(40)]
    every = set(some)
    for p in some:
        for d in range(9):
            flip = sum(1 << k for k in rng.sample(range(128), d))
            every.add(p ^ flip)
    signed = lambda x: x - (x >> 63 << 64)
    two = lambda p: (signed(p >> 64), signed(p & (1 << 64) - 1))
    prints = spark.createDataFrame([two(p) for p in every], "hi long, lo long")
    asked = spark.createDataFrame([two(p) for p in some], "hi long, lo long")
    for radius in (0, 3, 6):
        got = rows(simhash.search(prints, asked, radius))
        want = sorted((*two(p), *two(q), bin(p ^ q).count("1")) for p in some for q in every if p != q and bin(p ^ q).count("1") <= radius)
        assert got == want
    with pytest.raises(ValueError):
        simhash.search(prints, asked, 7)


def test_string_ids_long_texts(spark):
    long = words(random.Random(7), 100_000, 50_000)
    d = spark.createDataFrame([("b", long), ("a", long + " end"), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in simhash.digests(d).collect()}
    assert got["c"].fingerprint == "0" * 32 and got["b"].near_next > 0.9 and got["a"].n_near is None
    assert got["b"].fingerprint == f"{plain(long):032x}"


def test_search_broadcasts_no_dealt_rows(spark, tmp_path):
    """Tables that are small before they are dealt to 28 others are joined by shuffle."""
    spark.range(2000).select(F.xxhash64("id").alias("hi"), F.xxhash64("id", F.lit(1)).alias("lo")).write.parquet(str(tmp_path / "prints"))
    prints = spark.read.parquet(str(tmp_path / "prints"))
    found = simhash.search(prints, prints.where("hi % 20 = 0")).agg(F.count("*"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
