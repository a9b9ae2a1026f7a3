"""Near copies between the thresholds of the pipeline's stage and of the query, and the coordinates that a threshold asks for."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from test_operators import docs, words

from weftlog.llm import minhash


def altered(text, *at):
    w = text.split()
    for k in at:
        w[k] = f"changed{k}"
    return " ".join(w)


def components(data, percent=85):
    """The smallest id of each one's component, from all pairs of full sets."""

    def sets(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    s, root = {k: sets(t) for k, t in data}, {k: k for k, _ in data}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in s:
        for j in s:
            if i < j and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]) and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {k: top(k) for k in s}


def test_stage_links_from_four_fifths(spark):
    rng = random.Random(11)
    base = [words(rng, 100, 9000) for _ in range(20)]
    near = [altered(t, 30, 70) for t in base]  # 86 of 106 shingles: 0.81
    far = [altered(t, 20, 50, 80) for t in base[:5]]  # 81 of 111 and, from near ones, less
    d = docs(spark, list(enumerate([*base, *near, *far])))
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect()}
    assert left == {*range(20), *range(40, 45)}
    assert all(r.kept for r in minhash.near_duplicates(d).collect())  # the query's own threshold stays 0.85


def test_low_threshold_misses_no_pair(spark):
    rng = random.Random(12)
    base = [words(rng, 100, 9000) for _ in range(30)]
    near = [altered(t, 10, 30, 50, 70) for t in base]  # 76 of 116 shingles: 0.66
    got = {r.doc_id: r.kept for r in minhash.near_duplicates(docs(spark, list(enumerate([*base, *near]))), percent=65).collect()}
    assert got == {k: k < 30 for k in range(60)}


def test_least_agreement():
    assert [minhash.least_agreement(p) for p in (80, 85, 100)] == [34, 39, 64]
    with pytest.raises(ValueError):
        minhash.least_agreement(10)


def test_planted_pairs_near_the_threshold_are_found(spark):
    rng = random.Random(13)
    base = [words(rng, 136, 90_000) for _ in range(300)]
    near = [altered(t, 20, 70) for t in base]  # 122 of 142 shingles: 0.859
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, list(enumerate([*base, *near])))).collect()}
    assert all(got[300 + k] == k for k in range(300))


def test_long_lists_of_several_components(spark):
    """A passage that all share makes long lists; texts are linked in a few groups only, some through blocks of their own."""
    rng = random.Random(14)
    passage = words(rng, 60, 9000)
    heads = [words(rng, 60, 9000) for _ in range(5)]
    texts = [f"{altered(heads[k % 5], k % 50, (7 * k) % 50 + 1)} {passage}" if k % 8 else f"{words(rng, 60, 9000)} {passage}" for k in range(400)]
    data = list(enumerate(texts))
    rng.shuffle(data)

    want = components(data)
    for block in (8, 512):
        was, minhash.BLOCK = minhash.BLOCK, block
        try:
            got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, data)).collect()}
        finally:
            minhash.BLOCK = was
        assert got == want


@pytest.mark.parametrize(("meetings", "short_list"), [(3, 2), (3, 24), (100, 2)])
def test_counted_collisions_lose_no_link(spark, monkeypatch, meetings, short_list):
    """Groups of three to five near copies: with lists of two at most, most collisions stand in lists that are skipped."""
    rng = random.Random(15)
    base = [words(rng, 120, 90_000) for _ in range(12)]
    data = list(enumerate(altered(base[k % 12], *rng.sample(range(120), k // 24)) for k in range(60)))
    want = components(data)
    assert len({*want.values()}) < 40
    monkeypatch.setattr(minhash, "MEETINGS", meetings)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, data), short_list=short_list).collect()} == want
