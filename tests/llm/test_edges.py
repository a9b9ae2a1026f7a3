"""Very long texts, ties and ids of other types, for the operators on texts."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from test_operators import docs, words

from weftlog.llm import html, langid, licenses, minhash, mixing, toxicity


def test_very_long_texts(spark):
    rng = random.Random(21)
    long = words(rng, 200_000, 50_000)
    near = " ".join([*long.split()[:-5], "a", "b", "c", "d", "e"])
    d = docs(spark, [(1, long), (2, near), (3, long + " all rights reserved"), (4, "x" * 1_000_000), (5, "1" * 200_000 + " !" * 1000)], lang={k: "en" for k in range(1, 6)}, source={k: "s" for k in range(1, 6)})
    got = {r.doc_id: r for r in minhash.near_duplicates(d).collect()}
    assert got[1].n_shingles > 190_000 and [got[k].component_id for k in (1, 2, 3, 4)] == [1, 1, 1, 4]
    scanned = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert (scanned[1].n_words, scanned[3].first_word, scanned[3].base_labels) == (200_000, 200_000, "reserved")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 6)], "doc_id long, toxic int")
    assert toxicity.score(d, labels).count() == 5 and toxicity.restore(d).count() == 5
    assert {r.doc_id: r.lang_pred for r in langid.predict(d).collect()} == {1: "en", 2: "en", 3: "en", 4: "en", 5: "und"}
    assert {r.doc_id: r.size for r in mixing.digests(d).collect()} == {1: 200_000, 2: 200_000, 3: 200_003, 4: 1, 5: 1001}
    assert len(html.main_text("<article>" + "<p>" + long + "</p>" * 3 + "<div>" * 5000 + "end")) > len(long)


def test_languages_that_tie_go_by_order(spark):
    """Rows of one text under two languages say nothing: the first language is taken."""
    text = "la la la le le"
    d = docs(spark, [(k, text) for k in range(60)], lang={k: "bb" if k % 2 else "aa" for k in range(60)})
    model = langid.fit(d)
    assert model[0] == ["aa", "bb"]
    flat = np.zeros_like(model[2])
    kept, langid.fit = langid.fit, lambda *_: (model[0], model[1], flat, 1.0)
    try:
        assert {(r.lang_pred, r.score) for r in langid.predict(d).collect()} == {("aa", 0.5)}
    finally:
        langid.fit = kept


def test_string_ids(spark):
    rng = random.Random(22)
    base = [words(rng, 60, 5000) for _ in range(6)]
    texts = [*base, *(" ".join([*t.split()[:-1], "end"]) for t in base)]
    d = spark.createDataFrame([(f"d{k:02d}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()}
    assert got == {f"d{k:02d}": f"d{k % 6:02d}" for k in range(12)}
    assert mixing.digests(d.withColumn("source", F.lit("s"))).count() == 12


def test_tables_that_pass_go(spark):
    import os

    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    d = docs(spark, [(k, "some words " * (k + 1)) for k in range(20)], lang=dict.fromkeys(range(20), "en"), source=dict.fromkeys(range(20), "s"))
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    minhash.near_duplicates(d).count()
    mixing.mix(d).count()
    licenses.scan(d).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(where)) - before}
    assert left == {"minhash-components", "mix-plan", "mix-goal", "license-rows"}
