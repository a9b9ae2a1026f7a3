"""Ids that are strings, long conversations and null turns, ties of scores and of lines."""

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F
from test_operators import words

from weftlog.llm import chat, decontaminate, html, langid, licenses, toxicity


def test_string_ids_of_the_other_operators(spark):
    rng = random.Random(41)
    item = words(rng, 30, 300)
    texts = {f"d{k}": words(rng, 40, 400) for k in range(30)} | {"hit": f"{words(rng, 5)} {item}", "by": "see cc by 4.0", "none": None}
    d = spark.createDataFrame([(k, t, "en" if n % 2 else "de") for n, (k, t) in enumerate(texts.items())], "doc_id string, text string, lang string")
    benchmark = spark.createDataFrame([("b", item)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(d, benchmark).collect()}
    assert [k for k, r in got.items() if r.contaminated] == ["hit"] and got["hit"].n_hit == 30 and len(got) == len(texts)
    assert rows(decontaminate.proximity(d, benchmark)) == [("hit", "b")]
    assert {r.doc_id: r.base_labels for r in licenses.scan(d).collect()}["by"] == "cc-by"
    assert {r.doc_id for r in langid.predict(d).collect()} == set(texts)
    labels = spark.createDataFrame([(k, n % 2) for n, k in enumerate(texts)], "doc_id string, toxic int")
    scored = {r.doc_id: r for r in toxicity.score(d, labels).collect()}
    assert set(scored) == set(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())


def test_scores_that_tie(spark):
    """One text, labelled toxic as often as not: every score is the same, and one half is toxic."""
    d = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    ids = [r.doc_id for r in d.where("crc32(cast(doc_id as string)) % 5 <> 0").orderBy("doc_id").collect()]
    ids = ids[: len(ids) // 2 * 2]
    labels = spark.createDataFrame([(k, n % 2) for n, k in enumerate(ids)], "doc_id long, toxic int")
    got = {(round(r.score, 6), r.predicted) for r in toxicity.score(d, labels).collect()}
    assert len(got) == 1 and all(p == (s >= 0.5) for s, p in got)


def test_lines_that_tie():
    line = "A line of text that is as long as the others."
    assert html.main_text(f"<p>{line}</p>" * 9) == "\n\n".join([line] * 9)
    assert html.main_text(f"<article><p>{line}</p></article>" * 2) == f"{line}\n\n{line}"


def test_long_conversations_and_null_turns(spark):
    n = 3_000
    turns = [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(n)] + [(2, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(n - 1)] + [(2, n - 1, "assistant", "another end")]
    turns += [(3, None, None, None), (3, 1, "assistant", None), (3, None, "user", "x"), (None, 1, "user", "lost")]
    table = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.preference_rows(chat.next_answer_pairs(table)).collect()}
    assert set(got) == {1, 2, 3} and got[1].n_prompt_turns == n - 1
    assert (got[1].chosen, got[1].rejected) == (f"<|assistant|>\nturn {n - 1}<|end|>\n", "<|assistant|>\nanother end<|end|>\n")
    assert got[3].n_prompt_turns == 2 and got[3].chosen == "<|assistant|>\n<|end|>\n" and got[3].rejected == ""
    both = spark.createDataFrame([(1, [], [(("user"), "a")] * 5_000 + [("assistant", "b")] * 5_000)], f"k int, chosen {chat._TURNS}, rejected {chat._TURNS}")
    r = chat.preference_rows(both).first()
    assert r.n_prompt_turns == 0 and r.rejected_spans.count("-") == 5_000
