"""The pipeline stage by stage on a small folder of tables, and what it must and must not drop."""

from __future__ import annotations

import random

import corpus_pipeline
from test_operators import words


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    clean = [(k, words(rng, 60, 9000).replace("w", "word")) for k in range(120)]
    item = words(rng, 40, 9000)
    toxic = [(200 + k, words(rng, 40, 9000) + " idiot scum moron") for k in range(40)]
    copies = [(300, clean[3][1]), (301, clean[3][1] + " more")]
    dirty = [(400, words(rng, 20, 9000) + " " + item)]
    extra = [(500, None), (501, "")]
    data = [(k, t, "en", f"s{k % 3}", 0, "x") for k, t in [*clean, *toxic, *copies, *dirty, *extra]]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string").drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(200 <= k < 240)) for k, *_ in data], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {k for k, *_ in data}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = {"toxicity": {k for k, _ in toxic}, "near_dedup": {300, 301}, "decontamination": {400}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name in gone:
            left -= gone[name]
            assert {r.doc_id for r in docs.select("doc_id").collect()} == left
        elif name == "mixing":
            n = [r["count"] for r in docs.groupBy("doc_id").count().collect()]
            assert max(n) <= 2 and {r.doc_id for r in docs.collect()} <= left
        else:
            rows = sorted(out.collect(), key=lambda r: r.start)
            assert [r.doc_id for r in rows] == sorted(r.doc_id for r in before.collect())
            assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)
