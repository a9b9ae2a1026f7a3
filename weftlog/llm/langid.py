"""Language identification by sparse multinomial logistic regression (operator 4).

1.  Features are character n-grams (n = 1 to 3) of the lowered text, runs of other than letters as one
    space, hashed to DIM places, weighted (1 + log tf) * idf and scaled to length one. Document frequencies
    are counted over all rows that may be learned from.
2.  The classifier is fitted on a sample that is bounded by language. Its rows are dealt to SHARDS
    tasks; each runs follow-the-regularised-leader with L1 and L2 penalties on its part, and
    the weights are averaged. The L1 penalty leaves most weights zero.
3.  A temperature is fitted on a part of the sample that the weights were not fitted on.
4.  Every whole text is scored in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.plans.scratch import materialize, passing_tables

#: Places of features, most sampled rows of a language, tasks that train, passes over a task's rows.
DIM, MAX_PER_LANG, SHARDS, EPOCHS = 1 << 15, 1500, 8, 4
#: FTRL: learning rate and its offset, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
#: Most languages that are told apart.
MAX_LANGS = 1000

_LETTER = np.array([chr(k).isalpha() for k in range(0x3000)])
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
_SHIFT = np.uint32(32 - DIM.bit_length() + 1)


def counts(text: str) -> np.ndarray:
    """How often each place has an n-gram of the text."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = x < len(_LETTER)
    if low.all():
        letter = _LETTER[x]
    else:
        letter = ~low
        letter[low] = _LETTER[x[low]]
    x = np.concatenate(([0], np.where(letter, x, np.uint32(0)), [0])).astype(np.uint32)
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
    one = x * _A
    two = one[:-1] * _B + one[1:]
    three = two[:-1] * _C + one[2:]
    return np.bincount(np.concatenate((one, two, three)) >> _SHIFT, minlength=DIM)


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = counts(text)
    place = np.flatnonzero(n)
    value = (1 + np.log(n[place])) * idf[place]
    return place, value / max(np.sqrt(value @ value), 1e-12)


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang of the rows to learn from: with a text and a language, in no held-out fold."""
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and crc32(cast(doc_id as string)) % 3 <> 1")


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(place, df) over all rows, and the number of rows at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                df += counts(text.as_py()) > 0
                n += 1
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array([-1, *some], pa.int32()), pa.array([n, *df[some]], pa.int64())], ["place", "df"])

    return rows.select("text").mapInArrow(run, "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int, rng: np.random.Generator) -> np.ndarray:
    """Weights (DIM, languages) of per-coordinate follow-the-regularised-leader."""
    z, n = np.zeros((DIM, n_langs)), np.zeros((DIM, n_langs))

    def weights(zp: np.ndarray, np_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zp) <= L1, 0.0, -(zp - np.sign(zp) * L1) / ((BETA + np.sqrt(np_)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            place, value = rows[k]
            zp, old = z[place], n[place]
            w = weights(zp, old)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = value[:, None] * p[None, :]
            new = old + g * g
            z[place] = zp + g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[place] = new
    return weights(z, n)


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        right = np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]
        return float(np.mean(right) + np.mean(np.log(np.exp(s).sum(1)) - s.mean(1)) / (len(y) + 1))  # as if one row were of every language

    lo, hi, r = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, most: int = MAX_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, idf, weights and temperature; no languages where there is nothing to learn from."""
    with passing_tables(docs.sparkSession):
        return _fit(docs, most)


def _fit(docs: DataFrame, most: int) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    rows = learnable(docs)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    idf, weights = np.ones(DIM), np.zeros((DIM, max(1, len(langs))))
    if not langs:
        return langs, idf, weights, 1.0
    df = {r["place"]: r["df"] for r in document_frequencies(rows).collect()}
    n = df.pop(-1)
    idf = np.full(DIM, np.log(1.0 + n) + 1)
    for place, k in df.items():
        idf[place] = np.log((1 + n) / (1 + k)) + 1
    # a bounded sample by a hash of doc_id; one row in five is kept back for the temperature
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, most / sizes[lang]))])
    at = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(at < share[F.col("lang")]).withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(SHARDS * 5)).cast("int"))
    sample = materialize(sample.repartition(SHARDS, "shard"), "lang-sample")
    number = {lang: k for k, lang in enumerate(langs)}

    def vectors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_vector(t, idf) for t in texts]

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        y = np.array([number[x] for x in group.column("lang").to_pylist()])
        w = _ftrl(vectors(group.column("text").to_pylist()), y, len(langs), np.random.default_rng(5))
        place, lang = np.nonzero(w)
        return pa.table({"place": pa.array(place, pa.int32()), "lang": pa.array(lang, pa.int32()), "w": w[place, lang]})

    parts = sample.where(f"shard < {SHARDS * 4}").withColumn("shard", F.col("shard") % SHARDS)
    used = parts.select("shard").distinct().count()
    if used:
        for r in parts.groupBy("shard").applyInArrow(train, "place int, lang int, w double").groupBy("place", "lang").agg(F.sum("w").alias("w")).collect():
            weights[r["place"], r["lang"]] = r["w"] / used

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [(v @ weights[p]).tolist() for p, v in vectors(batch.column("text").to_pylist())]
            yield pa.record_batch([pa.array([number[x] for x in batch.column("lang").to_pylist()], pa.int32()), pa.array(s, pa.list_(pa.float64()))], ["lang", "s"])

    kept = sample.where(f"shard >= {SHARDS * 4}").select("text", "lang").mapInArrow(scored, "lang int, s array<double>").collect()
    temperature = _temperature(np.array([r["s"] for r in kept]), np.array([r["lang"] for r in kept])) if kept else 1.0
    return langs, idf, weights, temperature


def predict(docs: DataFrame, most: int = MAX_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang), by its whole text.

    Learns from rows with text and language whose crc32 of doc_id mod 3 is not 1. A text that is
    null or has no letter is ``und`` with score 0, and so is every text where there is nothing to
    learn from. Of languages with equal scores the first in order is taken. Repeated rows get
    repeated results; a null doc_id is neither learned from nor held out; other columns are ignored.
    """
    langs, idf, weights, temperature = fit(docs, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                if not langs or not text or not any(c.isalpha() for c in text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                place, value = _vector(text, idf)
                s = (value @ weights[place]) / temperature
                p = np.exp(s - s.max())
                k = int(p.argmax())
                names.append(langs[k])
                scores.append(float(p[k] / p.sum()))
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"), "lang_pred", "score")
