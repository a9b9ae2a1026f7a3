"""The corpus pipeline: stages in order, each from a DataFrame of documents to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlog.llm import decontaminate, minhash, mixing, tokens, toxicity
from weftlog.plans.scratch import materialize
from weftlog.plans.sizing import sized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Ids that are broadcast, numbers of 8 bytes; more of them meet the documents by shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids in gone; rows with a null doc_id stay. The ids are written first, so their number is known."""
    ids = materialize(gone.select("doc_id").where("doc_id is not null").distinct(), "pipeline-gone")
    return docs.join(sized(ids, BROADCAST_IDS), "doc_id", "left_anti").select(COLUMNS)


# Every stage judges a null or empty text as a text without words: it is kept by the first three. Rows with a null
# doc_id can't be named by an id, so they stay in the first three and are judged on by the rest. Empty tables give empty ones.


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts toxic go. It learns from docs with labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, toxicity.score(docs, labels).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (at least 0.8 of all shingles of five words shared) stays, the smallest doc_id."""
    return _without(docs, minhash.near_duplicates(docs, n_words=5, percent=80).where("not kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth stands in benchmark items go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contamination(docs, benchmark).where("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some not at all, some twice."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards are written and read back: doc_id, start, n_tokens and ids_crc32, a row for each row of docs."""
    return tokens.token_digests(docs, tokens.tokenizer_path(), 2)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", token_output),
]

#: The classifier, the hashes of the mix and the tokenizer have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
