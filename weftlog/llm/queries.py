"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftlog.llm import chat, collocations, decontaminate, embeddings, html, langid, licenses, merkle, minhash, mixing, simhash, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(_table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(chat.next_answer_pairs(_table(spark, sf_dir, "conversations")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(_table(spark, sf_dir, "documents"), tokens.tokenizer_path(), 2)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.tampered_manifest(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_html": op3_html,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_embeddings": op6_embeddings,
    "op7_chat": op7_chat,
    "op8_licenses": op8_licenses,
    "op9_tokens": op9_tokens,
    "op10_minhash": op10_minhash,
    "op11_simhash": op11_simhash,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op6_embeddings": embeddings.ORACLE_SQL,
    "op7_chat": chat.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
