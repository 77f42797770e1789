"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.decontaminate import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.urls import judge, outcomes_of_sources

    pages = _table(spark, sf_dir, "pages")
    return judge(pages, outcomes_of_sources(pages, _table(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillgraph.llm.tokens import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.pii import pseudonymise

    found = pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), found="found")
    changed = F.filter("found", lambda x: x["changed"])
    return found.select("doc_id", "text", F.size(changed).cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct(F.transform(changed, lambda x: x["kind"]))), ",").alias("kinds"))


def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.embed_dup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for name, made in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
