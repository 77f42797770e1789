"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

language        documents without an identified language go (op 2)
near_dedup      one document of each near-duplicate group stays (op 1)
decontaminate   documents with a benchmark window go (op 4)
pii             personal data become pseudonyms of their own format (op 9)
mix             the rest is repeated or thinned to the sources' targets, with an ``epoch`` column (op 7)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.decontaminate import drop_contaminated
from quillgraph.llm.language import keep_identified
from quillgraph.llm.mixing import mixed
from quillgraph.llm.near_dup import drop_near_duplicates
from quillgraph.llm.pii import pseudonymise
from quillgraph.llm.shared import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES: list[tuple[str, Stage]] = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("mix", mix)]

#: The language model and SHA-256 pseudonyms are beyond SQL; a brute-force test of run() as a whole is still to be written.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
