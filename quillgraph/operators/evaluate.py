"""Retrieval quality: recall at k, definition accuracy, line recall, reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import safe_ratio


def line_covered(line: Column, start: Column, end: Column) -> Column:
    return F.coalesce(line.between(start, end), F.lit(False))


def first_ranks(results: DataFrame, case: str = "case_id", file: str = "file", rank: str = "rank") -> DataFrame:
    return results.groupBy(case, file).agg(F.min(rank).alias("first_rank"))


def recall_at_k(evidence: DataFrame, results: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """case_id, k, edges, recall (by edge), file_recall (by distinct file), line_recall, for each k.

    ``evidence``: case_id, file, line (one row an edge); ``results``: case_id, rank, file, start_line, end_line.
    A line counts as found where any result of its file within k covers it.
    """
    ranks = first_ranks(results)
    place = ["case_id", "file", "line"]
    covered = evidence.select(*place).distinct().join(results, place[:2]).where(line_covered(F.col("line"), F.col("start_line"), F.col("end_line"))).groupBy(*place).agg(F.min("rank").alias("line_rank"))
    held = evidence.join(ranks, place[:2], "left").join(covered, place, "left")
    spread = held.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    found, on_line = F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False)), F.coalesce(F.col("line_rank") <= F.col("k"), F.lit(False))
    return spread.groupBy("case_id", "k").agg(
        F.count("*").alias("edges"),
        safe_ratio(F.count_if(found), F.count("*")).alias("recall"),
        safe_ratio(F.count_distinct(F.when(found, F.col("file"))), F.count_distinct("file")).alias("file_recall"),
        safe_ratio(F.count_if(on_line), F.count("*")).alias("line_recall"),
    )


def definition_accuracy(definitions: DataFrame, results: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """case_id, k, accuracy: 1 if all of a case's definition files are within k, else 0; cases without any are absent."""
    held = definitions.select("case_id", "file").distinct().join(first_ranks(results), ["case_id", "file"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return held.groupBy("case_id", "k").agg(F.bool_and(F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False))).cast("double").alias("accuracy"))


def reciprocal_rank(cases: DataFrame, files: DataFrame, results: DataFrame, name: str = "mrr") -> DataFrame:
    """case_id, mrr: one over the first rank of any of the files; 0 if none is found, null if there are none."""
    ranks = first_ranks(results)
    best = files.select("case_id", "file").distinct().join(ranks, ["case_id", "file"], "left").groupBy("case_id").agg(F.min("first_rank").alias("r"), F.count("*").alias("files"))
    value = F.when(F.col("files").isNull(), F.lit(None)).when(F.col("r").isNull(), 0.0).otherwise(F.bround(1.0 / F.col("r"), 6))
    return cases.select("case_id").join(best, "case_id", "left").select("case_id", value.cast("double").alias(name))


def agent_retrieval(cases: DataFrame, definitions: DataFrame, evidence: DataFrame, reads: DataFrame) -> DataFrame:
    """case_id, definition_accuracy (0, not null, without definition files), retrieval_recall by edge."""
    seen = reads.select("case_id", "file").distinct().withColumn("seen", F.lit(True))
    d = definitions.select("case_id", "file").distinct().join(seen, ["case_id", "file"], "left").groupBy("case_id").agg(F.bool_and(F.coalesce("seen", F.lit(False))).cast("double").alias("d"))
    e = evidence.join(seen, ["case_id", "file"], "left").groupBy("case_id").agg(safe_ratio(F.count("seen"), F.count("*")).alias("retrieval_recall"))
    return cases.select("case_id").join(d, "case_id", "left").join(e, "case_id", "left").select("case_id", F.coalesce("d", F.lit(0.0)).alias("definition_accuracy"), "retrieval_recall")


def mean_of(frame: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means that pass over nulls, to six places; null if there is nothing."""
    return frame.groupBy(*by).agg(*[F.bround(F.avg(c), 6).alias(c) for c in columns])
