"""Summaries of runs: usage, cost, time, errors, and agents' retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(response: Column, path: str, kind: str = "bigint") -> Column:
    return F.coalesce(F.get_json_object(response, path).try_cast(kind), F.lit(0).cast(kind))


def usage(responses: DataFrame, response: str = "response", by: list[str] | None = None) -> DataFrame:
    """Token sums and cost of JSON responses; reasoning tokens come from the details if these have any."""
    r = F.col(response)
    detail, flat = _number(r, "$.usage.completion_tokens_details.reasoning_tokens"), _number(r, "$.usage.reasoning_tokens")
    sums = {k: _number(r, f"$.usage.{k}") for k in ("prompt_tokens", "completion_tokens", "total_tokens")} | {"reasoning_tokens": F.coalesce(F.nullif(detail, F.lit(0)), flat)}
    return responses.groupBy(*(by or [])).agg(F.count("*").alias("raw_response_count"), *[F.sum(v).alias(k) for k, v in sums.items()], F.bround(F.sum(_number(r, "$.usage.cost", "double")), 12).alias("observed_cost_usd"))


def histogram(frame: DataFrame, column: Column, by: list[str] | None = None, unknown: str = "unknown") -> DataFrame:
    """by, value, n; nulls and empty values count as ``unknown``."""
    named = F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(unknown))
    return frame.groupBy(*(by or []), named.alias("value")).agg(F.count("*").alias("n"))


def providers(responses: DataFrame, response: str = "response", by: list[str] | None = None) -> DataFrame:
    return histogram(responses, F.get_json_object(response, "$.provider"), by)


def finish_reasons(responses: DataFrame, response: str = "response", by: list[str] | None = None) -> DataFrame:
    some = responses.where(F.get_json_object(response, "$.choices[0]").isNotNull())
    return histogram(some, F.get_json_object(response, "$.choices[0].finish_reason"), by)


def file_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """errors and predictions among run files, by name."""
    name = F.substring_index(path, "/", -1)
    return files.agg(F.count_if(name.rlike(r"error.*\.(?:json|txt)$")).alias("error_files"), F.count_if(name.rlike(r"^prediction\.(?:ya?ml|json)$")).alias("prediction_files"))


def timing(runs: DataFrame, by: list[str]) -> DataFrame:
    """started_at, finished_at, duration: the runs' own durations, or their cases' where no run has one."""
    total = F.coalesce(F.sum("duration_seconds"), F.sum("case_seconds"), F.lit(0.0))
    return runs.groupBy(*by).agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.bround(total, 3).alias("duration_seconds"))


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key: later sources overwrite earlier ones."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return records.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def agent_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """Means without nulls and sums over the cases' latest records."""
    return records.groupBy(*by).agg(
        F.count("*").alias("case_count"),
        F.bround(F.avg("definition_accuracy"), 6).alias("definition_accuracy"),
        F.bround(F.avg("retrieval_recall"), 6).alias("retrieval_recall"),
        *[F.sum(c).alias(c) for c in ("tool_calls", "files_read", "context_tokens")],
        F.bround(F.sum("duration_seconds"), 3).alias("duration_seconds"),
    )


def union_runs(runs: list[tuple[str, str, list[DataFrame]]], key: str = "case_id") -> DataFrame:
    """Records of several runs (track, model, sources), the later source winning for a key of a run."""
    every = None
    for track, model, sources in runs:
        for nth, source in enumerate(sources):
            named = source.withColumns({"track": F.lit(track), "model": F.lit(model), "source_order": F.lit(nth)})
            every = named if every is None else every.unionByName(named, allowMissingColumns=True)
    return latest(every, ["track", "model", key], ["source_order"]).drop("source_order")


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(408, 409, 425, 429) | (code >= 500), F.lit(False))


def overfit_monitor(log: DataFrame, by: list[str]) -> DataFrame:
    """by, initial, final, delta, state from rows (step, eval_loss)."""
    ends = log.where("eval_loss IS NOT NULL").groupBy(*by).agg(F.min_by("eval_loss", "step").alias("initial"), F.max_by("eval_loss", "step").alias("final"))
    delta = F.bround(F.col("final") - F.col("initial"), 6)
    return ends.withColumn("delta", delta).withColumn("state", F.when(delta > 0.05, "possible_overfit").when(delta < -0.05, "no_overfit").otherwise("stable"))


def token_stats(rows: DataFrame, by: list[str], tokens: str, labels: str, most: int) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("count"),
        *[f(tokens).alias(f"{name}_tokens") for name, f in (("min", F.min), ("max", F.max))],
        F.bround(F.avg(tokens), 3).alias("avg_tokens"),
        *[f(labels).alias(f"{name}_label_tokens") for name, f in (("min", F.min), ("max", F.max))],
        F.bround(F.avg(labels), 3).alias("avg_label_tokens"),
        F.count_if(F.col(tokens) > most).alias("truncated_count"),
        F.count_if(F.col(labels) == 0).alias("zero_label_count"),
    )
