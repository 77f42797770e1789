"""Tool calls of agents under budgets, as folds over each case's ordered events, and the agent loop itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.paths import TOOL_IGNORED_PARTS, is_ignored_path
from quillgraph.functions.text import glob_pattern

MAX_CALLS, MAX_FILES, MAX_TOKENS, MAX_STEPS = 20, 12, 24_000, 12


def call_budget(events: DataFrame, case: str, order: list[str], most: int = MAX_CALLS) -> DataFrame:
    """Events with their number and ``allowed``; all stay in the trace, only the first ``most`` count."""
    nth = F.row_number().over(Window.partitionBy(case).orderBy(*order))
    return events.withColumn("call", nth).withColumn("allowed", F.col("call") <= most)


def read_budget(reads: DataFrame, case: str, order: str, max_files: int = MAX_FILES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """case, order, file, state, given: what each read gives under the limits on distinct files and on tokens.

    A new file beyond the limit is refused (``file_budget``); a text over the remaining tokens is cut to four
    characters a token (``truncated``); with none left it is refused (``token_budget``). ``reads``: file, chars.
    The reads of one case are at most those its calls allow, so its list is short.
    """
    listed = reads.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("file").alias("f"), F.col("chars").cast("long").alias("c")))).alias("xs"))
    kinds = dict(reads.dtypes)
    item = f"struct<o: {kinds[order]}, f: {kinds['file']}, state: string, given: bigint>"
    start = F.expr(f"named_struct('files', CAST(array() AS array<{kinds['file']}>), 'used', 0L, 'out', CAST(array() AS array<{item}>))")

    def step(acc: Column, x: Column) -> Column:
        new = ~F.array_contains(acc["files"], x["f"])
        left = F.lit(max_tokens) - acc["used"]
        want = F.when(x["c"] == 0, F.lit(0)).otherwise(F.floor((x["c"] + 3) / 4)).cast("long")
        state = F.when(new & (F.size(acc["files"]) >= max_files), "file_budget").when(left <= 0, "token_budget").when(want > left, "truncated").otherwise("ok")
        given = F.when(state == "ok", x["c"]).when(state == "truncated", left * 4).otherwise(F.lit(0)).cast("long")
        cost = F.when(state == "ok", want).when(state == "truncated", left).otherwise(F.lit(0)).cast("long")
        files = F.when(new & (state != "file_budget"), F.concat(acc["files"], F.array(x["f"]))).otherwise(acc["files"])
        row = F.struct(x["o"].alias("o"), x["f"].alias("f"), state.alias("state"), given.alias("given"))
        return F.struct(files.alias("files"), (acc["used"] + cost).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    return listed.select(case, F.explode(F.aggregate("xs", start, step)["out"]).alias("x")).select(case, F.col("x.o").alias(order), F.col("x.f").alias("file"), "x.state", "x.given")


def list_files(files: DataFrame, pattern: str, most: int = 200) -> DataFrame:
    """path, count, truncated of the files whose path or name fits a shell pattern, in path order."""
    fits = F.col("path").rlike(glob_pattern(pattern)) | F.substring_index("path", "/", -1).rlike(glob_pattern(pattern))
    hit = files.where(fits & ~is_ignored_path("path", TOOL_IGNORED_PARTS)).select("path")
    total = hit.agg(F.count("*").alias("count"))
    return hit.orderBy("path").limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("count") > most)  # one row of totals


def search_text(lines: DataFrame, query: str, most: int = 50) -> DataFrame:
    """file, line, text of the lines that hold a literal, in order; truncated as soon as the limit is reached."""
    hit = lines.where(F.contains("text", F.lit(query))).orderBy("file", "line").limit(most)
    total = hit.agg(F.count("*").alias("n"))
    return hit.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("n") >= most).drop("n")  # one row of totals


def trace(events: DataFrame, content: str = "content", most: int = 2000) -> DataFrame:
    return events.withColumn(content, F.substring(content, 1, most))


def agent_loop(cases: DataFrame, schema: str, act: Callable[[dict, list[dict]], dict], tool: Callable[[dict, dict], dict], steps: int = MAX_STEPS) -> DataFrame:
    """Runs a pluggable agent on each case: case_id, step, action, payload.

    ``act`` gets the case and the messages so far and returns {"action": name, ...}; ``final`` ends the case; after
    ``steps`` a final answer is forced. Each case is one row of an Arrow batch; nothing else is gathered.
    """
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for case in batch.to_dict("records"):
                seen: list[dict] = []
                for step in range(1, steps + 2):
                    forced = step > steps
                    action = act(case, [*seen, {"role": "user", "content": "answer now"}] if forced else seen)
                    if forced and action.get("action") != "final":
                        action = {"action": "final", "prediction": None}
                    out.append((case["case_id"], step, action["action"], json.dumps(action, sort_keys=True)))
                    if action["action"] == "final":
                        break
                    seen.append({"role": "tool", "content": tool(case, action)})
            yield pd.DataFrame(out, columns=["case_id", "step", "action", "payload"])

    return cases.mapInPandas(run, schema)


def run_batch(cases: DataFrame, call: Callable[[dict], dict], parallel: int = 4, attempts: int = 3) -> DataFrame:
    """case_id, status, result, attempts of a pluggable provider; failures are rows, not lost tasks.

    Cases are spread over ``parallel`` partitions; the caller orders results by its own index.
    """
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for case in batch.to_dict("records"):
                state, result, tried = "error", None, 0
                while tried < attempts and state != "ok":
                    tried += 1
                    try:
                        result, state = json.dumps(call(case), sort_keys=True), "ok"
                    except Exception as problem:  # noqa: BLE001  any provider error becomes a row
                        result = json.dumps({"error": str(problem)})
                out.append((case["case_id"], state, result, tried))
            yield pd.DataFrame(out, columns=["case_id", "status", "result", "attempts"])

    kind = dict(cases.dtypes)["case_id"]
    return cases.repartition(parallel).mapInPandas(run, f"case_id {kind}, status string, result string, attempts int")
