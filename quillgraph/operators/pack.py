"""Packing ranked context under a token budget, and the edge candidates read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import SKIPPED_CALLS, _c, boundary_role, call_expressions, call_receiver, call_tail, callback_arguments, markdown_cell, stripped

# fixed values of candidate classification
LOGGER_METHODS = ("debug", "info", "warning", "warn", "error", "exception", "critical", "log")
CONTAINER_METHODS = ("append", "extend", "get", "inc_value", "remove", "set_value", "setdefault")
SIGNAL_METHODS = ("connect", "disconnect", "send_catch_log", "send_catch_log_deferred")
EXTERNAL_ROOTS = ("asyncio", "base64", "boto3", "contextlib", "dataclasses", "datetime", "fastapi", "google", "logging", "pydispatch", "re", "sys", "tempfile", "twisted", "typing", "urllib", "warnings", "w3lib", "zope")


def greedy_pack(ranked: DataFrame, by: list[str], budget: int, rank: str = "rank", tokens: str = "tokens", unit: str = "unit") -> DataFrame:
    """by, unit, rank, tokens, slot of what fits, in rank order.

    A unit that would pass the budget is left out and later, smaller ones may still fit; the first is always taken.
    The lists are those of one case after top-k, so the fold runs over a bounded array.
    """
    listed = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(unit).alias("u"), F.col(tokens).cast("long").alias("t")))).alias("items"))
    kind = dict(ranked.dtypes)
    start = F.expr(f"named_struct('total', 0L, 'taken', CAST(array() AS array<struct<r: {kind[rank]}, u: {kind[unit]}, t: bigint>>))")

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["taken"]) == 0) | (acc["total"] + x["t"] <= budget)
        return F.when(fits, F.struct((acc["total"] + x["t"]).alias("total"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    folded = listed.select(*by, F.aggregate("items", start, step)["taken"].alias("taken"))
    return folded.select(*by, F.posexplode("taken").alias("slot", "x")).select(*by, F.col("x.u").alias(unit), F.col("x.r").alias(rank), F.col("x.t").alias(tokens), (F.col("slot") + 1).alias("slot"))


def rendered_part(fields: dict[str, Column], numbered: Column) -> Column:
    """A YAML header with a fenced block of numbered lines."""
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in fields.items()])
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n```\n"), numbered, F.lit("\n```"))


def rendered_prompt(template: str, values: dict[str, Column]) -> Column:
    """The template with each ``{{name}}`` put in once."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def markdown_rows(frame: DataFrame, by: list[str], order: list[str], columns: list[str], name: str = "table") -> DataFrame:
    """by, table: a Markdown table of the rows in order (bounded lists: candidates of one case)."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(c) for c in columns]), F.lit(" |"))
    keyed = frame.select(*by, F.struct(*[F.col(c) for c in order], row.alias("row")).alias("x"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    return keyed.groupBy(*by).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]), "\n")).alias(name))


def is_definition_line(line: Column) -> Column:
    s = stripped(line)
    return s.startswith("def ") | s.startswith("async def ") | s.startswith("class ")


def is_repo_local(symbol: Column, repo: Column, target: Column) -> Column:
    root = F.split_part(F.coalesce(target, F.lit("")), F.lit("."), F.lit(1))
    own = lambda r: (r != "") & ((symbol == r) | symbol.startswith(F.concat(r, F.lit("."))))
    return F.coalesce(own(F.coalesce(repo, F.lit(""))) | own(root), F.lit(False)) & (F.coalesce(symbol, F.lit("")) != "")


def is_logger_call(expression: Column, canonical: Column) -> Column:
    known = F.coalesce(canonical, F.lit(""))
    by_name = F.split_part(expression, F.lit("."), F.lit(1)).isin("logger", "logging") & call_tail(expression).isin(*LOGGER_METHODS)
    ends = F.contains(known, F.lit(".")) & call_tail(known).isin(*LOGGER_METHODS)
    return by_name | F.contains(known, F.lit(".logger.")) | (ends & F.contains(F.lower(known), F.lit("logger")))


def is_external_call(expression: Column, canonical: Column) -> Column:
    return F.split_part(F.coalesce(canonical, expression), F.lit("."), F.lit(1)).isin(*EXTERNAL_ROOTS)


def signal_hint(expression: Column, target: Column, manager: str | None) -> Column:
    """The manager's method for a call on something's ``.signals``, or in a case about the manager; else null."""
    if not manager:
        return F.lit(None).cast("string")
    tail = call_tail(expression)
    near = F.coalesce(call_receiver(expression), F.lit("")).endswith(".signals") | F.coalesce(target, F.lit("")).startswith(f"{manager}.")
    return F.when(tail.isin(*SIGNAL_METHODS) & near, F.concat(F.lit(f"{manager}."), tail))


def callee_hint(expression: Column, target: Column, imports: Column, local: Column, receivers: Column, manager: str | None = None) -> Column:
    """The symbol an expression calls, by the first rule that fits; null if none does. Aliases come as maps."""
    root = F.split_part(expression, F.lit("."), F.lit(1))
    suffix = F.substr(expression, F.length(root) + 1)
    parent = F.when(F.contains(target, F.lit(".")), F.regexp_replace(target, r"\.[^.]*$", ""))
    rest = F.substr(expression, F.lit(6))
    return (
        F.when((expression == "cls") & parent.isNotNull(), parent)
        .when(signal_hint(expression, target, manager).isNotNull(), signal_hint(expression, target, manager))
        .when(F.map_contains_key(imports, root), F.concat(F.try_element_at(imports, root), suffix))
        .when(F.map_contains_key(receivers, root) & suffix.rlike(r"^\.[^.]*$"), F.concat(F.try_element_at(receivers, root), suffix))
        .when(F.map_contains_key(local, root) & (suffix == ""), F.try_element_at(local, root))
        .when(expression.startswith("self.") & parent.isNotNull() & ~F.contains(rest, F.lit(".")), F.concat(parent, F.lit("."), rest))
        .when(F.contains(expression, F.lit(".")), expression)
    )


def candidate_status(expression: Column, canonical: Column, repo: Column, target: Column, external_deps: Column) -> Column:
    local = is_repo_local(canonical, repo, target)
    return (
        F.when(canonical.isNotNull() & (canonical == target), "primary")
        .when(is_logger_call(expression, canonical), "filtered_low_value")
        .when((external_deps == "exclude") & is_external_call(expression, canonical), "filtered_external")
        .when(call_tail(expression).isin(*CONTAINER_METHODS) & ~local, "filtered_low_value")
        .when(local, "primary")
        .otherwise("secondary")
    )


def caller_status(expression: Column, canonical: Column, target: Column, receivers: Column, manager: str | None = None) -> Column:
    """Status of a call that may reach the target: its receiver must be proven."""
    parent = F.when(F.contains(target, F.lit(".")), F.regexp_replace(target, r"\.[^.]*$", ""))
    known = F.try_element_at(receivers, F.split_part(expression, F.lit("."), F.lit(1)))
    same = (known == parent) | known.startswith(F.concat(parent, F.lit("."))) | parent.startswith(F.concat(known, F.lit(".")))
    return (
        F.when(~canonical.eqNullSafe(target), "secondary")
        .when(call_receiver(expression).isNull(), "primary")
        .when(signal_hint(expression, target, manager).eqNullSafe(target), "primary")
        .when(F.coalesce(same, F.lit(False)), "primary")
        .otherwise("secondary")
    )


def call_candidates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file, line, expression, evidence, role, callback_arguments of every call in the lines.

    One row for each file, line, caller and expression. ``lines`` has keys, file, line, text, caller.
    """
    spread = lines.select(*keys, "file", "line", "caller", stripped("text").alias("evidence"), F.explode(call_expressions("text")).alias("expression"))
    named = spread.where(~is_definition_line(F.col("evidence"))).withColumn("role", boundary_role("expression", "evidence")).withColumn("callback_arguments", callback_arguments("evidence"))
    return named.dropDuplicates([*keys, "file", "line", "caller", "expression"])


def visible_candidates(candidates: DataFrame, case: str, limit: int = 60) -> DataFrame:
    """Unfiltered candidates, primary ones first, then by rank, file, line and expression; none for a limit of 0."""
    shown = candidates.where(~F.col("status").startswith("filtered"))
    if not limit:
        return shown.limit(0)
    order = Window.partitionBy(case).orderBy(F.when(F.col("status") == "primary", 0).otherwise(1), F.coalesce("rank", F.lit(999999)), "file", F.coalesce("line", F.lit(999999)), "expression")
    return shown.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def local_aliases(symbols: DataFrame, keys: list[str], module: str = "module") -> DataFrame:
    """keys, tail, symbol of defined symbols under the module whose last part names one symbol only."""
    own = symbols.where(F.col("symbol").startswith(F.concat(F.col(module), F.lit(".")))).withColumn("tail", call_tail("symbol"))
    return own.groupBy(*keys, "tail").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol")).where("n = 1").drop("n")


RECEIVER_PATTERN = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*:\s*([A-Za-z_][A-Za-z0-9_.]*)"  # fixed value


def receiver_hints(lines: DataFrame, keys: list[str], aliases: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """keys, name, type: ``name: Type`` annotations in the target's body (``lines``: keys, line, text); the first wins,
    on equal lines the smallest type.

    ``aliases``: keys, alias, target, one row an alias. The type's first part is looked up there; a dotted type
    without one stands for itself, others give no hint. ``parents``: keys, parent of targets whose calls are
    asked for; there ``self`` and ``cls`` are the parent, whatever the annotations say.
    """
    found = F.regexp_extract_all("text", F.lit(RECEIVER_PATTERN), F.lit(1)), F.regexp_extract_all("text", F.lit(RECEIVER_PATTERN), F.lit(2))
    spread = lines.select(*keys, "line", F.posexplode(F.arrays_zip(found[0].alias("n"), found[1].alias("t"))).alias("p", "x")).select(*keys, "line", "p", F.col("x.n").alias("name"), F.col("x.t").alias("type"))
    spread = spread.where(~F.col("type").isin("None", "Self", *SKIPPED_CALLS)).withColumn("alias", F.substring_index("type", ".", 1))
    dotted = F.when(F.contains("type", F.lit(".")), F.col("type"))
    resolved = F.coalesce(F.concat("target", F.expr("substring(type, length(alias) + 1)")), dotted)
    known = spread.join(aliases.select(*keys, "alias", "target"), [*keys, "alias"], "left").select(*keys, "name", F.struct("line", "p").alias("at"), resolved.alias("type")).where("type is not null")
    if parents is not None:
        own = parents.where("parent <> ''").select(*keys, F.explode(F.array(F.lit("self"), F.lit("cls"))).alias("name"), F.struct(F.lit(-1).alias("line"), F.lit(0).alias("p")).alias("at"), F.col("parent").alias("type"))
        known = known.union(own)
    return known.groupBy(*keys, "name").agg(F.min(F.struct("at", "type"))["type"].alias("type"))


def import_lines(lines: DataFrame, keys: list[str], rank: str = "start_line") -> DataFrame:
    """keys, line, text: each line of overlapping chunks once (from the chunk that starts first), import blocks only.

    A block goes on while its parentheses are open or its line ends in a backslash.
    """
    once = lines.groupBy(*keys, "line").agg(F.min_by("text", rank).alias("text"))
    per_file = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("xs"))  # the head of one file
    start = F.expr("named_struct('open', 0, 'out', CAST(array() AS array<struct<line: int, text: string>>))")

    def step(acc: Column, x: Column) -> Column:
        begins = x["text"].rlike(r"^\s*(?:import|from)\s")
        inside = (acc["open"] > 0) | begins
        depth = F.length(F.regexp_replace(x["text"], r"[^(]", "")) - F.length(F.regexp_replace(x["text"], r"[^)]", ""))
        goes_on = F.rtrim(x["text"]).endswith("\\")
        # 1: an open parenthesis, 2: a backslash
        still = F.when(begins & (depth > 0), 1).when((acc["open"] == 1) & ~begins & ~F.contains(x["text"], F.lit(")")), 1).when(goes_on, 2).otherwise(0)
        return F.when(inside, F.struct(still.alias("open"), F.concat(acc["out"], F.array(F.struct(x["line"].cast("int").alias("line"), x["text"].alias("text")))).alias("out"))).otherwise(acc)

    return per_file.select(*keys, F.explode(F.aggregate("xs", start, step)["out"]).alias("x")).select(*keys, "x.*")


def definition_focus(chunks: DataFrame, case: str, limit: int = 8, lines: int = 41) -> DataFrame:
    """case, snippets: up to ``limit`` places where the target is defined, each cut to ``lines`` lines from there.

    ``chunks``: case, target, symbol_spans, start_line, rank, text. Chunks in which the definition starts come first.
    """
    spread = chunks.withColumn("span", F.explode("symbol_spans")).where(F.col("span.symbol") == F.col("target"))
    begins = F.col("span.start") >= F.col("start_line")
    skip = F.greatest(F.lit(0), F.col("span.start") - F.col("start_line"))
    snippet = F.array_join(F.slice(F.split("text", "\n"), skip + 1, F.lit(lines)), "\n")
    order = Window.partitionBy(case).orderBy(F.when(begins, 0).otherwise(1), "rank", "start_line")
    placed = spread.withColumn("snippet", snippet).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    return placed.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
