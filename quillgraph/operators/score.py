"""Scoring predicted edges against bucketed golden edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import _c, evidence_text, safe_ratio, slashes

#: On a key in several buckets, the later overrules the earlier.
BUCKETS = ("required", "optional", "runtime_only", "excluded")


def bucket_rank(bucket: Column | str) -> Column:
    rank = F.lit(0)
    for k, name in enumerate(BUCKETS):
        rank = F.when(_c(bucket) == name, k + 1).otherwise(rank)
    return rank


def edge_id(caller: Column | str, callee: Column | str) -> Column:
    return F.concat(F.trim(_c(caller)), F.lit(" -> "), F.trim(_c(callee)))


def evidence_matches(pred: dict[str, Column], gold: dict[str, Column], tolerance: int = 0) -> Column:
    """Same file, lines within the tolerance, and one text inside the other after white space is collapsed.

    An empty predicted text never matches; a null anywhere gives false.
    """
    p, g = evidence_text(pred["evidence"]), evidence_text(F.coalesce(gold["evidence"], F.lit("")))
    near = F.abs(pred["line"] - gold["line"]) <= tolerance
    return F.coalesce((slashes(pred["file"]) == slashes(gold["file"])) & near & (p != "") & (F.contains(g, p) | F.contains(p, g)), F.lit(False))


def is_constructor_edge(callee: Column, notes: Column | None = None) -> Column:
    own = callee.endswith(".__init__")
    if notes is None:
        return own
    low = F.lower(F.coalesce(notes, F.lit("")))
    return own | F.contains(low, F.lit("constructor")) | F.contains(low, F.lit("class construction"))


def constructor_alias(callee: Column) -> Column:
    return F.when(callee.endswith(".__init__"), F.regexp_replace(callee, r"\.__init__$", "")).otherwise(F.concat(callee, F.lit(".__init__")))


def golden_index(golden: DataFrame, case: str = "case_id") -> DataFrame:
    """One row for each key of a case: the golden edge of the bucket that overrules the others."""
    w = Window.partitionBy(case, "caller", "callee").orderBy(F.desc(bucket_rank("bucket")), F.desc("pos"))
    return golden.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def alias_index(golden: DataFrame, exact: DataFrame, case: str = "case_id") -> DataFrame:
    """case, caller, alias, callee: other spellings of constructor edges that no exact key and one golden entry has."""
    notes = F.col("notes") if "notes" in golden.columns else None
    spelled = golden.where(is_constructor_edge(F.col("callee"), notes)).select(case, "caller", constructor_alias(F.col("callee")).alias("alias"), "callee")
    single = spelled.groupBy(case, "caller", "alias").agg(F.count("*").alias("n"), F.first("callee").alias("callee")).where("n = 1").drop("n")
    return single.join(exact.select(case, "caller", F.col("callee").alias("alias")), [case, "caller", "alias"], "left_anti")


def match_edges(predicted: DataFrame, golden: DataFrame, case: str = "case_id", constructors: bool = False, tolerance: int = 0) -> DataFrame:
    """The first of each predicted key with its golden ``bucket`` (null if unmatched) and ``evidence_ok``.

    Columns also: ``duplicate`` and ``malformed`` rows are kept and marked. With ``constructors`` an edge that no
    exact key fits may match by its other constructor spelling, and a second one that reaches the same golden key
    is marked ``normalised_duplicate``.
    """
    blank = (F.coalesce(F.trim("caller"), F.lit("")) == "") | (F.coalesce(F.trim("callee"), F.lit("")) == "")
    ordered = predicted.withColumn("malformed", blank).withColumn("nth", F.row_number().over(Window.partitionBy(case, "caller", "callee").orderBy("pos")))
    named = ordered.withColumn("duplicate", ~F.col("malformed") & (F.col("nth") > 1)).drop("nth")
    exact = golden_index(golden, case)
    key = "callee"
    if constructors:
        alias = alias_index(golden, exact, case).select(case, "caller", F.col("alias").alias("callee"), F.col("callee").alias("golden_callee"))
        named = named.join(exact.select(case, "caller", "callee", F.lit(True).alias("known")), [case, "caller", "callee"], "left").join(alias, [case, "caller", "callee"], "left")
        named = named.withColumn("golden_key", F.when(F.col("known"), F.col("callee")).otherwise(F.coalesce("golden_callee", "callee"))).drop("known", "golden_callee")
        again = Window.partitionBy(case, "caller", "golden_key").orderBy(F.when(F.col("duplicate") | F.col("malformed"), 1).otherwise(0), "pos")
        named = named.withColumn("normalised_duplicate", ~F.col("duplicate") & ~F.col("malformed") & (F.row_number().over(again) > 1))
        key = "golden_key"
    gold = exact.select(case, "caller", F.col("callee").alias(key), "bucket", F.col("file").alias("g_file"), F.col("line").alias("g_line"), F.col("evidence").alias("g_evidence"))
    joined = named.join(gold, [case, "caller", key], "left")
    ok = evidence_matches({c: F.col(c) for c in ("file", "line", "evidence")}, {c: F.col(f"g_{c}") for c in ("file", "line", "evidence")}, tolerance)
    return joined.withColumn("evidence_ok", F.col("bucket").isNotNull() & (F.col("bucket") != "excluded") & ok).drop("g_file", "g_line", "g_evidence")


def case_scores(cases: DataFrame, golden: DataFrame, matched: DataFrame, case: str = "case_id") -> DataFrame:
    """Counts and ratios per case; cases without predictions count with zero edges."""
    gone = F.col("malformed") | F.col("duplicate")
    if "normalised_duplicate" in matched.columns:
        gone = gone | F.col("normalised_duplicate")
    use = ~gone
    hit = lambda b: F.count_if(use & (F.col("bucket") == b))
    accepted = use & F.col("bucket").isin(*BUCKETS[:3])
    counts = matched.groupBy(case).agg(
        F.count_if(use).alias("predicted_edges"),
        F.count_if("malformed").alias("malformed_predictions"),
        F.count_if(gone & ~F.col("malformed")).alias("duplicate_predictions"),
        *[hit(b).alias(f"matched_{b}") for b in BUCKETS],
        F.count_if(use & F.col("bucket").isNull()).alias("unmatched_predictions"),
        F.count_if(use & (F.col("bucket") == "required") & F.col("evidence_ok")).alias("evidence_ok_required"),
        F.count_if(accepted & F.col("evidence_ok")).alias("evidence_ok_accepted"),
    )
    gold = golden.groupBy(case).agg(*[F.count_if(F.col("bucket") == b).alias(f"{b}_edges") for b in BUCKETS])
    joined = cases.select(case).join(gold, case, "left").join(counts, case, "left").na.fill(0)
    taken = F.col("matched_required") + F.col("matched_optional") + F.col("matched_runtime_only")
    return joined.withColumns({
        "accepted_predictions": taken,
        "edge_precision": safe_ratio(taken, "predicted_edges"),
        "edge_recall": safe_ratio("matched_required", "required_edges"),
        "evidence_accuracy": safe_ratio("evidence_ok_required", "matched_required"),
        "evidence_accuracy_all": safe_ratio("evidence_ok_accepted", taken),
    })


def missing_edges(golden: DataFrame, matched: DataFrame, case: str = "case_id") -> DataFrame:
    """case, missing_required: sorted ids of required golden edges that no prediction matched as required."""
    key = "golden_key" if "golden_key" in matched.columns else "callee"
    found = matched.where("bucket = 'required' AND NOT malformed").select(case, "caller", F.col(key).alias("callee")).distinct()
    left = golden.where("bucket = 'required'").select(case, "caller", "callee").join(found, [case, "caller", "callee"], "left_anti")
    return left.groupBy(case).agg(F.array_sort(F.collect_list(edge_id("caller", "callee"))).alias("missing_required"))


def total_scores(scores: DataFrame) -> DataFrame:
    """One row over all cases. Evidence sums the rounded ratios of the cases times their matched edges."""
    sums = ["required_edges", "predicted_edges", "matched_required", "matched_optional", "matched_runtime_only", "matched_excluded", "accepted_predictions", "unmatched_predictions", "malformed_predictions", "duplicate_predictions"]
    whole = scores.agg(F.count("*").alias("case_count"), *[F.sum(c).alias(c) for c in sums], F.sum(F.bround(F.col("evidence_accuracy") * F.col("matched_required"))).alias("ev"))
    return whole.select(
        "case_count",
        *sums,
        safe_ratio("accepted_predictions", "predicted_edges").alias("edge_precision"),
        safe_ratio("matched_required", "required_edges").alias("edge_recall"),
        safe_ratio(F.coalesce("ev", F.lit(0)), "matched_required").alias("evidence_accuracy"),
    )


def bucket_scores(scores: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of each key (grouping sets). Precision is matched required over predicted here."""
    ok = F.bround(F.col("evidence_accuracy") * F.col("accepted_predictions"))
    held = scores.withColumn("ok", F.coalesce(ok, F.lit(0.0)))
    grouped = held.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]) if len(keys) > 1 else held.groupBy(*keys)
    summed = grouped.agg(F.count("*").alias("case_count"), *[F.sum(c).alias(c) for c in ("required_edges", "predicted_edges", "matched_required", "accepted_predictions", "ok")])
    return summed.select(*keys, "case_count", "required_edges", "predicted_edges", "matched_required", safe_ratio("matched_required", "predicted_edges").alias("edge_precision"), safe_ratio("matched_required", "required_edges").alias("edge_recall"), safe_ratio("ok", "accepted_predictions").alias("evidence_accuracy"))


def compare(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, and for each metric its value before, after, and the change; null where one side has none."""
    a = before.select(key, *[F.col(m).alias(f"{m}_before") for m in metrics])
    b = after.select(key, *[F.col(m).alias(f"{m}_after") for m in metrics])
    joined = a.join(b, key, "full_outer")
    return joined.select(key, *[c for m in metrics for c in (f"{m}_before", f"{m}_after")], *[F.bround(F.col(f"{m}_after") - F.col(f"{m}_before"), 6).alias(f"{m}_delta") for m in metrics])


def id_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, state: ``missing`` or ``extra``; ids on both sides are absent. One pass of a full outer join."""
    e, f = expected.select(key, F.lit(1).alias("e")).distinct(), found.select(key, F.lit(1).alias("f")).distinct()
    return e.join(f, key, "full_outer").where("e IS NULL OR f IS NULL").select(key, F.when(F.col("f").isNull(), "missing").otherwise("extra").alias("state"))


def mock_golden(golden: DataFrame) -> DataFrame:
    """The required golden edges as a prediction: scores 1 wherever there are any."""
    return golden.where("bucket = 'required'").select("case_id", "pos", "caller", "callee", "file", "line", "evidence")


def canonical_symbols(symbols: DataFrame, aliases: DataFrame, symbol: str = "symbol") -> DataFrame:
    """``symbols`` with ``canonical``: the exact alias, else the longest alias that is a dotted prefix, else itself."""
    asked = symbols.select(symbol).distinct()
    prefixes = asked.withColumn("parts", F.split(symbol, r"\.")).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts")))).select(symbol, "n", F.array_join(F.slice("parts", F.lit(1), F.col("n")), ".").alias("prefix"))
    hit = prefixes.join(aliases.select(F.col("alias").alias("prefix"), "target"), "prefix")
    best = hit.groupBy(symbol).agg(F.max_by(F.struct("prefix", "target"), "n").alias("b"))
    canonical = F.coalesce(F.concat(F.col("b.target"), F.substr(F.col(symbol), F.length("b.prefix") + 1)), F.col(symbol))
    return symbols.join(best, symbol, "left").withColumn("canonical", canonical).drop("b")


def audit_calls(calls: DataFrame, golden: DataFrame) -> DataFrame:
    """Calls (case_id, caller, canonical, line) that the golden edges of their case and caller lack."""
    known = golden.where("bucket <> 'excluded'").select("case_id", "caller", F.col("callee").alias("canonical"))
    return calls.join(known, ["case_id", "caller", "canonical"], "left_anti")
