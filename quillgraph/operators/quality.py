"""Checks of labelled training samples and cases: rules as columns, errors as rows.

Every check returns rows (id, error), so the checks of a dataset are one union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import evidence_text


def rule_errors(frame: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, error) for each rule whose condition is not true; a null condition counts as not true."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return frame.select(key, F.explode(failed).alias("error"))


def enum_rule(column: str, allowed: tuple[str, ...], optional: bool = False) -> Column:
    ok = F.col(column).isin(*allowed)
    return ok | F.col(column).isNull() if optional else ok


def pattern_rule(column: str, pattern: str) -> Column:
    return F.col(column).rlike(f"^(?:{pattern})$")


def unique_rule(column: str) -> Column:
    return F.size(column) == F.size(F.array_distinct(column))


def edge_label_errors(edges: DataFrame, key: str) -> DataFrame:
    """Labels need caller, callee, file and evidence, and a positive line; excluded ones a reason, and place all or none."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    call = edges.where("bucket <> 'excluded'")
    rules = {f"{c} missing": filled(c) for c in ("caller", "callee", "file", "evidence")} | {"line not positive": F.col("line") > 0}
    place = [F.col(c).isNotNull() for c in ("file", "line", "evidence")]
    whole = (place[0] & place[1] & place[2]) | ~(place[0] | place[1] | place[2])
    return rule_errors(call, key, rules).union(rule_errors(edges.where("bucket = 'excluded'"), key, {"caller missing": filled("caller"), "callee missing": filled("callee"), "reason missing": filled("reason"), "place incomplete": whole}))


def consistency_rules() -> dict[str, Column]:
    """Of samples with is_negative, negative_type, required_count, has_dynamic_boundary, boundary_types, evidence_count."""
    dynamic = ~F.array_contains("boundary_types", "none") & (F.size("boundary_types") > 0)
    return {
        "negative with required edges": ~F.col("is_negative") | (F.col("required_count") == 0),
        "negative without type": ~F.col("is_negative") | (F.col("negative_type") != "none"),
        "type on a positive": F.col("is_negative") | (F.col("negative_type") == "none"),
        "dynamic flag and types differ": F.col("has_dynamic_boundary") == dynamic,
        "no evidence": F.col("evidence_count") > 0,
    }


def mirror_rules(pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    return {name: F.col(a).eqNullSafe(F.col(b)) for name, (a, b) in pairs.items()}


def message_errors(messages: DataFrame, key: str, order: str = "turn", json: bool = False) -> DataFrame:
    """Conversations whose last message is not the assistant's or, with ``json``, not a JSON value."""
    last = messages.groupBy(key).agg(F.max_by("role", order).alias("role"), F.max_by("text", order).alias("text"))
    rules = {"last role is not assistant": F.col("role") == "assistant"}
    if json:
        rules["last message is not JSON"] = F.try_parse_json("text").isNotNull()
    return rule_errors(last, key, rules)


def leakage(samples: DataFrame, blocked: DataFrame, key: str, repo: str = "repo", split: str = "split") -> DataFrame:
    """Samples of train or dev from blocked repositories (column repo), compared trimmed and in lower case."""
    norm = lambda c: F.lower(F.trim(c))
    train = samples.where(F.col(split).isin("train", "dev")).withColumn("norm_repo", norm(repo))
    return train.join(blocked.select(norm("repo").alias("norm_repo")).distinct(), "norm_repo", "left_semi").select(key, F.lit("blocked repository").alias("error"))


def derived_leakage(samples: DataFrame, key: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Training samples whose source_refs begin with a test case's or repository's name."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.exists("source_refs", lambda r, p=p: F.lower(r).startswith(p.lower()))
    return samples.where(F.col("split").isin("train", "dev") & hit).select(key, F.lit("derived from test data").alias("error"))


def split_isolation(samples: DataFrame, group: str, split: str = "split") -> DataFrame:
    """group, splits of groups that are in several splits."""
    seen = samples.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return seen.where(F.size("splits") > 1).select(group, F.array_join("splits", ",").alias("splits"))


def duplicates(samples: DataFrame, key: str, content: list[str], order: str) -> DataFrame:
    """Rows whose content an earlier row has: key, fingerprint, first_key."""
    print_ = F.sha2(F.to_json(F.struct(*[F.col(c) for c in content]), {"ignoreNullFields": "false"}), 256)
    marked = samples.select(key, order, print_.alias("fingerprint")) if order != key else samples.select(key, print_.alias("fingerprint"))
    first = marked.groupBy("fingerprint").agg(F.min_by(key, order).alias("first_key"), F.count("*").alias("n")).where("n > 1").drop("n")
    return marked.join(first, "fingerprint").where(F.col(key) != F.col("first_key")).select(key, "fingerprint", "first_key")


def repeated_ids(samples: DataFrame, key: str) -> DataFrame:
    return samples.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def coverage_gaps(required: DataFrame, samples: DataFrame, tags: str = "tags") -> DataFrame:
    """Required tags that no sample has."""
    return required.join(samples.select(F.explode(tags).alias("tag")).distinct(), "tag", "left_anti")


def evidence_gaps(labels: DataFrame, evidence: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """key, missing, sample: labelled edges (bucket, edge_ref) without an evidence row."""
    left = labels.join(evidence.select(key, "bucket", "edge_ref").distinct(), [key, "bucket", "edge_ref"], "left_anti")
    return left.groupBy(key).agg(F.count("*").alias("missing"), F.slice(F.array_sort(F.collect_set("edge_ref")), 1, shown).alias("sample"))


def evidence_at_line(edges: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with a state: ok, evidence_mismatch, line_missing or file_missing. ``lines``: keys, line, text."""
    files = lines.select(*keys).distinct().withColumn("known", F.lit(True))
    held = edges.join(files, keys, "left").join(lines.select(*keys, "line", F.col("text").alias("at_line")), [*keys, "line"], "left")
    inside = F.contains(evidence_text("at_line"), evidence_text("evidence"))
    state = F.when(F.col("known").isNull(), "file_missing").when(F.col("at_line").isNull(), "line_missing").when(F.coalesce(inside, F.lit(False)), "ok").otherwise("evidence_mismatch")
    return held.withColumn("state", state).drop("known", "at_line")


def counts(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count("*").alias("n"))


def first_samples(samples: DataFrame, split: str, most: int, order: str) -> DataFrame:
    """The first ``most`` samples of a split in file order."""
    return samples.where(F.col("split") == split).orderBy(order).limit(most)


def formatted_messages(messages: DataFrame, key: str, order: str = "turn") -> DataFrame:
    r"""key, sample: ``<|role|>`` and content of each message in turn, closed by ``<|end|>`` (one conversation a row)."""
    part = F.concat(F.lit("<|"), F.trim("role"), F.lit("|>\n"), F.trim("text"))
    listed = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))).alias("xs"))
    return listed.select(key, F.concat(F.array_join(F.transform("xs", lambda x: x["p"]), "\n"), F.lit("\n<|end|>")).alias("sample"))


def masked_labels(messages: DataFrame, key: str, most: int, order: str = "turn") -> DataFrame:
    """key, tokens, labels, kept, kept_labels: white-space tokens of a conversation, those of assistants, after truncation.

    A conversation over ``most`` tokens keeps its end; tokens of other roles are masked.
    """
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    listed = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.transform(words, lambda w: F.col("role") == "assistant").alias("m")))).alias("xs"))
    mask = F.flatten(F.transform("xs", lambda x: x["m"]))
    held = listed.select(key, mask.alias("mask")).withColumn("tail", F.slice("mask", F.greatest(F.size("mask") - most, F.lit(0)) + 1, F.lit(most)))
    on = lambda c: F.size(F.filter(c, lambda x: x))
    return held.select(key, F.size("mask").alias("tokens"), on("mask").alias("labels"), F.size("tail").alias("kept"), on("tail").alias("kept_labels"))


def first_wins(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    return frame.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("nth = 1").drop("nth")
