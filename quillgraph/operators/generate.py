"""Deterministic synthetic training samples: a template table joined to a range of numbers.

Sample i follows template (i - 1) mod 29; every fifth sample is in dev; five in a row share a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: per template the kind, task, negative type or boundary type, number of edges and tags
TEMPLATES = (
    ("positive", "find_callees", "none", 1, "positive_call_edges callee_direction_cases direct_call evidence_output_cases"),
    ("positive", "find_callers", "none", 1, "positive_call_edges caller_direction_cases"),
    ("negative", "find_callers", "same_name_distractor", 0, "negative_non_call_cases same_name_distractors"),
    ("negative", "find_callees", "import_only", 0, "negative_non_call_cases import_or_string_not_call"),
    ("boundary", "find_callees", "callback_registration", 1, "callback_registration_boundary dynamic_boundary"),
    ("boundary", "find_callees", "runtime_dispatch", 1, "runtime_only_boundary dynamic_boundary"),
    ("positive", "find_callees", "none", 1, "constructor_symbol_cases positive_call_edges"),
    ("positive", "find_callees", "none", 1, "positive_call_edges async async_call_edges"),
    ("negative", "find_callees", "string_or_comment_only", 0, "negative_non_call_cases import_or_string_not_call"),
    ("positive", "find_callees", "none", 1, "positive_call_edges class_method callee_direction_cases object_method_calls"),
    ("positive", "find_callees", "none", 1, "positive_call_edges constructor_symbol_cases explicit_init_calls callee_direction_cases"),
    ("positive", "find_callers", "none", 3, "positive_call_edges caller_direction_cases large_fan_in_cases evidence_output_cases"),
    ("negative", "find_callees", "tests_excluded", 0, "negative_non_call_cases tests_excluded"),
    ("negative", "find_callees", "external_boundary", 0, "negative_non_call_cases external_boundary"),
    ("boundary", "find_callees", "decorator_registration", 1, "callback_registration_boundary decorator_registration dynamic_boundary"),
    ("boundary", "find_callees", "factory_return", 2, "runtime_only_boundary factory_return_cases polymorphism_cases dynamic_boundary"),
    ("negative", "find_callers", "no_callers", 0, "negative_non_call_cases no_callers"),
    ("negative", "find_callees", "no_callees", 0, "negative_non_call_cases no_callees"),
    ("positive", "find_callees", "none", 1, "positive_call_edges object_method_calls callee_direction_cases"),
    ("positive", "find_callees", "none", 1, "positive_call_edges constructor_symbol_cases callee_direction_cases"),
    ("positive", "find_callees", "none", 1, "positive_call_edges object_method_calls callee_direction_cases"),
    ("positive", "find_callers", "none", 1, "positive_call_edges caller_direction_cases import_or_string_not_call"),
    ("boundary", "find_callees", "callback_registration", 1, "callback_registration_boundary object_method_calls dynamic_boundary"),
    ("positive", "find_callees", "none", 1, "positive_call_edges async async_call_edges callee_direction_cases"),
    ("positive", "find_callees", "none", 4, "positive_call_edges callee_direction_cases multi_edge_outputs line_numbered_evidence_cases constructor_symbol_cases object_method_calls"),
    ("positive", "find_callees", "none", 3, "positive_call_edges callee_direction_cases multi_edge_outputs depth_2_call_chains line_numbered_evidence_cases evidence_output_cases"),
    ("positive", "find_callers", "none", 1, "positive_call_edges caller_direction_cases same_name_distractors line_numbered_evidence_cases evidence_output_cases"),
    ("positive", "find_callees", "none", 3, "positive_call_edges callee_direction_cases multi_edge_outputs factory_return_cases line_numbered_evidence_cases evidence_output_cases"),
    ("negative", "find_callees", "same_name_distractor", 0, "negative_non_call_cases same_name_distractors object_method_calls"),
)
DEV_EVERY = 5


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, kind, task, kind_type, n, sorted(tags.split())) for i, (kind, task, kind_type, n, tags) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, sample_kind string, task_type string, kind_type string, edges int, tags array<string>")


def _edge(n: Column) -> Column:
    module = F.col("module")
    name = F.concat(F.lit("step_"), n.cast("string"))
    return F.struct(
        F.concat(module, F.lit(".api.handler.handle")).alias("caller"),
        F.concat(module, F.lit(".services.worker."), name).alias("callee"),
        F.concat(module, F.lit("/api/handler.py")).alias("file"),
        (n + 9 + F.col("template")).cast("int").alias("line"),
        F.concat(F.lit("result = "), name, F.lit("(payload)")).alias("evidence"),
        F.when(F.col("sample_kind") == "boundary", "dynamic_possible").otherwise("static_confirmed").alias("confidence_type"),
    )


def samples(spark: SparkSession, count: int) -> DataFrame:
    """One nested row a sample: id, split, repo, repo_group, target, edges by bucket, evidence, messages and flags."""
    numbered = spark.range(1, count + 1).withColumnRenamed("id", "i").withColumn("template", ((F.col("i") - 1) % len(TEMPLATES)).cast("int"))
    held = numbered.join(F.broadcast(templates(spark)), "template")  # 29 rows
    split = F.when(F.col("i") % DEV_EVERY == 0, "dev").otherwise("train")
    base = held.withColumns({
        "id": F.format_string("ft-synth-%04d", "i"),
        "split": split,
        "repo_group": F.floor((F.col("i") - 1) / DEV_EVERY).cast("int"),
        "module": F.format_string("pkg%03d", "i"),
        "direction": F.when(F.col("task_type") == "find_callers", "upstream").otherwise("downstream"),
        "max_depth": F.when(F.array_contains("tags", "depth_2_call_chains"), 2).otherwise(1),
    }).withColumn("repo", F.concat(F.lit("synthetic/"), F.col("split"), F.lit("-micro-"), F.lpad(F.col("repo_group").cast("string"), 2, "0")))
    made = F.transform(F.when(F.col("edges") > 0, F.sequence(F.lit(1), F.col("edges"))).otherwise(F.array().cast("array<int>")), _edge)
    none = F.filter(made, lambda _: F.lit(False))
    kind = F.col("sample_kind")
    required = F.when(kind == "positive", made).otherwise(none)
    runtime = F.when((kind == "boundary") & F.array_contains("tags", "runtime_only_boundary"), made).otherwise(none)
    optional = F.when((kind == "boundary") & ~F.array_contains("tags", "runtime_only_boundary"), made).otherwise(none)
    excluded = F.when(kind == "negative", F.array(F.struct(F.concat("module", F.lit(".reports.render")).alias("caller"), F.concat("module", F.lit(".billing.render")).alias("callee"), F.col("kind_type").alias("reason")))).otherwise(F.expr("CAST(array() AS array<struct<caller: string, callee: string, reason: string>>)"))
    full = base.withColumn("edges", F.struct(required.alias("required"), optional.alias("optional"), runtime.alias("runtime_only"), excluded.alias("excluded")))
    shown = F.transform(F.concat("edges.required", "edges.optional", "edges.runtime_only"), lambda e: F.struct(e["file"].alias("file"), e["line"].alias("line"), e["evidence"].alias("snippet"), F.concat_ws("->", e["caller"], e["callee"]).alias("edge_ref")))
    notes = F.transform("edges.excluded", lambda e: F.struct(F.lit("synthetic/unknown.py").alias("file"), F.lit(1).alias("line"), e["reason"].alias("snippet"), F.concat_ws("->", e["caller"], e["callee"]).alias("edge_ref")))
    answer = F.to_json(F.struct(F.col("id").alias("case_id"), F.col("edges.required").alias("edges")))
    asked = F.concat(F.lit("Find the repo-local call edges of "), F.col("module"), F.lit(".api.handler.handle in "), F.col("repo"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return full.select(
        "i", "id", "split", "repo", "repo_group", "task_type", "direction", "max_depth", "template", "sample_kind", "tags", "edges",
        F.concat("module", F.lit(".api.handler.handle")).alias("target"),
        F.concat(shown, notes).alias("evidence"),
        F.array(message("system", F.lit("Answer with JSON edges.")), message("user", asked), message("assistant", answer)).alias("messages"),
        F.struct((kind == "negative").alias("is_negative"), F.when(kind == "negative", F.col("kind_type")).otherwise("none").alias("negative_type")).alias("negative"),
        F.struct((kind == "boundary").alias("has_dynamic_boundary"), F.array(F.when(kind == "boundary", F.col("kind_type")).otherwise("none")).alias("boundary_types")).alias("dynamic_boundary"),
    )


def retagged(made: DataFrame, prefix: str = "ft-full-synth") -> DataFrame:
    """The samples under three-digit ids, in their answers too."""
    new = F.format_string(f"{prefix}-%03d", "i")
    messages = F.transform("messages", lambda m: F.when(m["role"] == "assistant", F.struct(m["role"].alias("role"), F.replace(m["content"], F.col("old"), F.col("id")).alias("content"))).otherwise(m))
    return made.withColumn("old", F.col("id")).withColumn("id", new).withColumn("messages", messages).drop("old")


def manifest(made: DataFrame) -> DataFrame:
    """One row of counts of a generated set."""
    kind = lambda k: F.count_if(F.col("sample_kind") == k)
    tag = lambda t: F.count_if(F.array_contains("tags", t))
    return made.agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "dev").alias("dev"),
        kind("positive").alias("positive"),
        kind("negative").alias("negative"),
        kind("boundary").alias("boundary"),
        tag("multi_edge_outputs").alias("multi_edge_outputs"),
        tag("depth_2_call_chains").alias("depth_2_call_chains"),
        F.count_distinct("repo").alias("repos"),
    )
