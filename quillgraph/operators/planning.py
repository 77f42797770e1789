"""Experiment plans, prompt templates and provenance records."""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = ("S", "F", "C", "P")


def normal_combination(value: Column) -> Column:
    """Dimensions in canonical order, joined by +; null for unknown or repeated ones."""
    parts = F.filter(F.split(F.upper(value), r"[+,/\s]+"), lambda x: x != "")
    order = F.array(*map(F.lit, DIMENSIONS))
    known = F.size(F.array_except(parts, order)) == 0
    single = F.size(F.array_distinct(parts)) == F.size(parts)
    return F.when(known & single & (F.size(parts) > 0), F.array_join(F.array_intersect(order, parts), "+"))


def plan_matrix(models: DataFrame, combinations: DataFrame, tracks: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """One row for each model, combination and track with its status. All three lists are configuration, stated by hand."""
    every = models.select("model").crossJoin(F.broadcast(combinations.select("combination"))).crossJoin(F.broadcast(tracks.select("track")))
    if prompts is not None:
        every = every.join(prompts.select("combination", "track", F.lit(True).alias("has_prompt")), ["combination", "track"], "left")
    else:
        every = every.withColumn("has_prompt", F.lit(False))
    needs = F.exists(F.split("combination", r"\+"), lambda d: d.isin("S", "F", "C"))
    status = F.when(needs & ~F.coalesce("has_prompt", F.lit(False)), "requires_prompt_assembly").when(F.contains("combination", F.lit("P")), "ready_with_postprocess_plan").otherwise("ready")
    return every.withColumn("status", status).drop("has_prompt")


def assemble_prompt(base: str, sections: list[tuple[str, str]], placeholders: tuple[str, ...]) -> str:
    """The base with sections put before its first placeholder; every placeholder must occur once and stay."""
    for p in placeholders:
        if base.count(p) != 1:
            raise ValueError(f"{p} must occur once")
    at = min((base.index(p) for p in placeholders), default=len(base))
    added = "".join(f"## {title}\n\n{body.strip()}\n\n" for title, body in sections)
    return base[:at] + added + base[at:]


def expand_env(value: Any, env: dict[str, str] | None = None) -> Any:
    """``${NAME:-default}`` in all strings of a configuration."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    if not isinstance(value, str):
        return value
    return re.sub(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or m[2] or "", value)


def env_file(text: str) -> dict[str, str]:
    """NAME=value lines; comments and blank lines are passed over, one pair of quotes is taken off."""
    found = {}
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#") and "=" in line:
            name, _, value = line.removeprefix("export ").partition("=")
            found[name.strip()] = re.sub(r"""^(["'])(.*)\1$""", r"\2", value.strip())
    return found


def merge_maps(base: dict, over: dict, deep: bool = True) -> dict:
    out = dict(base)
    for key, value in over.items():
        out[key] = merge_maps(out[key], value) if deep and isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_config(path: str, required: tuple[str, ...] = ()) -> dict:
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict) or (missing := [k for k in required if k not in found]):
        raise ValueError(f"{path}: a mapping with {', '.join(required)} is needed" + (f"; missing {missing}" if isinstance(found, dict) else ""))
    return found


def case_manifest(cases: DataFrame, files: DataFrame) -> DataFrame:
    """The identifying fields of each case with the SHA-256 of its file (case_id, content)."""
    kept = [c for c in ("case_id", "repo_key", "commit_sha", "task_type", "direction", "target", "target_type", "difficulty", "scope", "max_depth") if c in cases.columns]
    return cases.select(*kept).join(files.select("case_id", F.sha2("content", 256).alias("file_sha256")), "case_id", "left")


def version_record(spark: SparkSession, commit: str | None, dirty: bool | None, versions: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(commit, dirty, versions)], "commit string, dirty boolean, versions map<string,string>").withColumn("created_at", F.current_timestamp())


def relative_to(path: str, root: str) -> str:
    """The path under ``root`` with forward slashes, or as it is."""
    try:
        return Path(path).resolve().relative_to(Path(root).resolve()).as_posix()
    except ValueError:
        return Path(path).as_posix()
