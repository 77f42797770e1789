"""Reading and writing the file formats of cases, repositories, predictions and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.paths import indexable
from quillgraph.functions.text import lines_of

EDGE_FIELDS = T.StructType([T.StructField(n, T.IntegerType() if n == "line" else T.StringType()) for n in ("caller", "callee", "file", "line", "evidence", "confidence_type", "notes")])


def binary_files(spark: SparkSession, paths: str | list[str], glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content; content is read only where it is selected."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(paths)


def case_files(spark: SparkSession, paths: str | list[str], glob: str = "*.yaml") -> DataFrame:
    """Distinct case files in path order; equal paths but for case count once."""
    found = binary_files(spark, paths, glob).where(~F.col("path").endswith(".gitkeep"))
    w = Window.partitionBy(F.lower("path")).orderBy("path")
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth").orderBy("path")


def yaml_records(files: DataFrame, schema: str | T.StructType | None = None) -> DataFrame:
    """path, json (and ``value`` of the schema, if given), error of YAML files; the document becomes JSON once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, json.dumps(yaml.safe_load(bytes(content).decode("utf-8", "replace")), default=str), None))
                except yaml.YAMLError as problem:
                    rows.append((path, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "json", "error"])

    found = files.select("path", "content").mapInPandas(read, "path string, json string, error string")
    return found if schema is None else found.withColumn("value", F.from_json("json", schema))


def json_documents(spark: SparkSession, paths: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON; a path that is not there gives no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", "true").json(paths)
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], spark.read.schema(schema).json(spark.sparkContext.emptyRDD()).schema)


def json_lines(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One object a line. Not ``strict``: bad lines are kept whole in ``_corrupt_record`` instead of failing the read."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return spark.read.schema(T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(paths)


def numbered_json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no, text, error of each line that is not blank (for files that one task can hold)."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("i", "text"))
    object_ = F.get_json_object("text", "$").startswith("{")
    return whole.where(F.trim("text") != "").select("path", (F.col("i") + 1).alias("line_no"), "text", F.when(~F.coalesce(object_, F.lit(False)), "not a JSON object").alias("error"))


def source_files(spark: SparkSession, roots: dict[str, str], suffixes: tuple[str, ...] = (".py", ".pyi"), include_tests: bool = False, max_bytes: int = 512_000) -> DataFrame:
    """repo, file, length, content, reason of the files under each root; reason is null for the ones to index."""
    every = None
    for repo, root in roots.items():
        found = binary_files(spark, root)
        cut = F.regexp_replace("path", r"^[a-z]+:/+", "/")
        rel = F.substr(cut, F.lit(len(root.rstrip("/")) + 2))
        one = found.select(F.lit(repo).alias("repo"), rel.alias("file"), "length", "content").withColumn("reason", indexable("file", "length", suffixes, include_tests, max_bytes))
        every = one if every is None else every.unionByName(one)
    return every


def file_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line (from 1), text."""
    return files.select(*keys, F.posexplode(lines_of(text)).alias("i", "text")).select(*keys, (F.col("i") + 1).alias("line"), "text")


def repos(spark: SparkSession, path: str) -> DataFrame:
    """repo_key, name, url, local_path, commit_sha, default_branch of a registry file."""
    shape = "map<string, struct<name: string, url: string, local_path: string, commit_sha: string, default_branch: string>>"
    found = yaml_records(binary_files(spark, path, recursive=False))
    inner = F.coalesce(F.get_json_object("json", "$.repos"), F.col("json"))
    return found.select(F.explode(F.from_json(inner, shape)).alias("repo_key", "r")).select("repo_key", "r.*")


def unknown_repos(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """Cases whose repository is not registered or has no path."""
    return cases.join(registry.where("local_path IS NOT NULL").select("repo_key"), "repo_key", "left_anti")


def prediction_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text of prediction files below the paths."""
    return binary_files(spark, paths).where(F.substring_index("path", "/", -1).rlike(r"^predictions?\.(?:ya?ml|json|txt)$")).select("path", F.decode("content", "UTF-8").alias("text"))


def latest_index(spark: SparkSession, root: str) -> str | None:
    """The index folder whose manifest is newest."""
    found = binary_files(spark, root, "manifest.json").select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return found.path.rsplit("/", 1)[0] if found else None


def write_table(frame: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    writer = frame.write.mode("overwrite").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_single(frame: DataFrame, path: str, form: str = "json") -> None:
    """A small report as one file."""
    frame.coalesce(1).write.mode("overwrite").format(form).save(path)


def write_yaml(value: object, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as out:
        yaml.safe_dump(value, out, allow_unicode=True, sort_keys=False)


def report(frame: DataFrame, columns: list[str], places: int = 3) -> list[str]:
    """Lines of a Markdown table of a small report; floats with three places, n/a for null."""
    kinds = dict(frame.dtypes)
    shown = [F.coalesce(F.format_number(c, places) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in columns]
    rows = frame.select(*shown).limit(1000).collect()
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(r) + " |" for r in rows)]
