"""Edge, case and result tables derived from the driver's tables by plain arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import index, lexical, rank
from quillgraph.session import table

CASES = 50
GOLD_SQL = """
gold AS (
    SELECT l_orderkey % 50 AS case_id, 's' || l_suppkey AS caller, 'p' || l_partkey || CASE WHEN l_partkey % 11 = 0 THEN '.__init__' ELSE '' END AS callee,
           CASE WHEN l_returnflag = 'R' THEN 'required' WHEN l_returnflag = 'A' THEN 'optional' WHEN l_linestatus = 'F' THEN 'runtime_only' ELSE 'excluded' END AS bucket,
           'src/f' || (l_suppkey % 10) || '.py' AS file, l_linenumber AS line, 'call  p' || l_partkey || '(x)' AS evidence, l_orderkey * 10 + l_linenumber AS pos
    FROM lineitem),
pred AS (
    SELECT l_orderkey % 50 AS case_id, 's' || l_suppkey AS caller,
           'p' || CASE WHEN m = 6 THEN l_partkey + 1 ELSE l_partkey END || CASE WHEN l_partkey % 11 = 0 AND l_partkey % 22 <> 0 THEN '.__init__' ELSE '' END AS callee,
           'src/f' || (l_suppkey % 10) || '.py' AS file, l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS line, 'call p' || l_partkey || '(x)' AS evidence,
           l_orderkey * 10 + l_linenumber + again AS pos
    FROM (SELECT *, (l_linenumber + l_partkey) % 7 AS m FROM lineitem), (VALUES (0), (1000000000000)) t(again)
    WHERE m <> 5 AND (again = 0 OR l_partkey % 13 = 0))
"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("l_partkey") % 11 == 0, ".__init__").otherwise("")
    bucket = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "A", "optional").when(F.col("l_linestatus") == "F", "runtime_only").otherwise("excluded")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % CASES).alias("case_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("caller"),
        F.concat(F.lit("p"), "l_partkey", suffix).alias("callee"),
        bucket.alias("bucket"),
        F.concat(F.lit("src/f"), F.col("l_suppkey") % 10, F.lit(".py")).alias("file"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("call  p"), "l_partkey", F.lit("(x)")).alias("evidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (F.col("l_linenumber") + F.col("l_partkey")) % 7
    rows = table(spark, sf_dir, "lineitem").where(m != 5).withColumn("again", F.explode(F.when(F.col("l_partkey") % 13 == 0, F.array(F.lit(0), F.lit(10**12))).otherwise(F.array(F.lit(0).cast("long")))))
    suffix = F.when((F.col("l_partkey") % 11 == 0) & (F.col("l_partkey") % 22 != 0), ".__init__").otherwise("")
    return rows.select(
        (F.col("l_orderkey") % CASES).alias("case_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("caller"),
        F.concat(F.lit("p"), F.when(m == 6, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")), suffix).alias("callee"),
        F.concat(F.lit("src/f"), F.col("l_suppkey") % 10, F.lit(".py")).alias("file"),
        (F.col("l_linenumber") + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)).alias("line"),
        F.concat(F.lit("call p"), "l_partkey", F.lit("(x)")).alias("evidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("again")).alias("pos"),
    )


def cases(spark: SparkSession) -> DataFrame:
    return spark.range(CASES).withColumnRenamed("id", "case_id").withColumns({"task_type": F.when(F.col("case_id") % 2 == 0, "find_callees").otherwise("find_callers"), "difficulty": F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("case_id") % 3 + 1).cast("int"))})


def doc_terms(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return index.postings(table(spark, sf_dir, "documents"), ["doc_id", *keys])


def asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, term: the distinct terms of each benchmark text."""
    return index.term_counts(table(spark, sf_dir, "benchmark"), ["item_id"]).select("item_id", "term")


def bm25_results(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """item_id, doc_id, score, rank of the best documents for each benchmark text."""
    scored = rank.lexical_best(asked_terms(spark, sf_dir), ["item_id"], table(spark, sf_dir, "documents"), "doc_id", k)
    return rank.top_k(scored, ["item_id"], k, ["doc_id"])


def relevance(spark: SparkSession, sf_dir: str, most: int = 4096) -> DataFrame:
    """item_id, doc_id where the document holds the benchmark text: all queries, in blocks, against all rows."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("wanted")).where("wanted IS NOT NULL")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    return reduce(DataFrame.union, [docs.mapInArrow(lexical.holding_pass(b.toArrow(), "item_id", "doc_id"), schema) for b in rank.blocks(items, "item_id", most)])
