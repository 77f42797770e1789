"""Joins of points and lines with spans, and merging of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 80


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """Pairs of a point and each span that covers it. Spans are dealt to line buckets, so the join has equal keys."""
    dealt = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    placed = points.withColumn("bucket", F.floor(F.col(point) / bucket))
    return placed.join(dealt, [*keys, "bucket"]).where(F.col(point).between(F.col(start), F.col(end))).drop("bucket")


def innermost(pairs: DataFrame, by: list[str], start: str, end: str, name: str) -> DataFrame:
    """The shortest span of each point; the longer name, then the name itself, on ties."""
    w = Window.partitionBy(*by).orderBy(F.col(end) - F.col(start), F.desc(F.length(name)), name)
    return pairs.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def merged(intervals: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """keys, start, end, parts: intervals joined where the next starts at most ``gap`` after all before it ended."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = intervals.withColumn("opens", F.when(F.col(start) <= reached + gap, 0).otherwise(1))
    island = flagged.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("island")


def symbol_windows(lines: DataFrame, symbols: DataFrame, keys: list[str], radius: int = 20) -> DataFrame:
    """keys, start, end of the lines around each symbol's definition, merged. ``lines``: keys, line_no, text.

    The definition of the last name part is looked for first (``def`` or ``class``; a constructor under its class
    name), else the first line that has the name at all.
    """
    named = symbols.withColumn("tail", F.substring_index(F.regexp_replace("symbol", r"\.__init__$", ""), ".", -1))
    held = lines.join(named, keys).where(F.contains("text", F.col("tail")))
    defined = F.regexp_like("text", F.concat(F.lit(r"^\s*(?:async\s+def|def|class)\s+\Q"), F.col("tail"), F.lit(r"\E\b")))
    first = held.groupBy(*keys, "symbol").agg(F.min(F.struct(F.when(defined, 0).otherwise(1).alias("p"), "line_no")).alias("at"))
    last = lines.groupBy(*keys).agg(F.max("line_no").alias("last"))
    around = first.join(last, keys).select(*keys, F.greatest(F.lit(1), F.col("at.line_no") - radius).alias("start"), F.least("last", F.col("at.line_no") + radius).alias("end"))
    return merged(around, keys, "start", "end")
