"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the words; a source is clamped at ``max_epochs`` times its own
size and what it can't take is shared among the others in proportion to their weights, until nothing is
over its clamp. Sizes are summed per source before anything is shuffled; the water level is then found on
one row a source.

Sampling is seeded: a document's place in its source is the MD5 digest of seed and id. A target of e times
the source's size gives every document floor(e) repetitions, and one more to those documents that come
first in that order until the rest of the target is filled; the document on the brink is taken if that
comes nearer to the target. The brink is found without sorting a source: sizes are summed over the first
three digits of the digest, and only the one slice that holds the brink is put in order.

Defined cases: null text has size 0; a null source is a source of its own and comes last; a source of size
0 has target 0; repeated rows count as documents each; a null doc_id is ordered like an empty id; rows with one
id are ordered by size, then by a hash of what else they hold; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import shared
from quillgraph.llm.shared import Scratch

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
SLICE_DIGITS = 3


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target for the rows (source, source_size); one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    # sources fill up in the order of cap / weight; clamped ones are a prefix of it
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto, rest, every = fill.rowsBetween(Window.unboundedPreceding, 0), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        (F.sum("cap").over(upto) - F.col("cap")).alias("before"),
        F.sum("weight").over(rest).alias("left"),
    )
    clamped = summed.withColumn("full", F.col("cap") * F.col("left") <= (F.col("total") - F.col("before")) * F.col("weight"))
    level = clamped.withColumn("spent", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)).withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every))
    share = (F.col("total") - F.col("spent")).cast("double") * F.col("weight") / F.col("open")
    return level.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def repetition_plan(sized: DataFrame, seed: str, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """What each slice of each source gets: whole repetitions, and whether all, none or some (2) get one more."""
    slices = sized.groupBy("source", _slice(seed).alias("slice")).agg(F.sum("size").alias("words"))
    targets = water_fill(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.floor(F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)))
    wanted = targets.withColumn("whole", whole.cast("long")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    w = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    upto = slices.withColumn("before", F.sum("words").over(w) - F.col("words"))
    plan = upto.join(wanted, upto["source"].eqNullSafe(wanted["source"]))
    kind = F.when((F.col("extra") <= 0) | (F.col("before") >= F.col("extra")), 0).when(F.col("before") + F.col("words") <= F.col("extra"), 1).otherwise(2)
    return plan.select(upto["source"].alias("__source"), F.col("slice").alias("__slice"), "before", "source_size", "target", "whole", "extra", kind.alias("kind"))


def copies(rows: DataFrame, sized: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``rows`` (doc_id, source, size, others) with source_size, target and copies; ``sized`` holds the same rows' first three."""
    added = ["source_size", "target", "copies"]
    plan = repetition_plan(sized, seed, weights, max_epochs)
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["__source"]) & (_slice(seed) == plan["__slice"]))
    sure = dealt.where("kind <> 2").withColumn("copies", F.col("whole") + F.col("kind"))
    others = [F.xxhash64(rows[c]) for c in rows.columns if c not in ("doc_id", "source", "size")]
    brink = Window.partitionBy("source").orderBy(_place(seed), "doc_id", "size", *others).rowsBetween(Window.unboundedPreceding, 0)
    edge = dealt.where("kind = 2").withColumn("reached", F.col("before") + F.sum("size").over(brink))
    # taken if the target is not reached before it, and taking it comes at least as near as leaving it
    near = F.col("reached") - F.col("extra") <= F.col("extra") - (F.col("reached") - F.col("size"))
    edge = edge.withColumn("copies", F.col("whole") + near.cast("long"))
    return sure.select(*rows.columns, *added).union(edge.select(*rows.columns, *added))


def _place(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _slice(seed: str) -> Column:
    return F.substring(_place(seed), 1, SLICE_DIGITS)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, written once: the texts are read for it a single time."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    return Scratch(docs.sparkSession, "mix").keep(sized)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    sized = sizes(docs)
    return copies(sized, sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the number of the repetition in ``epoch``.

    Where ``docs`` has a column of that name, the added one gets an underscore at its end.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), own)
    taken = copies(rows, sizes(docs)).where("copies > 0")
    epoch = shared.fresh_name(docs.columns, "epoch")
    return taken.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch"), "row").select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("epoch").alias(epoch))
