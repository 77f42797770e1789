"""Benchmark decontamination with built-in functions only.

Benchmark texts become windows of WINDOW consecutive words (a shorter text is one window). Their number is
counted first; up to MAX_SET windows they go to the executors as hash sets inside the expressions (a filter's
IN list, which Spark turns into a hash set): one of the hashes of each window's first ANCHOR words, and one of
the whole windows. A document's positions are tested against the small set of anchors, and only positions that
pass are verified word by word against the windows. Larger benchmarks take a shuffled join on window hashes
instead, verified the same way.

Everything about a document stays in its row, so a filter on contamination moves no text. Only the names of
the hit items come from a join, on the windows found.

Defined cases: null, empty or wordless text has no words, hits and items; repeated rows are judged one by one;
a benchmark without words marks nothing; a null item_id is left out of the list of items; extra columns are
kept by ``drop_contaminated`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import Scratch

WINDOW = 10
ANCHOR = 3
#: Windows that may be shipped as hash sets: about 100 bytes each.
MAX_SET = 200_000
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: runs of digits, letters a-z and all beyond ASCII."""
    full = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(full) == F.char_length(full), F.lower(full)).otherwise(F.translate(full, UPPER, LOWERED))
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words in the window), gram, distinct."""
    words = benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("words"))
    grams = F.expr(
        f"""CASE WHEN size(words) >= {WINDOW} THEN transform(sequence(0, size(words) - {WINDOW}), i -> array_join(slice(words, i + 1, {WINDOW}), ' '))
                 WHEN size(words) > 0 THEN array(array_join(words, ' ')) ELSE array() END"""
    )
    return words.select("item_id", F.least(F.size("words"), F.lit(WINDOW)).alias("n"), F.explode(grams).alias("gram")).distinct()


def _gram(n: int) -> str:
    return f"array_join(slice(words, i + 1, {n}), ' ')"


def _lead(k: int) -> str:
    return f"xxhash64({', '.join(f'get(words, i + {j})' for j in range(k))})"


def _hits_in_sets(windows: DataFrame) -> tuple[str, str]:
    """SQL over a row's column words: its anchors, and from these its hits, an array of (p, n)."""
    lead = F.expr(f"CASE WHEN n >= {ANCHOR} THEN xxhash64({', '.join(f'''get(split(gram, ' '), {j})''' for j in range(ANCHOR))}) END")
    rows = windows.select("n", "gram", lead.alias("lead")).distinct().collect()  # at most MAX_SET rows
    by_size: dict[int, list[str]] = {}
    for r in rows:
        by_size.setdefault(r.n, []).append(r.gram)
    leads = sorted({r.lead for r in rows if r.lead is not None})
    found = []
    for n, grams in sorted(by_size.items()):
        listed = ", ".join(f"'{g}'" for g in sorted(grams))  # words hold no quote or backslash
        here = "anchors" if n >= ANCHOR else f"IF(size(words) >= {n}, sequence(0, size(words) - {n}), array())"
        found.append(f"transform(filter({here}, i -> i + {n} <= size(words) AND {_gram(n)} IN ({listed})), i -> struct(i AS p, {n} AS n))")
    anchors = f"IF(size(words) >= {ANCHOR}, filter(sequence(0, size(words) - {ANCHOR}), i -> {_lead(ANCHOR)} IN ({', '.join(f'{x}L' for x in leads)})), array())" if leads else "CAST(array() AS array<int>)"
    return anchors, (f"concat({', '.join(found)})" if found else "CAST(array() AS array<struct<p: int, n: int>>)")


def find(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` as a struct column ``own``, with ``row``, ``words`` and ``hits``, an array of (p, n): n words from word p on.

    Filters on hits must also read ``row``: as it is not deterministic, they then stay above the projection that
    makes the words, which would otherwise be made anew for every position.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    held = docs.select(own, words_of(F.col("text").cast("string")).alias("words"), F.monotonically_increasing_id().alias("row"))
    windows = benchmark_windows(benchmark)
    if windows.count() <= max_set:
        anchors, found = _hits_in_sets(windows)
        return held.withColumn("anchors", F.expr(anchors)).select("own", "row", "words", F.expr(found).alias("hits"))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    kept = scratch.keep(held)
    sizes = [r.n for r in windows.select("n").distinct().collect()]  # at most WINDOW values
    at = None
    for n in sizes:
        own = kept.where(F.size("words") >= n).select("row", "words", F.explode(F.expr(f"sequence(0, size(words) - {n})")).alias("i"))
        made = own.select("row", F.col("i").alias("p"), F.lit(n).alias("n"), F.expr(_gram(n)).alias("gram"))
        at = made if at is None else at.union(made)
    hit = at.join(windows.select("n", "gram").distinct(), ["n", "gram"], "left_semi")
    rows = hit.groupBy("row").agg(F.collect_list(F.struct("p", "n")).alias("hits"))
    return kept.join(rows, "row", "left").select("own", "row", "words", F.coalesce("hits", F.expr("CAST(array() AS array<struct<p: int, n: int>>)")).alias("hits"))


def _covered() -> Column:
    return F.expr("array_distinct(flatten(transform(hits, h -> sequence(h.p, h.p + h.n - 1))))")


def report(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "contamination")
    grams = F.expr("array_distinct(transform(hits, h -> array_join(slice(words, h.p + 1, h.n), ' ')))")
    rows = find(docs.select("doc_id", "text"), benchmark, max_set).select(
        "row", F.col("own.doc_id").alias("doc_id"), F.size("words").cast("long").alias("n_words"), F.size(_covered()).cast("long").alias("n_hit"), grams.alias("grams")
    )
    rows = scratch.keep(rows)
    named = benchmark_windows(benchmark).where("item_id is not null").select("gram", F.col("item_id").cast("string").alias("item"))
    hit = rows.where("n_hit > 0")
    items = hit.select("row", F.explode("grams").alias("gram")).join(named, "gram").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.expr("CAST(array() AS array<string>)")
    whole = hit.join(items, "row", "left").withColumn("items", F.coalesce("items", none)).drop("grams")
    every = rows.where("n_hit = 0").drop("grams").withColumn("items", none).unionByName(whole)
    return every.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window."""
    found = find(docs, benchmark, max_set).where((F.size("hits") == 0) & (F.col("row") >= 0))
    return found.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def cut_spans(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``; what stands between words stays."""
    found = find(docs, benchmark, max_set).withColumn("cut", _covered())
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    between = F.split(F.col("own.text").cast("string"), word)
    original = F.regexp_extract_all(F.col("own.text").cast("string"), F.lit(word), 0)
    parts = found.withColumn("between", between).withColumn("original", original)
    kept = F.expr("array_join(transform(between, (b, i) -> concat(b, CASE WHEN i < size(original) AND NOT array_contains(cut, i) THEN get(original, i) ELSE '' END)), '')")
    text = F.when(F.size("hits") == 0, F.col("own.text")).otherwise(kept)
    return parts.select(*[(text if c == "text" else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])
