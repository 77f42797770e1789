import math

from pyspark.sql import functions as F

from quillgraph.operators import evaluate, index, pack, rank


def test_chunk_windows(spark):
    want = {0: 0, 1: 1, 80: 1, 81: 2, 140: 2, 141: 3}
    frame = spark.createDataFrame([(n, "\n".join(f"l{k}" for k in range(n))) for n in want], "n int, text string")
    got = {r.n: r["count"] for r in index.line_chunks(frame, ["n"]).groupBy("n").count().collect()}
    assert {n: got.get(n, 0) for n in want} == want
    last = index.line_chunks(frame.where("n = 141"), ["n"]).orderBy("start_line").collect()[-1]
    assert (last.start_line, last.end_line, last.line_count) == (121, 141, 21)


def test_bm25_uses_distinct_terms_of_one_repository(spark):
    docs = spark.createDataFrame([(1, "a", "apple apple pear"), (2, "a", "pear plum fig"), (3, "b", "apple"), (4, "a", "")], "id int, repo string, text string")
    terms = index.postings(docs, ["id", "repo"])
    asked = spark.createDataFrame([("q", "apple", "a")], "q string, term string, repo string")
    got = rank.bm25_scores(asked, "q", terms, "id", repo="repo", units=docs).collect()
    average = 5 / 3
    want = math.log(1 + (3 - 1 + 0.5) / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / average))
    assert [r.id for r in got] == [1] and abs(got[0].bm25 - want) < 1e-12


def test_keyword_points(spark):
    frame = spark.createDataFrame([("Run Box.open( box", ["box"], ["box", "ru"], ["Box.open", "y.open", "pkg.Other"], ["Box.open"], ["open(", "BOX"])], "text string, own array<string>, terms array<string>, symbols array<string>, own_symbols array<string>, patterns array<string>")
    score = rank.keyword_score(F.col("text"), F.col("terms"), F.col("own"), F.col("symbols"), F.col("own_symbols"), F.col("patterns"))
    # box 1 + .25, ru .25; Box.open 6, y.open by its tail 1.5; open( once 5; BOX twice in lower case 4
    assert frame.select(score).first()[0] == 1.25 + 0.25 + 6 + 1.5 + 5 + 4


def test_top_k_rounds_before_it_orders(spark):
    frame = spark.createDataFrame([("q", 2, 1.0000001), ("q", 1, 1.0), ("q", 3, 0.0), ("q", 4, 2.0)], "q string, id int, score double")
    assert [(r.id, r["rank"]) for r in rank.top_k(frame, ["q"], 3, ["id"]).orderBy("rank").collect()] == [(4, 1), (1, 2), (2, 3)]


def test_merge_keeps_the_first_on_ties(spark):
    rows = [("c", "u", 0, "a", 2.0), ("c", "u", 1, "b", 2.0), ("c", "u", 2, "b", 1.0), ("c", "v", 1, "b", 3.0)]
    got = {r.unit: r for r in rank.merge_queries(spark.createDataFrame(rows, "case string, unit string, ord int, label string, score double"), "case", "unit").collect()}
    assert (got["u"].best_ord, got["u"].query_count, got["u"].best_query) == (0, 2, "a")
    assert [(m.label, m.score) for m in got["u"].matched_queries] == [("a", 2.0), ("b", 2.0)]


def test_diversification_floor(spark):
    rows = [("q", "A1", "A", 10.0, 1), ("q", "A2", "A", 10.0, 2), ("q", "B", "B", 9.0, 3), ("q", "C", "C", 3.9, 4)]
    frame = spark.createDataFrame(rows, "q string, unit string, file string, score double, rank int")
    assert [r.unit for r in rank.diversify(frame, ["q"], "file", 3).orderBy("new_rank").collect()] == ["A1", "B", "A2"]


def test_safety_slot(spark):
    ranked = spark.createDataFrame([("c", f"u{k}", k) for k in range(1, 6)], "case_id string, unit string, rank long")

    def slot(unit):
        cand = spark.createDataFrame([("c", unit)] if unit else [], "case_id string, unit string")
        got = rank.safety_slot(ranked, cand, "case_id", "unit", 5).orderBy("new_rank").collect()
        return [r.unit for r in got], got[0].slot_reason

    assert slot("u1") == (["u1", "u2", "u3", "u4", "u5"], "already_within_slot")
    assert slot("u5") == (["u1", "u5", "u2", "u3", "u4"], "promoted_existing")
    assert slot("new") == (["u1", "new", "u2", "u3", "u4"], "inserted_missing")
    assert slot(None)[1] == "no_exact_definition_candidate"
    none = rank.safety_slot(ranked.limit(0), spark.createDataFrame([("c", "x")], "case_id string, unit string"), "case_id", "unit", 5).collect()
    assert [(r.unit, r.new_rank) for r in none] == [("x", 1)]


def test_recall_and_reciprocal_rank(spark):
    results = spark.createDataFrame([("a", 1, "f", 1, 10), ("a", 7, "g", 1, 10)], "case_id string, rank int, file string, start_line int, end_line int")
    wanted = spark.createDataFrame([("a", "f", 5), ("a", "f", 50), ("a", "g", 3), ("b", "h", 1)], "case_id string, file string, line int")
    got = {(r.case_id, r.k): (r.recall, r.file_recall, r.line_recall) for r in evaluate.recall_at_k(wanted, results).collect()}
    assert got["a", 5] == (0.666667, 0.5, 0.333333) and got["a", 10] == (1.0, 1.0, 0.666667) and got["b", 10] == (0.0, 0.0, 0.0)
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    assert {r.case_id: r.mrr for r in evaluate.reciprocal_rank(cases, wanted, results).collect()} == {"a": 1.0, "b": 0.0, "c": None}
    assert {(r.case_id, r.k): r.accuracy for r in evaluate.definition_accuracy(wanted, results).collect()} == {("a", 5): 0.0, ("a", 10): 1.0, ("b", 5): 0.0, ("b", 10): 0.0}


def test_greedy_pack(spark):
    frame = spark.createDataFrame([("x", k + 1, str(k + 1), t) for k, t in enumerate((60, 50, 30, 20, 5))] + [("y", 1, "big", 500), ("y", 2, "no", 1)], "case_id string, rank int, unit string, tokens int")
    got = [(r.case_id, r.unit) for r in pack.greedy_pack(frame, ["case_id"], 100).orderBy("case_id", "slot").collect()]
    assert got == [("x", "1"), ("x", "3"), ("x", "5"), ("y", "big")]


def test_callee_resolution_order(spark):
    maps = F.create_map(F.lit("h"), F.lit("pkg.h")), F.create_map(F.lit("q"), F.lit("pkg.m.q")), F.create_map(F.lit("o"), F.lit("pkg.m.O"))
    want = {"cls": "pkg.m.Box", "h.x": "pkg.h.x", "o.go": "pkg.m.O.go", "o.a.b": "o.a.b", "q": "pkg.m.q", "self.run": "pkg.m.Box.run", "self.a.run": "self.a.run", "zzz": None, "s.signals.connect": "sig.Manager.connect"}
    frame = spark.createDataFrame([(e,) for e in want], "e string")
    got = {r.e: r.h for r in frame.select("e", pack.callee_hint(F.col("e"), F.lit("pkg.m.Box.open"), *maps, manager="sig.Manager").alias("h")).collect()}
    assert got == want
    status = {r.e: r.s for r in frame.select("e", pack.candidate_status(F.col("e"), F.lit(None).cast("string"), F.lit("pkg"), F.lit("pkg.m.f"), F.lit("exclude")).alias("s")).collect()}
    assert status["q"] == "secondary"
