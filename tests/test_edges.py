from pyspark.sql import functions as F

from quillgraph.operators import edges, score

EDGE = "case_id string, pos int, caller string, callee string, file string, line string, evidence string, confidence_type string, notes string"


def pred(spark, *rows):
    return spark.createDataFrame([("c", k, *r) for k, r in enumerate(rows)], "case_id string, pos int, caller string, callee string, file string, line int, evidence string")


def gold(spark, *rows):
    return spark.createDataFrame([("c", k, *r) for k, r in enumerate(rows)], "case_id string, pos int, bucket string, caller string, callee string, file string, line int, evidence string")


def scored(spark, predicted, golden, constructors=False, tolerance=0):
    cases = spark.createDataFrame([("c",)], "case_id string")
    matched = score.match_edges(predicted, golden, constructors=constructors, tolerance=tolerance)
    return score.case_scores(cases, golden, matched).first(), matched


def test_excluded_overrules_required(spark):
    g = gold(spark, ("required", "a", "b", "f", 1, "b()"), ("excluded", "a", "b", None, None, None), ("required", "a", "d", "f", 2, "d()"))
    got, matched = scored(spark, pred(spark, ("a", "b", "f", 1, "b()")), g)
    assert (got.matched_excluded, got.matched_required, got.required_edges, got.edge_precision, got.edge_recall) == (1, 0, 2, 0.0, 0.0)
    assert score.missing_edges(g, matched).first().missing_required == ["a -> b", "a -> d"]


def test_first_of_duplicates_and_blank_edges(spark):
    g = gold(spark, ("required", "a", "b", "f", 1, "b()"), ("optional", "a", "o", "f", 1, "o()"), ("runtime_only", "a", "r", "f", 1, "r()"))
    got, _ = scored(spark, pred(spark, ("a", "b", "f", 9, "b()"), ("a", "b", "f", 1, "b()"), ("a", "", "f", 1, ""), ("a", "o", "f", 1, "o()"), ("a", "r", "f", 1, "r()"), ("a", "z", "f", 1, "z()")), g)
    assert (got.predicted_edges, got.duplicate_predictions, got.malformed_predictions, got.accepted_predictions, got.unmatched_predictions) == (4, 1, 1, 3, 1)
    assert got.edge_precision == 0.75 and got.edge_recall == 1.0 and got.evidence_accuracy == 0.0 and got.evidence_accuracy_all == 0.666667


def test_no_predictions_or_no_required(spark):
    got, _ = scored(spark, pred(spark).limit(0) if False else spark.createDataFrame([], "case_id string, pos int, caller string, callee string, file string, line int, evidence string"), gold(spark, ("required", "a", "b", "f", 1, "b")))
    assert got.edge_precision is None and got.edge_recall == 0.0 and got.evidence_accuracy is None
    got, _ = scored(spark, pred(spark, ("a", "b", "f", 1, "x")), gold(spark, ("optional", "a", "b", "f", 1, "x")))
    assert got.edge_recall is None and got.edge_precision == 1.0


def test_constructor_spellings(spark):
    g = gold(spark, ("required", "a", "X.__init__", "f", 1, "X()"))
    strict, _ = scored(spark, pred(spark, ("a", "X", "f", 1, "X()"), ("a", "X.__init__", "f", 1, "X()")), g)
    loose, _ = scored(spark, pred(spark, ("a", "X", "f", 1, "X()"), ("a", "X.__init__", "f", 1, "X()")), g, constructors=True)
    assert (strict.matched_required, strict.unmatched_predictions) == (1, 1)
    assert (loose.matched_required, loose.duplicate_predictions, loose.edge_precision) == (1, 1, 1.0)
    twice = gold(spark, ("required", "a", "X.__init__", "f", 1, "X()"), ("optional", "a", "X.__init__", "f", 1, "X()"))
    assert scored(spark, pred(spark, ("a", "X", "f", 1, "X()")), twice, constructors=True)[0].unmatched_predictions == 1
    exact = gold(spark, ("required", "a", "X.__init__", "f", 1, "X()"), ("excluded", "a", "X", None, None, None))
    assert scored(spark, pred(spark, ("a", "X", "f", 1, "X()")), exact, constructors=True)[0].matched_excluded == 1


def test_evidence_tolerance(spark):
    g = gold(spark, ("required", "a", "b", "src/f.py", 5, "x  =  b( 1 )"))
    for off, tolerance, want in ((0, 0, 1.0), (1, 0, 0.0), (1, 1, 1.0), (2, 1, 0.0), (2, 2, 1.0)):
        got, _ = scored(spark, pred(spark, ("a", "b", "src\\f.py", 5 + off, "b( 1 )")), g, tolerance=tolerance)
        assert got.evidence_accuracy == want, (off, tolerance)
    assert scored(spark, pred(spark, ("a", "b", "src/f.py", 5, " ")), g)[0].evidence_accuracy == 0.0
    assert scored(spark, pred(spark, ("a", "b", "src/f.py", None, "b( 1 )")), g)[0].evidence_accuracy == 0.0


def test_total_uses_rounded_ratios(spark):
    frame = spark.createDataFrame([(3, 4, 2, 0, 0, 0, 2, 2, 0, 0, 0.333333), (1, 1, 1, 0, 0, 0, 1, 0, 0, 0, None)], "required_edges int, predicted_edges int, matched_required int, matched_optional int, matched_runtime_only int, matched_excluded int, accepted_predictions int, unmatched_predictions int, malformed_predictions int, duplicate_predictions int, evidence_accuracy double")
    got = score.total_scores(frame).first()
    assert (got.edge_precision, got.edge_recall, got.evidence_accuracy) == (0.6, 0.75, 0.333333)


def test_cleaning(spark):
    rows = [("c", 0, " `a.b` ", "x = new C()", ".\\./src\\f.py", "L12-14", " 'C()' ", "odd", None), ("c", 1, "a", "P.C.__init__", "f.py", "-3", "self.c = C (1)", None, ""), ("c", 2, "a", "P.C.__init__", "f.py", "0", "C(1); super().__init__()", None, None), ("c", 3, "", "f(...)", None, None, None, None, None)]
    got = edges.clean_edges(spark.createDataFrame(rows, EDGE)).orderBy("pos").collect()
    assert (got[0].caller, got[0].callee, got[0].line, got[0].evidence) == ("a.b", "newC", 12, "C()")
    assert got[1].callee == "P.C" and got[1].notes is None and got[2].callee == "P.C.__init__" and got[2].line is None
    assert got[3].caller is None and got[3].callee == "f"


def test_postprocess(spark):
    rows = [("c", 0, "a", "b", "f.py", "1", "e", "dynamic_possible", None), ("c", 1, "a", "b", "f.py", "1", "e", "dynamic_possible", None), ("c", 2, "a", "b", "f.py", "2", "e", "static_confirmed", None), ("c", 3, "a", "t", "tests/f.py", "1", "e", None, None), ("c", 4, "a", "", "f.py", "1", "e", None, None), ("c", 5, "a", "v", "venv/f.py", "1", "e", None, None), ("c", 6, "a", "u", "../f.py", "1", "e", None, None)]
    out, stats = edges.postprocess(edges.clean_edges(spark.createDataFrame(rows, EDGE)), edges.filter_reason(F.lit(False), F.lit("exclude"), F.lit("repo_only")))
    assert [(r.callee, r.line, r.confidence_type) for r in out.collect()] == [("b", 2, "static_confirmed")]
    assert stats.first().asDict() == {"case_id": "c", "input_edges": 7, "malformed_edges_removed": 1, "filtered_edges_removed": 3, "exact_duplicates_removed": 1, "symbol_duplicates_removed": 1, "output_edges": 1}


def test_candidate_merge(spark):
    rows = [("c", 1, "a", "b", "secondary", "e1", "f", 1, "x", ["k"]), ("c", 2, "a", "b", "primary", "e2", "f", 2, "y", ["k", "l"]), ("c", 3, "a", "d", "primary", "e3", "f", 3, "z", []), ("c", 4, "a", "q", "filtered_external", "e4", "f", 4, "w", [])]
    frame = spark.createDataFrame(rows, "case_id string, pos int, caller string, callee string, status string, expression string, file string, line int, evidence string, callback_arguments array<string>")
    got = {r.callee: r for r in edges.merge_candidates(frame).collect()}
    assert set(got) == {"b", "d"} and got["b"].candidate_id == "edge-001" and got["b"].status == "primary"
    assert got["b"].evidence_count == 2 and [x.expression for x in got["b"].additional_evidence] == ["e1"] and got["b"].callback_arguments == ["k", "l"]


def test_longest_prefix_alias(spark):
    names = spark.createDataFrame([("m.k.f",), ("m.q",), ("mm.q",), ("m.k",)], "symbol string")
    alias = spark.createDataFrame([("m", "mod"), ("m.k", "deep")], "alias string, target string")
    assert {r.symbol: r.canonical for r in score.canonical_symbols(names, alias).collect()} == {"m.k.f": "deep.f", "m.q": "mod.q", "mm.q": "mm.q", "m.k": "deep"}


def test_reach(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "caller string, callee string")
    got = {r.node: r.depth for r in edges.reach(links, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_merged_candidates_of_one_key_are_compared_by_groups(spark, monkeypatch):
    import random

    r = random.Random(1)
    rows = [(k % 2, "a", f"c{r.randint(0, 1)}", r.choice(["primary", "", "secondary", "other", "filtered_x"]), f"e{r.randint(0, 30)}", "f", r.randint(1, 3), None if k % 9 == 0 else "v", [f"g{r.randint(0, 9)}"] * (k % 3), k * 7919 % 1009) for k in range(400)]
    frame = spark.createDataFrame(rows, "case_id int, caller string, callee string, status string, expression string, file string, line int, evidence string, callback_arguments array<string>, pos int")
    got = {(g.case_id, g.callee): g for g in edges.merge_candidates(frame).collect()}
    place = {"primary": 0, "secondary": 1}
    groups = {}
    for c, _, callee, status, *rest in sorted(rows, key=lambda x: x[-1]):
        if not status.startswith("filtered"):
            groups.setdefault((c, callee), []).append((status or "secondary", *rest))
    assert set(got) == set(groups)
    for key, held in groups.items():
        best = min(held, key=lambda x: (place.get(x[0], 2), x[-1]))[:5]
        others = [x for x in dict.fromkeys(h[:5] for h in held) if x != best]
        g = got[key]
        assert (g.status, g.expression, g.file, g.line, g.evidence) == best and g.evidence_count == len(held)
        assert [tuple(x) for x in g.additional_evidence] == others[:5]
        assert g.callback_arguments == list(dict.fromkeys(x for h in held for x in h[5]))
    plan = edges.merge_candidates(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(filter(" not in plan  # distinct structs of a group are found by comparing all pairs
