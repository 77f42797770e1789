"""Helpers that clean numbers, lines and annotations, at their edges."""

from pyspark.sql import functions as F

from quillgraph.functions.text import as_int, truthy
from quillgraph.operators import edges, evaluate, pack


def test_numbers(spark):
    rows = spark.createDataFrame([("-5",), ("1234567890",), ("12345678901",), ("L12-14",), ("0",), (None,), ("\t7 ",)], "x string")
    assert [r[0] for r in rows.select(edges.clean_line("x")).collect()] == [None, 1234567890, None, 12, None, None, 7]
    assert [r[0] for r in rows.select(edges.clean_line(F.col("x"))).collect()] == [None, 1234567890, None, 12, None, None, 7]
    assert [r[0] for r in rows.select(as_int("x", 3)).collect()] == [-5, 1234567890, 3, 3, 0, 3, 7]
    assert spark.range(1).select(truthy(F.lit("\tYes\n"))).first()[0]


def test_definition_lines(spark):
    rows = spark.createDataFrame([("\tdef run(self):",), ("  class A:",), ("\tasync def f():",), ("\trun(x)",), ("define(x)",)], "x string")
    assert [r[0] for r in rows.select(pack.is_definition_line(F.col("x"))).collect()] == [True, True, True, False, False]


def test_receiver_hints(spark):
    lines = spark.createDataFrame([("c", 1, "def f(self, Req: http.Request, n: int, u: Unknown):"), ("c", 2, "a: Local = 1; b: pkg.mod.T"), ("c", 3, "a: pkg.Other")], "k string, line int, text string")
    aliases = spark.createDataFrame([("c", "http", "app.http"), ("c", "Local", "m.Local")], "k string, alias string, target string")
    plain = {(r.name, r.type) for r in pack.receiver_hints(lines, ["k"], aliases).collect()}
    assert plain == {("Req", "app.http.Request"), ("a", "m.Local"), ("b", "pkg.mod.T")}
    parents = spark.createDataFrame([("c", "m.Owner"), ("d", "")], "k string, parent string")
    held = {(r.k, r.name): r.type for r in pack.receiver_hints(lines, ["k"], aliases, parents).collect()}
    assert held[("c", "self")] == held[("c", "cls")] == "m.Owner" and len(held) == 5


def test_recall_after_a_shuffle(spark):
    wanted = spark.createDataFrame([("c", "f", 5), ("c", "f", 50), ("c", "g", 1), ("c", "f", None)], "case_id string, file string, line int").repartition(4)
    results = spark.createDataFrame([("c", 1, "f", 1, 10), ("c", 6, "f", 40, 60)], "case_id string, rank int, file string, start_line int, end_line int")
    got = {r.k: (r.edges, r.recall, r.line_recall) for r in evaluate.recall_at_k(wanted, results).collect()}
    assert got == {5: (4, 0.75, 0.25), 10: (4, 0.75, 0.5)}
