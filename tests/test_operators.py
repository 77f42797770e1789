import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import parsers
from quillgraph.operators import budget, generate, index, pack, planning, quality, runs, spans
from quillgraph.sources import files
from quillgraph.streaming import events as windows


def test_generator_counts(spark):
    made = generate.samples(spark, 500)
    assert generate.manifest(made).first().asDict() == {"samples": 500, "train": 400, "dev": 100, "positive": 275, "negative": 138, "boundary": 87, "multi_edge_outputs": 51, "depth_2_call_chains": 17, "repos": 200}
    one = made.where("i = 25").first()
    assert json.loads(one.messages[-1].content)["case_id"] == "ft-synth-0025" and len(one.edges.required) == 4
    again = generate.retagged(made).where("i = 25").first()
    assert again.id == "ft-full-synth-025" and json.loads(again.messages[-1].content)["case_id"] == "ft-full-synth-025"
    checks = made.select("id", "negative.*", "dynamic_boundary.*", F.size("edges.required").alias("required_count"), F.size("evidence").alias("evidence_count"))
    assert quality.rule_errors(checks, "id", quality.consistency_rules()).count() == 0
    assert quality.split_isolation(made, "repo").count() == 0 and quality.message_errors(made.select("id", F.posexplode("messages").alias("turn", "m")).select("id", "turn", "m.role", F.col("m.content").alias("text")), "id", json=True).count() == 0


def test_sample_errors(spark):
    rows = [("n", True, "none", 1, False, ["none"], 1), ("d", False, "none", 1, True, ["none"], 1), ("t", False, "x", 1, False, ["none"], 0)]
    frame = spark.createDataFrame(rows, "id string, is_negative boolean, negative_type string, required_count int, has_dynamic_boundary boolean, boundary_types array<string>, evidence_count int")
    got = {(r.id, r.error) for r in quality.rule_errors(frame, "id", quality.consistency_rules()).collect()}
    assert got == {("n", "negative with required edges"), ("n", "negative without type"), ("d", "dynamic flag and types differ"), ("t", "type on a positive"), ("t", "no evidence")}
    samples = spark.createDataFrame([("1", " Org/Repo ", "train", "g1"), ("2", "org/repo", "test", "g1"), ("3", "other", "dev", "g2")], "id string, repo string, split string, g string")
    blocked = spark.createDataFrame([("org/REPO",)], "repo string")
    assert [r.id for r in quality.leakage(samples, blocked, "id").collect()] == ["1"]
    assert [(r.g, r.splits) for r in quality.split_isolation(samples, "g").collect()] == [("g1", "test,train")]


def test_spans(spark):
    lines = spark.createDataFrame([("f", k) for k in (5, 100, 161)], "file string, line int")
    held = spark.createDataFrame([("f", 1, 200, "C"), ("f", 4, 90, "C.f"), ("f", 100, 161, "C.g"), ("f", 100, 161, "C.gg")], "file string, start int, end int, name string")
    pairs = spans.points_in_spans(lines, held, ["file"], "line", "start", "end")
    assert {r.line: r.name for r in spans.innermost(pairs, ["file", "line"], "start", "end", "name").collect()} == {5: "C.f", 100: "C.gg", 161: "C.gg"}
    parts = spark.createDataFrame([("k", 1, 3), ("k", 4, 5), ("k", 2, 9), ("k", 12, 12)], "k string, s int, e int")
    assert sorted((r.s, r.e, r.parts) for r in spans.merged(parts, ["k"], "s", "e").collect()) == [(1, 9, 3), (12, 12, 1)]


def test_symbol_windows(spark):
    text = ["import x"] + [f"l{k}" for k in range(30)] + ["class Box:", "  def open(self):", "    pass"]
    lines = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(text)], "file string, line_no int, text string")
    got = spans.symbol_windows(lines, spark.createDataFrame([("f", "m.Box.open"), ("f", "m.Box.__init__")], "file string, symbol string"), ["file"], radius=2).collect()
    assert [(r.start, r.end) for r in got] == [(30, 34)]


def test_budgets(spark):
    calls = spark.createDataFrame([("c", k) for k in range(21)], "case_id string, seq int")
    assert budget.call_budget(calls, "case_id", ["seq"]).where("allowed").count() == 20
    reads = spark.createDataFrame([("c", k, f"f{k % 13}", 4) for k in range(15)] + [("d", 0, "a", 39), ("d", 1, "a", 10), ("d", 2, "a", 1)], "case_id string, seq int, file string, chars int")
    got = budget.read_budget(reads.where("case_id = 'c'"), "case_id", "seq").orderBy("seq").collect()
    assert [r.state for r in got] == ["ok"] * 12 + ["file_budget"] + ["ok"] * 2
    cut = budget.read_budget(reads.where("case_id = 'd'"), "case_id", "seq", max_tokens=11).orderBy("seq").collect()
    assert [(r.state, r.given) for r in cut] == [("ok", 39), ("truncated", 4), ("token_budget", 0)]


def test_agent_loop_and_batches(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    act = lambda case, seen: {"action": "final", "prediction": case["case_id"]} if case["case_id"] == "a" and len(seen) == 2 else {"action": "search"}
    got = budget.agent_loop(cases, "case_id string, step int, action string, payload string", act, lambda case, action: "none", steps=3).collect()
    assert [(r.step, r.action) for r in got if r.case_id == "a"] == [(1, "search"), (2, "search"), (3, "final")]
    assert [(r.step, r.action) for r in got if r.case_id == "b"][-1] == (4, "final")

    def call(case):
        if case["case_id"] == "b":
            raise ValueError("down")
        return {"edges": []}

    states = {r.case_id: (r.status, r.attempts) for r in budget.run_batch(cases, call).collect()}
    assert states == {"a": ("ok", 1), "b": ("error", 3)}


def test_parsers():
    source = "import os\nfrom . import sib\nfrom ..up import x as y\nclass A:\n  def f(self):\n    g(); self.h(); y.z()\n    def inner(): k()\n    return lambda: q()\nif True:\n  def hidden(): pass\ndef g(): pass\n"
    assert [(d["symbol"], d["kind"]) for d in parsers.definitions(source, "p.m")] == [("p.m.A", "class"), ("p.m.A.f", "function"), ("p.m.A.f.inner", "function"), ("p.m.g", "function")]
    assert parsers.import_aliases(source, "p.s.m") == {"os": "os", "sib": "p.s.sib", "y": "p.up.x"}
    assert [(c["name"], c["resolved"]) for c in parsers.direct_calls(source, "p.s.m.A.f", "method", "p.s.m")] == [("g", "p.s.m.g"), ("self.h", "p.s.m.A.h"), ("y.z", "p.up.x.z")]
    assert parsers.definitions("def (", "m") == [] and parsers.direct_calls(None, "a", "function", "m") == []
    assert parsers.payload("x\n```yaml\na: 1\n```\n```yaml\nb: f(x): y\n```") == {"b": "f(x): y"}
    assert parsers.action_object('{"a": 1} {"action": "x"} text {"b": 2}') == {"action": "x"}
    with pytest.raises(ValueError):
        parsers.normal_predictions({"case_id": "c", "edges": [1]})
    assert parsers.normal_predictions({"c": [{"caller": "a"}], "d": {"edges": None}}, strict=False) == [{"case_id": "c", "edges": [{"caller": "a"}]}, {"case_id": "d", "edges": []}]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.yaml").write_text("id: a\nn: 1\n")
    (tmp_path / "b.yaml").write_text("id: [")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n')
    (tmp_path / "sub/m.py").write_text("x = 1\n")
    (tmp_path / "sub/test_m.py").write_text("x = 1\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.yaml_records(files.case_files(spark, str(tmp_path)), "id string, n int").collect()}
    assert (got["a.yaml"].value.id, got["a.yaml"].value.n) == ("a", 1) and got["b.yaml"].error
    lines = files.numbered_json_lines(spark, str(tmp_path / "x.jsonl")).orderBy("line_no").collect()
    assert [(r.line_no, r.error) for r in lines] == [(1, None), (3, "not a JSON object")]
    loose = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()
    assert sum(r._corrupt_record is not None for r in loose) == 1
    source = {r.file: r.reason for r in files.source_files(spark, {"r": str(tmp_path)}).collect()}
    assert source["sub/m.py"] is None and source["sub/test_m.py"] == "test_path" and source["b.yaml"] == "suffix"
    assert files.json_documents(spark, str(tmp_path / "none.json"), "a int").count() == 0
    files.write_single(spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double"), str(tmp_path / "out"))
    assert files.report(spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double"), ["a", "b", "c"])[-1] == "| 1 | n/a | 0.500 |"


def test_runs(spark):
    body = [json.dumps({"usage": {"prompt_tokens": 3, "reasoning_tokens": 2, "completion_tokens_details": {"reasoning_tokens": 0}, "cost": 0.1}, "provider": None, "choices": [{"finish_reason": "stop"}]}), json.dumps({"usage": None}), "{}"]
    frame = spark.createDataFrame([(b,) for b in body], "response string")
    got = runs.usage(frame).first()
    assert (got.raw_response_count, got.prompt_tokens, got.reasoning_tokens, got.observed_cost_usd) == (3, 3, 2, 0.1)
    assert [(r.value, r.n) for r in runs.providers(frame).collect()] == [("unknown", 3)]
    assert [(r.value, r.n) for r in runs.finish_reasons(frame).collect()] == [("stop", 1)]
    log = spark.createDataFrame([("a", 1, 1.0), ("a", 9, 1.2), ("b", 1, 2.0), ("b", 2, None), ("b", 3, 1.0)], "run string, step int, eval_loss double")
    assert {r.run: r.state for r in runs.overfit_monitor(log, ["run"]).collect()} == {"a": "possible_overfit", "b": "no_overfit"}


def test_planning(spark, tmp_path):
    combos = spark.createDataFrame([("f+s",), ("S/C",), ("S,S",), ("Z",)], "c string")
    assert [r.v for r in combos.select(planning.normal_combination(F.col("c")).alias("v")).collect()] == ["S+F", "S+C", None, None]
    assert planning.assemble_prompt("head {{a}} {{b}}", [("T", "body")], ("{{a}}", "{{b}}")) == "head ## T\n\nbody\n\n{{a}} {{b}}"
    assert planning.expand_env({"a": ["${X:-1}", "${Y}"]}, {"Y": "2"}) == {"a": ["1", "2"]}
    assert planning.env_file("# c\nexport A='x'\nB=2\n") == {"A": "x", "B": "2"}
    assert planning.merge_maps({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_imports_are_rebuilt(spark):
    rows = ["import os", "from a import (", "  b,", "  c)", "x = 1", "import q \\", "  as r", "y = 2"]
    lines = spark.createDataFrame([("f", k + 1, t, s) for s in (1, 5) for k, t in enumerate(rows)], "file string, line int, text string, start_line int")
    assert [r.line for r in pack.import_lines(lines, ["file"]).orderBy("line").collect()] == [1, 2, 3, 4, 6, 7]


def test_stream_equals_batch(spark, tmp_path, small):
    source = spark.read.parquet(f"{small}/events.parquet")
    stream = windows.event_stream(spark, small, source.schema)
    done = windows.tumbling_counts(stream, watermark="1 hour").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    done.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("days").collect()}
    assert got == {(r.start, r.event_type): r.n for r in windows.tumbling_counts(source).collect()}


def test_skipped_files(spark):
    rows = spark.createDataFrame([("r", f"p{k}", "too_large" if k % 2 else None) for k in range(6)] + [("r", "s", "suffix")], "repo string, path string, reason string")
    got = index.skipped_summary(rows, "repo", "path", "reason", sample=2).first()
    assert got.skipped == 3 and [x.path for x in got["sample"]] == ["p1", "p3"]
