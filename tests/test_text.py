from pyspark.sql import functions as F

from quillgraph.functions import paths, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("v")).first().v


def test_identifiers_and_tokens(spark):
    assert one(spark, text.identifier_parts("x"), x="HTTPServer2GoFast") == ["HTTPServer2", "Go", "Fast"]
    assert one(spark, text.identifier_parts("x"), x="fooBar.baz_qux") == ["foo", "Bar", "baz", "qux"]
    assert one(spark, text.tokens("x"), x="école_X the fooBar foo") == ["cole", "foo", "bar", "foo"]
    assert one(spark, text.query_terms("x"), x="bb aa bb aa cc") == ["bb", "aa", "cc"]
    assert one(spark, text.query_terms("x"), x=None) == []
    assert one(spark, text.dotted_symbols("x"), x="see a.b and a.b.c or a.b") == ["a.b", "a.b.c"]


def test_lines(spark):
    assert one(spark, text.lines_of("x"), x="a\r\nb\x0bc\u2028d\n") == ["a", "b", "c", "d"]
    assert one(spark, text.lines_of("x"), x="") == [] and one(spark, text.lines_of("x"), x="\n") == [""]
    assert one(spark, text.numbered_lines(text.lines_of("x"), 9), x="a\nb") == "   9 | a\n  10 | b"


def test_modules_and_targets(spark):
    assert one(spark, text.module_name("x"), x="a\\b/__init__.py") == "a.b"
    assert one(spark, text.module_name("x"), x="a/b.pyi") == "a.b"
    hint = one(spark, text.target_hints("t", "k"), t="p.m.C.run", k="method")
    assert (hint.module, hint.path) == ("p.m", "p/m.py")
    assert one(spark, text.target_hints("t", "k"), t="p.m.f", k="function").module == "p.m"


def test_numbers(spark):
    ratio = lambda a, b: one(spark, text.safe_ratio(F.lit(a), F.lit(b)), x="")
    assert ratio(1, 0) is None and ratio(1, 128) == 0.007812 and abs(ratio(1, 640) - 1 / 640) < 1e-6
    assert one(spark, text.tool_tokens("x"), x="") == 0 and one(spark, text.tool_tokens("x"), x="abcde") == 2
    assert one(spark, text.pack_tokens("x"), x="") == 1 and one(spark, text.pack_tokens("x"), x="abcde") == 2
    assert one(spark, text.as_int("x", 7), x="12") == 12 and one(spark, text.as_int("x", 7), x="x1") == 7


def test_calls_and_comments(spark):
    assert one(spark, text.without_comment("x"), x="a('#') + \"#\" # tail") == "a('#') + \"#\" "
    assert one(spark, text.without_comment("x"), x="no comment") == "no comment"
    assert one(spark, text.call_expressions("x"), x="y = a.b(len(z), c(d)) if(x) # e()") == ["a.b", "c"]
    assert one(spark, text.callback_arguments("x"), x="sig.connect(self.run, x)") == ["self.run"]
    assert one(spark, text.callback_arguments("x"), x="register(a.b, c.signals)") == ["a.b"]
    assert one(spark, text.callback_arguments("x"), x="plain(a.b)") == []
    assert one(spark, text.boundary_role("e", "x"), e="q.append", x="q.append(1)") == "state_or_container_call"
    assert one(spark, text.boundary_role("e", "x"), e="run", x="run()") == "direct_call_expression"


def test_pattern_counts_are_capped_and_do_not_overlap(spark):
    count = lambda t, p: one(spark, text.occurrences(F.col("t"), F.col("p")), t=t, p=p)
    assert count("aaaaaaaaaa", "aa") == 4 and count("aaa", "aa") == 1 and count("aaa", "") == 0 and count("AA", "aa") == 0


def test_redaction(spark):
    keys = {"api_key": "1", "api-key": "2", "api_key_env": "3", "token_required": "4", "Password": "", "x": "5", "auth_token": "6"}
    hidden = one(spark, text.redacted(F.create_map(*[F.lit(v) for kv in keys.items() for v in kv])), x="")
    assert hidden == keys | {"api_key": "<redacted>", "api-key": "<redacted>", "auth_token": "<redacted>"}


def test_paths(spark):
    p = {"tests/a.py": (True, True), "src/test_x.py": (True, True), "a.spec.ts": (False, True), "src/a.py": (False, False), "a/b_test.py": (True, True)}
    for path, (narrow, wide) in p.items():
        assert one(spark, paths.is_test_path("x"), x=path) == narrow and one(spark, paths.is_test_path("x", wide=True), x=path) == wide
    relative = {"C:/x.py": False, "../x.py": False, "a/../x.py": False, "http://h/x.py": False, "/x.py": False, "<s>": False, "": True, "a/x.py": True}
    for path, want in relative.items():
        assert one(spark, paths.is_repo_relative("x"), x=path) == want, path
    assert one(spark, paths.is_external_path("x"), x="a/site-packages/b.py") and one(spark, paths.is_external_path("x"), x=None) is False
    assert one(spark, paths.inside("x", "/r"), x="a/../b") and not one(spark, paths.inside("x", "/r"), x="a/../../b")


def test_slugs(spark):
    assert one(spark, text.safe_name("x"), x="  My Run/1! ") == "my-run-1" and one(spark, text.safe_name("x"), x="!!") == "run"
    assert one(spark, text.evidence_text("x"), x="  a \t b\n") == "a b" and one(spark, text.markdown_cell("x"), x=" a|b\nc ") == "a\\|b c"
