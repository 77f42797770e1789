import numpy as np

from quillgraph.llm import language as lg


def _words(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return lg.read_words(data, np.array([0, len(data)]))


def test_held_out_accuracy_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lg.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    assert len(got) > 200 and right >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "the the and", "aa", None), (2, "der die und", "bb", 1), (4, None, "aa", 1), (5, "", "bb", 1), (6, "12 345 !!", "aa", 1), (7, "— … €", None, 1), (8, "THE And", None, 1), (None, "und der", None, 1)] + [(100 + k, "the and of the" if k % 2 else "der und die", "aa" if k % 2 else "bb", 1) for k in range(40)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in lg.identify(docs).collect()}
    assert [got[i].lang_pred for i in (4, 5, 6, 7)] == ["und"] * 4 and got[4].score == 0
    assert got[8].lang_pred == "aa" and got[None].lang_pred == "bb"
    kept = lg.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({4, 5, 6, 7})


def test_extra_columns_keep_names_types_and_values(spark):
    rows = [(k, "the and of the" if k % 2 else "der und die", "aa" if k % 2 else "bb", k, str(k), float(k), k * 2) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score int, lang_pred string, `a.b` double, held_out long")
    kept = lg.keep_identified(docs)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == rows


def test_very_long_text_and_repeated_rows(spark):
    model = lg.fit(["the and of the "] * 8 + ["der und die "] * 8, ["aa"] * 8 + ["bb"] * 8)
    docs = spark.createDataFrame([(1, "der und die " * 250_000), (2, "the and"), (2, "the and")], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in lg.detect(docs, model).collect()) == [(1, "bb"), (2, "aa"), (2, "aa")]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lg.identify(docs).collect()] == ["und"]
    assert lg.identify(docs.limit(0)).count() == 0


def test_blocks_equal_plain_forward_backward():
    rng = np.random.default_rng(1)
    first = np.array([0, 0, 3, 200, 201, 333])
    score, moves = rng.normal(size=(333, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    sums = lg.posterior_sums(score, first, moves)
    for k in range(5):
        own = score[first[k] : first[k + 1]].astype(float)
        want = lg.label_words(own, moves.astype(float)).sum(0) if len(own) else np.zeros(3)
        assert np.allclose(sums[k], want, atol=1e-3)


def test_words_of_a_code_switched_text():
    a, b = "thing that there with other", "über schön nicht wäre für"
    model = lg.fit([f"{a} " * 12] * 6 + [f"{b} " * 12] * 6, ["x"] * 6 + ["y"] * 6)
    words = _words(f"{a} {b}")
    best = lg.label_words(lg.emissions(words, model.weights).astype(float), model.moves.astype(float)).argmax(1)
    assert list(best) == [0] * 5 + [1] * 5


def test_latin_capitals_fold():
    upper, lower = _words("Été ÑU"), _words("été ñu")
    assert (upper.trigrams == lower.trigrams).all() and (upper.affixes == lower.affixes).all()
