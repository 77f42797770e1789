import numpy as np

from quillgraph.llm import toxicity as tx


def test_held_out_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = tx.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.predicted for r in got) >= 0.9 and hit / sum(r.toxic for r in got) >= 0.8
    assert all((r.score >= 0.3) == (r.predicted == 1) for r in got)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(k, f"nice word{k} here " + ("awful scum" if k % 3 == 0 else "fine day"), "aa", 1.0) for k in range(120)] + [(500, None, None, 1.0), (501, "", None, 1.0), (502, "?!", None, 1.0), (None, "nice word1 here awful scum", None, 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(500, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    assert len(got) == 124 and sum(got[k].predicted == (k % 3 == 0) for k in range(120)) >= 118
    assert got[500].score == got[501].score == got[502].score and got[500].predicted == 0
    assert got[None].predicted == 1


def test_scores_do_not_depend_on_the_partition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = tx.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert net.fitted
    alone, dealt = ({r.doc_id: r.score for r in tx.score_texts(docs.repartition(n), net).collect()} for n in (1, 7))
    assert alone == dealt


def _plain_score(text, net):
    """One text's answers by loops over words, filters and coordinates."""
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _ = tx.read_words(data, np.array([0, len(data)]))
    vectors = [sum(net.embedding[k][word[k]].astype(float) for k in range(tx.TABLES)) for word in ids]
    z = float(net.level)
    for j, span in enumerate(tx.SPANS):
        for f in range(tx.FILTERS):
            answers = [net.bias[j][f] + sum(float(vectors[p + s] @ net.filters[j][s][:, f]) for s in range(span)) for p in range(len(vectors) - span + 1)]
            best = max(answers) if answers else (0.0 if len(vectors) else net.bias[j][f])
            z += max(best, 0.0) * float(net.output[j * tx.FILTERS + f])
    votes = sum((net.guess[word[0] & ((1 << tx.GUESS_BITS) - 1)].astype(float) for word in ids), np.zeros(net.guess.shape[1]))
    return 1 / (1 + np.exp(-(z + net.shift[int(votes.argmax()) if len(ids) else -1])))


def test_scores_equal_a_plain_convolution():
    texts = ["good morning to all of you", "bad foul words", "Añ", "", "?!", "one two", "x " * 400 + "foul", "foul"] * 6
    net = tx.fit(texts, [int("foul" in t) for t in texts], ["a", "b"] * 24)
    encoded = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    got = tx.scores(*tx.read_words(np.frombuffer(b"".join(encoded), np.uint8), offsets), net)
    assert np.allclose(got, [_plain_score(t, net) for t in texts], atol=1e-5)


def test_very_long_text_and_repeated_rows(spark):
    net = tx.fit(["nice day"] * 20 + ["awful scum"] * 20, [0] * 20 + [1] * 20, ["a"] * 40)
    docs = spark.createDataFrame([(1, "nice day " * 300_000 + "awful scum"), (2, "nice day"), (2, "nice day")], "doc_id long, text string")
    got = sorted((r.doc_id, r.score) for r in tx.score_texts(docs, net).collect())
    assert len(got) == 3 and got[0][1] > 0.3 > got[1][1] == got[2][1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.toxicity(docs, none).collect()] == [0.0]
    assert tx.toxicity(docs.limit(0), none).count() == 0
