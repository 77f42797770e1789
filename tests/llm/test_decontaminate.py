import hashlib
import re

import pytest

from quillgraph.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    grams = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"w{k}" for k in range(30))
ITEMS = [(1, LONG), (2, "Alpha beta"), (3, "x"), (4, None), (5, "... !"), (10, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (11, "été ÉTÉ noël")]
DOCS = [(1, "A " + LONG.upper() + " b"), (2, "alpha-BETA! gamma alpha beta"), (3, None), (4, ""), (5, "!!"), (6, "x x y"), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (8, "w5,w6,w7,w8,w9,w10,w11,w12,w13,w14,w15"), (8, "x"), (9, "Été été ÉTÉ noël"), (10, "été ÉTÉ NoËl été ÉTÉ noël"), (12, "clean text " * 50)]


@pytest.mark.parametrize("most", [dc.MAX_SET, 0])
def test_against_brute_force(spark, most):
    docs, items = spark.createDataFrame([(i, t, 7, "s") for i, t in DOCS], "doc_id long, text string, words int, anchors string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.report(docs, items, max_set=most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute(DOCS, ITEMS)
    kept = dc.drop_contaminated(docs, items, max_set=most)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(DOCS, ITEMS) if not r[5])


def test_whole_table(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in dc.report(docs, items).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_spans_are_cut(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.text for r in dc.cut_spans(docs.where("doc_id <> 8"), items).collect()}
    assert got[1].split() == ["A", "b"] and got[2] == "-! gamma  " and got[3] is None and got[12] == DOCS[-1][1]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.report(none, items).count() == 0
    got = dc.report(spark.createDataFrame(DOCS, "doc_id long, text string"), items.limit(0)).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)
