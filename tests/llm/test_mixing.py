import hashlib

from quillgraph.llm import mixing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / max(1, sum(weight[x] for x in left)) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


DOCS = [(k, f"{'w ' * (k % 17 + 1)}", "zé" if k < 90 else "a" if k < 110 else None if k < 118 else "B") for k in range(120)] + [(200, None, "a"), (201, " \t", "void"), (None, "x y", "a"), (5, "w w w", "zé"), (5, "w w w", "zé")]


def test_targets_and_taken_words(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, source string, copies int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS)
    sizes = {}
    for _, t, s in DOCS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = {}
    for r in got:
        s = by_size[r.source_size]
        taken[s] = taken.get(s, 0) + r.taken
        assert abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    assert all(abs(taken[s] - want[s]) <= 9 for s in sizes)  # half the largest document
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_copies_follow_the_digest_order(spark):
    docs = [(k, "w w", "s") for k in range(50)] + [(100 + k, "w", "t") for k in range(400)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    place = {k: hashlib.md5(f"mix-1|{k}".encode()).hexdigest() for k in range(100, 500)}
    copies = [got[k].taken for k in sorted(place, key=place.get)]
    assert copies == sorted(copies, reverse=True) and {got[k].taken for k in range(50)} == {6}


def test_rows_are_repeated(spark):
    docs = spark.createDataFrame([(*d, k) for k, d in enumerate(DOCS)], "doc_id long, text string, source string, epoch0 int")
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "epoch"]
    words = mixed.select(mixing.word_count("text").alias("n")).groupBy().sum().first()[0]
    assert words == mixing.mix(docs).groupBy().sum("taken").first()[0]


def test_extra_columns_keep_names_types_and_values(spark):
    names = ["size", "kind", "target", "copies", "epoch", "Reached", "before", "whole", "slice", "words", "row", "a.b"]
    docs = spark.createDataFrame([(*d, *[k] * len(names)) for k, d in enumerate(DOCS)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "epoch_"] and mixed.drop("epoch_").schema == docs.schema
    plain = mixing.mixed(docs.select("doc_id", "text", "source"))
    assert sorted(map(str, mixed.select("doc_id", "text", "source").collect())) == sorted(map(str, plain.drop("epoch").collect()))
    assert all(tuple(r[3:-1]) in {(k,) * len(names) for k in range(len(DOCS))} and DOCS[r[3]] == tuple(r[:3]) for r in mixed.collect())


def test_very_long_text_and_rows_of_one_id_on_the_brink(spark):
    docs = spark.createDataFrame([(1, "w " * 500_000, "a")] + [(2, f"w{k} w", "b") for k in range(9)] + [(3, "w w", "b")], "doc_id long, text string, source string")
    assert max(r.size for r in mixing.mix(docs).collect()) == 500_000
    once, again = (sorted(map(str, mixing.mixed(docs.repartition(n)).where("source = 'b'").collect())) for n in (1, 5))
    assert once == again


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2
