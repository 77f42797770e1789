import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.llm import near_dup, shared


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """{doc_id: (size, smallest reachable id)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 500, n)]


def edited(base, places, tag):
    out = list(base)
    for p in places:
        out[p] = f"{tag}{p}"
    return " ".join(out)


def test_edge_cases_and_chains(spark):
    base = words(120, 1)
    # a chain of edits: each is near the next, the ends are not near each other
    chain = [edited(base, range(0, 7 * k, 7), "x") for k in range(6)]
    rows = [(None, "a b c d e f"), (3, None), (4, ""), (5, " \t\n"), (6, "Hello World"), (7, "hello world"), (8, "hello  WORLD "), (9, "other"), (10, "a b c d e"), (11, "A b C d E")]
    rows += [(20 + k, t) for k, t in enumerate(chain)] + [(40, chain[2]), (41, chain[2])]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, node string, KEY int")
    got = {r.doc_id: r for r in near_dup.near_duplicates(frame).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, root in want.items():
        assert got[i].component_id == root, i
        assert got[i].kept == (i == root)
    assert got[6].n_shingles == 1 and got[3].n_shingles == got[4].n_shingles == got[5].n_shingles == 0
    assert got[None].kept and got[None].component_id is None


def test_hot_group_of_edits_whose_stars_do_not_settle(spark):
    base = words(200, 2)
    rng = np.random.default_rng(5)
    rows = [(k, edited(base, rng.choice(200, rng.integers(0, 9), replace=False), f"e{k}_")) for k in range(80)]
    rows += [(100 + k, " ".join(words(50, 100 + k))) for k in range(20)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (5, "p q r s t u v"), (5, "one two three four five six")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = near_dup.drop_near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone string"))
    assert kept.columns == ["doc_id", "text", "gone"] and {r.doc_id for r in kept.collect()} >= {1}


def test_rows_of_an_id_in_different_groups(spark):
    a, b = words(60, 7), words(60, 8)
    rows = [(3, " ".join(a)), (7, " ".join(a)), (7, " ".join(b)), (9, edited(b, [3], "z")), (11, " ".join(words(30, 9))), (4, None), (4, "x y z u v w")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (4, 4, True), (4, 4, True), (7, 3, False), (7, 3, False), (9, 3, False), (11, 11, True)]


def test_groups_over_a_tile_are_settled_by_stars_alone(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 2)
    base = words(150, 12)
    rng = np.random.default_rng(15)
    rows = [(k, edited(base, rng.choice(150, rng.integers(0, 11), replace=False), f"e{k % 40}_")) for k in range(90)]
    # sizes differ as well: some are cut or carry more
    rows += [(200 + k, " ".join(edited(base, rng.choice(150, 3, replace=False), f"c{k}_").split()[: 150 - 4 * k] + words(2 * k, 300 + k))) for k in range(12)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rounds_do_not_grow_with_the_size_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 8)
    rounds, around = [], near_dup._around_hubs

    def counted(*args):
        rounds.append(1)
        assert len(rounds) <= 4
        return around(*args)

    monkeypatch.setattr(near_dup, "_around_hubs", counted)
    # 40 whole sets in one component; others are in the union of any four of these, but near to none of them
    rng = np.random.default_rng(22)
    sets = {k: {*range(120)} - set(rng.choice(120, 12, replace=False).tolist()) for k in range(40)}
    sets |= {k: set(rng.choice(120, 85, replace=False).tolist()) for k in range(40, 64)}
    # three of these are near a single whole set, and two near each other
    sets |= {64 + k: set(sorted(sets[30 + k])[k : 84 + k]) for k in range(3)} | {67: set(sorted(sets[50])[3:])}
    stars = spark.createDataFrame([(5, 0, k, len(sets)) for k in sets if k], "key long, a long, b long, m long")
    roots = spark.createDataFrame([(k, 0) for k in range(1, 40)], "node long, root long")
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, shingles array<long>")
    got = {r.node: r.root for r in near_dup._settle(stars, roots, frame, shared.Scratch(spark, "test")).collect()}
    home, near = {k: 0 if k < 40 else k for k in sets}, lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    for _ in sets:
        for i in sets:
            home[i] = min(home[j] for j in sets if home[j] == home[i] or near(sets[i], sets[j]))
    assert rounds and got == {k: v for k, v in home.items() if k >= 40 and v < k} and {64, 65, 66, 67} <= set(got)


def test_blocks_lose_no_link_between_components(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 4)
    monkeypatch.setattr(near_dup, "STRIP", 16)
    rng = np.random.default_rng(31)
    sets = {k: sorted({*range(60), *range(1000, 1040)} - set(rng.choice(60, rng.integers(0, 30), replace=False).tolist()) | {2000 + k}) if k < 40 else sorted(rng.choice(60, 40, replace=False).tolist()) for k in range(60)}
    rows = [(key, k, k + 100, 0 if k < 30 else k, len(v)) for key in (1, 2) for k, v in sets.items() if key == 1 or k % 3]
    # the last group is of one lone member, whose partner is in the largest component
    rows += [(3, k, k + 100, 0, len(sets[k])) for k in range(5)] + [(3, 35, 135, 35, len(sets[35]))]
    members = spark.createDataFrame(rows, "key long, node long, home long, part long, n long")
    got = {tuple(sorted((r.a, r.b))) for r in near_dup._across(members, spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")).collect()}
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {(a, b) for ka, a, _, p, _ in rows for kb, b, _, q, _ in rows if ka == kb and a < b and p != q and near(set(sets[a]), set(sets[b]))}
    part = {k: 0 if k < 30 else k for k in sets}
    assert {(a - 100, b - 100) for a, b in got} <= want
    assert {tuple(sorted((part[a - 100], part[b - 100]))) for a, b in got} == {tuple(sorted((part[a], part[b]))) for a, b in want} != set()


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "a b c d e f g")]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 299_996), 2: (1, 299_997), 3: (3, 3)}


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(docs).collect()}
    want = brute(rows)
    assert got == {i: (want[i], len(shingles(t))) for i, t in rows}


def test_word_hashes_do_not_depend_on_place_or_pieces(monkeypatch):
    text = "Añ b " + "long" * 50 + "  tail\tEnd a\u00f1 B"
    data, offsets = shared.text_bytes(pa.array([text, None, "", "b tail"]))
    whole, first = shared.word_hashes(data, offsets)
    monkeypatch.setattr(shared, "PASS_BYTES", 16)
    again, _ = shared.word_hashes(data, offsets)
    assert (whole == again).all() and list(first) == [0, 7, 7, 7, 9]
    assert whole[0] == whole[5] and whole[1] == whole[6] == whole[7] and whole[3] == whole[8] and len(set(whole)) == 5


def test_bitmaps_lose_no_asked_id(spark):
    docs = spark.range(-5000, 40000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "x"), (2**62, "x")], "doc_id long, text string"))
    ids = docs.where("doc_id % 7 = 0 or doc_id = 4611686018427387904").select(F.col("doc_id").alias("node"))
    some = near_dup._maybe_in(docs, "doc_id", ids)
    asked = ids.count()
    assert ids.join(some, ids["node"] == some["doc_id"], "left_anti").count() == 0
    assert asked <= some.count() <= asked + 200
    assert near_dup._maybe_in(docs, "doc_id", ids.limit(0)).count() == 0


def written_to_shuffles(spark, act):
    """Bytes that the stages which ``act`` runs write to exchanges."""
    sc = spark.sparkContext
    sc.setJobGroup("written_to_shuffles", "")
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    before = set(tracker.getJobIdsForGroup("written_to_shuffles"))
    act()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("written_to_shuffles") if j not in before]
    sc.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in {s for j in jobs for s in j.stageIds} if tracker.getStageInfo(s))


def test_texts_of_rows_that_stay_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 2**40, 300))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, texts[7]), (901, texts[8] + " more"), (None, "a b"), (7, texts[7])]
    spark.createDataFrame([(i, t, "p", b"", True) for i, t in rows], "doc_id long, text string, part string, BITS binary, gone boolean").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = near_dup.drop_near_duplicates(docs)
        written = written_to_shuffles(spark, lambda: left.write.parquet(f"{tmp_path}/left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert left.dtypes == docs.dtypes
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/left").collect()) == sorted((i is None, i, t) for i, t in rows if i not in (900, 901))
    assert written < sum(map(len, texts)) / 10


def test_tables_are_written_without_late_broadcasts_and_garbage_goes(spark, monkeypatch):
    monkeypatch.setattr(shared, "COLLECT_EVERY", 2)
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    seen, collected = [], []

    class Session:
        def __getattr__(self, name):
            return getattr(spark, name)

    class Machine:
        class System:
            gc = staticmethod(lambda: collected.append(scratch.count))

    own = Session()
    own._jvm = Machine()
    scratch = shared.Scratch(own, "settings", near_dup.NO_LATE_BROADCASTS)

    class Frame:
        schema = spark.range(1).schema

        class write:
            @staticmethod
            def parquet(path):
                seen.append(spark.conf.get(key, None))
                spark.range(3).write.parquet(path)

    before = spark.conf.get(key, None)
    assert [scratch.keep(Frame).count() for _ in range(5)] == [3] * 5
    assert seen == ["-1"] * 5 and spark.conf.get(key, None) == before
    assert collected == [2, 4]
