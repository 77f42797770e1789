import math

import numpy as np

from quillgraph.llm import embed_dup


def brute(rows):
    ok = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array(v, float)
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ok)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = ok[i], ok[j]
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (links[i], find(i)) for i, _ in rows}


def check(spark, rows, recall=0.99):
    frame = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: r for r in embed_dup.near_vectors(frame).collect()}
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(rows)
    assert len(got) == len(want)
    found, total = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items()) and found >= recall * total
    return got, want


def test_against_brute_force_with_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(150, 64)))]
    for k in range(400):
        noise = rng.normal(size=64) * rng.uniform(0, 0.4)
        rows.append((1000 + k, ((base[k % 30] + noise) * rng.uniform(0.5, 9)).tolist()))
    rows += [(5000 + k, base[0].tolist()) for k in range(60)]
    got, want = check(spark, rows)
    assert sum(got[i].component_id == r for i, (_, r) in want.items()) >= 0.99 * len(want)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_a_bucket_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "TILE", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    check(spark, [(k, (base + rng.normal(size=16) * 0.02).tolist()) for k in range(100)], recall=1.0)


def test_defined_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 3.0]), (5, [1.0, float("nan"), 3.0]), (6, [1.0, float("inf"), 3.0]), (7, v), (8, [2.0, 4.0, 6.0]), (9, v), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0])]
    got, want = check(spark, rows, recall=1.0)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    extra = spark.createDataFrame([(None, v), (1, v), (1, v), (2, v)], "vec_id long, embedding array<float>")
    rows = embed_dup.near_vectors(extra).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in rows if r.vec_id) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert [(r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is None] == [(0, None, True)]
    assert embed_dup.near_vectors(extra.limit(0)).count() == 0


def test_rows_of_an_id_with_different_vectors(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 32))
    near = lambda v: (v + rng.normal(size=32) * 0.01).tolist()
    rows = [(1, near(a)), (7, near(a)), (7, near(b)), (9, near(b)), (12, rng.normal(size=32).tolist())]
    got = embed_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (7, 1, 1), (7, 1, 1), (9, 1, 1), (12, 0, 12)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(2, 300, 64))
    y = x + y * 0.5
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    turn = embed_dup.rotations(64, 64)
    a, b = x @ turn, y @ turn
    code = np.where(a > 0, 1, -1) / 8
    f = (code * a).sum(1)
    error = (code * b).sum(1) / f - (x * y).sum(1)
    slack = embed_dup.SIGMAS * np.sqrt((1 - f * f) / (f * f) / 63)
    assert abs(error.mean()) < 0.02 and (np.abs(error) <= slack).all()
