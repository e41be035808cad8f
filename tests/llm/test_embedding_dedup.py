import math

import numpy as np
import pytest

from tiermark.llm import embedding_dedup
from tiermark.llm.embedding_dedup import close_pairs, near_duplicates, op2, quantised, tile_links


def brute(rows, threshold=0.98):
    fine = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    ids = [r[0] for r in rows]
    up, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(fine):
        for b in fine[:k]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    lo, hi = sorted((root(a[0]), root(b[0])))
                    up[hi] = lo
    return {i: (n[i], root(i), root(i) == i) for i in ids}


def got(rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}


def test_error_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 32)) * rng.lognormal(0, 2, (400, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, lost = quantised(x)
    near = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    assert (np.abs(near - x @ x.T) <= lost[:, None] * (1 + lost) + lost * (1 + lost[:, None]) + lost[:, None] * lost + 1e-12).all()
    i, j = close_pairs(x, x, 0.5)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(list, np.nonzero(x @ x.T >= 0.5))))


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    assert got(op2(spark, "/root/testdata/sf0.001").collect()) == brute([(r["vec_id"], r["embedding"], r["label"]) for r in rows])


@pytest.mark.parametrize("tile", [8, 1024])
def test_small_tiles_and_grid(spark, monkeypatch, tile):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 6))
    rows = [(i, [float(v) for v in np.float32(base[i % 25] + rng.normal(size=6) * 0.12)], i % 2) for i in range(420)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)]
    monkeypatch.setattr(embedding_dedup.tile_links, "__defaults__", (tile,))
    made = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got(made.collect()) == brute(rows)
    assert tile_links.__defaults__ == (tile,)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1),
    ]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "vec_id long, embedding array<float>, label int, kept string, n_links int")
    assert got(near_duplicates(df).collect()) == brute(rows)
    assert near_duplicates(df.where("false")).collect() == []
    twice = near_duplicates(df.where("vec_id in (1, 2)").union(df.where("vec_id = 2"))).collect()
    assert len(twice) == 3 and {r["component_id"] for r in twice} == {1}


def test_lengths_that_the_sample_misses(spark, monkeypatch):
    """Links of lengths without directions, or with few, are found once each."""
    import numpy as np

    from tiermark.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "SAMPLE", 40)
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=d).tolist() for d in [4] * 600 + [1] * 2 + [2] * 60 + [3] * 3]
    vectors += [[x * 1.5 + 0.001 for x in v] for v in vectors[-65:]]
    distinct = spark.createDataFrame([(i, i, 1, 0, v) for i, v in enumerate(vectors)], "node long, rep long, copies long, label int, embedding array<double>")
    got = {}
    for r in embedding_dedup.tile_links(distinct, 0.98, tile=4).collect():
        got[r["node"]] = got.get(r["node"], 0) + r["n"]
    unit = [np.array(v) / np.linalg.norm(v) for v in vectors]
    want = {i: sum(j != i and len(u) == len(v) and u @ v >= 0.98 for j, v in enumerate(unit)) for i, u in enumerate(unit)}
    assert got == {i: n for i, n in want.items() if n}


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1.0000001e200, 1e200], 1), (3, [1e-300, 1e-300], 1), (4, [1e308, -1e308], 1), (5, [5e-324, -5e-324], 1)]
    made = got(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert made == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False)}


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (4, [0.02, 1.0], 1)]
    made = got(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert made == {1: (3, 1, True), 2: (1, 1, False), 3: (2, 1, False), 4: (2, 1, False)}


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    near_duplicates(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
