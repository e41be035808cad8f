import re
from collections import defaultdict

import pytest

from tiermark.llm.common import running_total
from tiermark.llm.mixing import mixed, op10, taken


def level(sizes, weights=(1, 2, 3), cap=3):
    """Targets by the rule, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    free = set(order)
    while free:
        left = total - sum(target.values())
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]}
        if not over:
            for s in free:
                target[s] = left * w[s] / sum(w[x] for x in free)
            break
        hit = min(over, key=lambda s: cap * sizes[s] / w[s])
        target[hit] = float(cap * sizes[hit])
        free.discard(hit)
    return target


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def held(rows, docs, near=0.02):
    sizes, got = defaultdict(int), defaultdict(int)
    source = {r["doc_id"]: r["source"] for r in docs}
    for r in docs:
        sizes[r["source"]] += count(r["text"])
    want = level(sizes)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        got[source[r["doc_id"]]] += r["taken"]
    for s, t in want.items():
        assert abs(got[s] - t) <= near * t + 8, (s, got[s], t)


def test_query(spark, documents):
    docs = documents.collect()
    rows = op10(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    assert {r["doc_id"]: r["size"] for r in rows} == {r["doc_id"]: count(r["text"]) for r in docs}
    held(rows, docs)
    assert sorted(rows) == sorted(op10(spark, "/root/testdata/sf0.001").collect())


def test_caps_and_null_source(spark):
    texts = [(i, "w " * (400 if i % 10 else 3), ["a", "b", None, "ö"][i % 4 if i % 3 else 0]) for i in range(300)]
    docs = spark.createDataFrame([*texts, (900, "t " * 50, "tiny"), (901, "", "empty")], "doc_id long, text string, source string")
    held(taken(docs).collect(), docs.collect())


def test_mix_has_the_words_taken(spark, documents):
    want = {r["doc_id"]: r["taken"] for r in taken(documents).collect()}
    rows, texts, got = mixed(documents).collect(), {r["doc_id"]: r["text"] for r in documents.collect()}, defaultdict(int)
    for r in rows:
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += count(r["text"])
    assert {k: v for k, v in want.items() if v} == got
    assert rows[0].asDict().keys() == documents.first().asDict().keys()


def test_odd_rows(odd, nothing):
    rows = taken(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixed(odd).columns == odd.columns and mixed(odd).count() > 0
    assert taken(nothing).collect() == [] and mixed(nothing).collect() == []


def test_running_totals_in_levels(spark):
    """Nested sums, and many repeats of one row."""
    df = spark.range(3000).selectExpr("id % 3 g", "xxhash64(id) & 4611686018427387903 k", "id % 7 + 1 v")
    got = {(r["g"], r["k"]): r["t"] for r in running_total(df, "g", "k", "v", "t", per_part=5, whole=4).collect()}
    want, sums = {}, defaultdict(int)
    for r in sorted(df.collect(), key=lambda r: r["k"]):
        want[r["g"], r["k"]] = sums[r["g"]]
        sums[r["g"]] += r["v"]
    assert got == want
    docs = spark.createDataFrame([(i if i < 300 else 7, f"some words of {i if i < 300 else 7}" + " and more" * 9, "ab"[i % 2] if i < 300 else "a") for i in range(2300)], "doc_id long, text string, source string")
    rows = taken(docs).collect()
    assert len(rows) == 2300 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for s in {r["source_size"] for r in rows}:
        some = [r for r in rows if r["source_size"] == s]
        assert sum(r["size"] for r in some) == s and abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 0.02 * some[0]["target"] + 2048
