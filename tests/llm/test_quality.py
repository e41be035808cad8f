import re
from collections import Counter

from pyspark.sql import functions as F

from tiermark.llm.quality import COUNTS, op3, quality, threshold, trusted_ids, weights


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    cover = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n)


def test_counts_equal_brute_force(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = op3(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (*[r[c] for c in COUNTS], r["base_failed"]) == plain(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_repeats(spark):
    texts = ["a b c d e f g h " * 5, "x " * 40, " ".join(map(str, range(30))) + " " + " ".join(map(str, range(9))), "q " * 8, "q " * 9, "l\nl\n\nm\nl\n \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality(docs, labels).collect():
        assert (*[r[c] for c in COUNTS], r["base_failed"]) == plain(texts[r["row"]["doc_id"]])
        assert r["kept"] == (not r["base_failed"])


def test_verdict_separates_labelled(spark):
    """Held against all labels at sf0.01: nearly all trusted documents stay, most of poor quality go."""
    sf = "/root/testdata/sf0.01"
    both = op3(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in both if r["quality"] == 1 and r["toxic"] == 0]
    poor = [r["kept"] for r in both if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.3 * len(poor)


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, None), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = quality(odd, labels).collect()
    want = sorted((str(r["doc_id"]), *plain(r["text"])) for r in odd.collect())
    assert sorted((str(r["row"]["doc_id"]), *[r[c] for c in COUNTS], r["base_failed"]) for r in rows) == want
    assert all(r["row"]["kept"] == "clash" for r in rows)
    assert quality(nothing, labels).collect() == []


def test_all_trusted_count(spark):
    """25,000 trusted documents, all there are: each bucket has one share among them and in the corpus, so no weight."""
    ids = spark.range(25_000)
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    docs = ids.select(F.col("id").alias("_id"), F.concat(F.lit("w"), "id").alias("_text"))
    assert trusted_ids(labels).count() == 25_000
    assert not any(weights(docs, trusted_ids(labels)))
    half = weights(docs, trusted_ids(labels.where("doc_id % 2 = 0")))
    assert any(half)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert weights(docs, trusted_ids(labels.where("doc_id % 2 = 0"))) == half
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_threshold_is_exact(spark):
    scores = [(i, (i * 7919) % 30_011 - 15_000) for i in range(30_000)]
    trusted = {i for i, _ in scores if i % 3}
    made = spark.createDataFrame([*scores, (1, None), (None, -10**6)], "_id long, _whole long")
    ids = spark.createDataFrame([(i,) for i in trusted], "_trusted long")
    values = sorted(s for i, s in scores if i in trusted)
    for recall in (0.998, 0.5, 1.0):
        least = threshold(made, ids, recall)
        assert sum(v >= least for v in values) >= recall * len(values) > sum(v > least for v in values)
    assert threshold(made.where("_whole is null"), ids) is None
