from collections import defaultdict

from pyspark.sql import functions as F

from tiermark.llm.sharding import LIMIT, bits, op9, sharded, write_shards


def tree(items, limit, prefix=""):
    """Leaves by recursion: items are (key bits, bytes)."""
    if sum(b for _, b in items) <= limit or len({k for k, _ in items}) == 1:
        return {prefix: (sum(b for _, b in items), len(items))} if items else {}
    d = len(prefix)
    return tree([x for x in items if x[0][d] == "0"], limit, prefix + "0") | tree([x for x in items if x[0][d] == "1"], limit, prefix + "1")


def keys(df):
    k = F.xxhash64("doc_id", F.xxhash64("text")).bitwiseAND(F.lit((1 << 62) - 1))
    return [(f"{r[0]:062b}", r[1] + 16) for r in df.select(k, F.coalesce(F.octet_length("text"), F.lit(0))).collect()]


def held(df, limit):
    rows = sharded(df, limit).select("bytes", bits(F.col("prefix"), F.col("depth")).alias("s"), "shard_bytes", "shard_rows").collect()
    got = defaultdict(lambda: [0, 0])
    for r in rows:
        got[r["s"]][0] += r["bytes"]
        got[r["s"]][1] += 1
        assert len(rows) == df.count()
    assert {k: tuple(v) for k, v in got.items()} == {r["s"]: (r["shard_bytes"], r["shard_rows"]) for r in rows} == tree(keys(df), limit)


def test_equals_recursive_splitting(documents):
    for limit in (1 << 30, 40_000, 3_000, 20):
        held(documents, limit)


def test_odd_rows(odd, nothing):
    held(odd, 30)
    assert all(r["row"]["kept"] == "clash" for r in sharded(odd, 1000).collect())
    assert sharded(nothing, 1000).collect() == []


def test_write(spark, documents, tmp_path):
    write_shards(documents, f"file://{tmp_path}/shards", 100_000)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.drop("_shard").exceptAll(documents).count() == 0 and back.count() == documents.count()
    assert len(list((tmp_path / "shards").glob("_shard=*"))) == op9_like(documents)


def op9_like(documents):
    return len(tree(keys(documents), 100_000))


def test_query(spark, documents):
    for limit in (LIMIT, 5_000):
        rows = op9(spark, "/root/testdata/sf0.001", limit).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents.collect())
        want = tree(keys(documents), limit)
        assert {r["shard"]: (r["shard_bytes"], r["shard_rows"]) for r in rows} == want and all(len(r["shard"]) == r["depth"] for r in rows)
        assert len(want) > 3


def test_query_splits(spark):
    """Dozens of shards at a scale factor of 0.01; none over the limit but for a row over it."""
    rows = op9(spark, "/root/testdata/sf0.01").select("shard", "shard_bytes", "shard_rows").distinct().collect()
    assert len(rows) > 12 and all(r["shard_bytes"] <= LIMIT or r["shard_rows"] == 1 for r in rows)
