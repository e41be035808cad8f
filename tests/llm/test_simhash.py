import random
import re

import pytest
import xxhash

from tiermark.llm.components import components
from tiermark.llm.simhash import fingerprint, hex_of, near_links, op8, simhash_groups


def plain(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def union(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}


def test_fingerprint(documents):
    for r in documents.limit(60).collect():
        assert fingerprint(r["text"], 3) == plain(r["text"], 3)
    for t in (None, "", "  ", "One", "one TWO", "É é A", "a b c d"):
        assert fingerprint(t, 3) == plain(t, 3)


@pytest.mark.parametrize("bucket", [2, 48])
def test_links_join_all_close_fingerprints(spark, bucket):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(14)})
    signed = [(x - (1 << 64) if x >= 1 << 63 else x, i) for i, x in enumerate(fps)]
    rows = near_links(spark.createDataFrame(signed, "fp long, rep long"), 2, bucket=bucket).collect()
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 2 for r in rows)
    want = union(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert union(range(len(fps)), [(r["a"], r["b"]) for r in rows]) == want


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    some = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    links = chain + star + some + [(7, 7), (None, 3)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    true = [x for x in chain + star + some if x[0] != x[1]]
    assert {r["node"]: r["component"] for r in rows} == union({x for p in true for x in p}, true)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query_equals_brute_force(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    fp = {i: plain(t, 3) for i, t in texts.items()}
    ids = sorted(fp)
    want = union(ids, [(a, b) for a in ids for b in ids if b < a and (fp[a] ^ fp[b]).bit_count() <= 2])
    rows = op8(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_odd_rows(odd, nothing):
    rows = simhash_groups(odd, 3).withColumn("x", hex_of("fp")).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == by[5] == 1 and by[2] == by[3] == by[4] == 2 and by[8] == 8
    assert simhash_groups(nothing).collect() == []
