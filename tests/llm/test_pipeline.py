"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import base64
import hashlib
import struct
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_quality import plain as counts
from tests.llm.test_secrets import plain as secrets
from tests.llm.test_similar import shingles
from tests.llm.test_simhash import union

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, rows = documents, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        made = stage(spark, docs, SF)
        docs = spark.createDataFrame(made.collect(), made.schema)
        if i < 4:
            assert docs.columns == documents.columns, name
        old = {r["doc_id"]: r for r in before.collect()}
        rows = docs.collect()
        if i == 0:
            kept = {r["doc_id"] for r in rows}
            assert not any(counts(old[k]["text"])[-1] for k in kept)
            good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
            clean = {k for k in good if k in old and not counts(old[k]["text"])[-1]}
            assert len(clean - kept) <= 0.02 * len(clean) + 1
        elif i == 1:
            sets = {k: shingles(r["text"]) for k, r in old.items()}
            near = lambda least: [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
            must = union(sorted(sets), near(0.8))
            kept = {r["doc_id"] for r in rows}
            assert set(must.values()) <= kept and len(kept - set(must.values())) <= 1
            assert all(old[r["doc_id"]] == r for r in rows)
        elif i == 2:
            for r in rows:
                text, spans = old[r["doc_id"]]["text"], secrets(old[r["doc_id"]]["text"])
                assert all(text[s:e] not in r["text"] for s, _, e in spans) and (spans or r["text"] == text or "[secret]" in r["text"])
                assert r["n_chars"] == len(r["text"])
            assert len(rows) == len(old)
        elif i == 3:
            assert {r["doc_id"] for r in rows} <= set(old) and all(old[r["doc_id"]]["text"].startswith(r["text"]) for r in rows)
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
        else:
            said = Counter()
            for r in before.collect():
                ids = library.encode_ordinary(r["text"])
                said[r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
            assert Counter(map(tuple, rows)) == said
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(rows)


def test_odd_rows(spark, odd):
    for data in (odd, odd.where("false")):
        docs = data
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame((made := stage(spark, docs, SF)).collect(), made.schema)
        assert docs.columns[0] == "doc_id"
