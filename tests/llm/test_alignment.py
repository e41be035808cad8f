import hashlib
import json
import random
from collections import Counter

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tiermark.llm.alignment import ByteLevel, Pieces, alignments, byte_of, runs

PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    """The tokenizers library itself, and bytes of its entries read by hand."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    back = byte_of()
    names = {i: t for t, i in json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"].items()}
    return a, {i: bytes(back[c] for c in t) for i, t in names.items() if all(c in back for c in t)}, Pieces(PATHS[1])


def by_hand(libraries, texts):
    """Groups by the common ends of both, links by comparing every A token with every B token near it."""
    model, a_bytes, b_model = libraries
    found, counts = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        a, b = model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        x, y = [a_bytes[i] for i in a], [b_model.bytes[i] for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            found.append(None)
            continue
        spans = []
        for tokens in (x, y):
            at, here = 0, []
            for t in tokens:
                here.append((at, at + len(t)))
                at += len(t)
            spans.append(here)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, sp, strict=True) if s >= start and e <= end) for ids, sp in ((a, spans[0]), (b, spans[1]))))
            start = end
        links, q = [], 0
        for i, (s, e) in zip(a, spans[0], strict=True):
            while spans[1][q][1] <= s:
                q += 1
            k = q
            while k < len(b) and spans[1][k][0] < e:
                links.append((i, b[k]))
                k += 1
        counts.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = {}
    for (i, _), c in counts.items():
        best[i] = max(best.get(i, 0), c)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            rows.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows, counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_equals_brute_force(spark, documents, libraries):
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want, counts = by_hand(libraries, [t for _, t in texts])
    want = sorted(((i, *w) for (i, _), w in zip(texts, want, strict=True)), key=repr)
    got, pairs = alignments(documents, *PATHS)
    assert rows_of(got) == want
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == counts
    assert rows_of(alignments(documents, *PATHS, frequent=0)[0]) == want
    assert rows_of(alignments(documents, *PATHS, frequent=500)[0]) == want


def test_odd_rows(odd, nothing, libraries):
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want, _ = by_hand(libraries, [t for _, t in texts])
    assert rows_of(alignments(odd, *PATHS)[0]) == sorted(((i, *w) for (i, _), w in zip(texts, want, strict=True)), key=repr)
    assert alignments(nothing, *PATHS)[0].count() == 0


def test_texts_that_do_not_come_back(spark):
    rows = spark.createDataFrame([(1, "a ▁ b"), (2, "<|endoftext|> and <s> or <unk> <0x41>"), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignments(rows, *PATHS)[0].collect()}
    assert got[1].n_a == 0 and got[1].groups_sha256 == ""
    assert got[2].n_a > 10 and got[3].n_a == 1


def test_runs_at_random():
    made = random.Random(5)
    for _ in range(500):
        n = made.randrange(1, 60)
        a, b = (sorted({*made.sample(range(1, n + 1), made.randrange(n)), n}) for _ in "ab")
        if made.random() < 0.3:
            b = a[:]
            if len(b) > 2:
                b.pop(made.randrange(len(b) - 1))
        groups = list(runs(a, b))
        ends = []
        for p, i, q, j in groups:
            if i - p == j - q and a[p] == b[q]:
                assert a[p:i] == b[q:j]
                ends += a[p:i]
            else:
                assert a[i - 1] == b[j - 1] and not set(a[p : i - 1]) & set(b[q : j - 1])
                ends.append(a[i - 1])
        assert ends == sorted(set(a) & set(b))


def test_both_libraries_agree(libraries):
    made, own = random.Random(3), ByteLevel(PATHS[0], PATHS[2])
    signs = ["a", "B", "é", "日", "1", "٣", " ", "\n", "\t", "'s", "'RE", "-", "\U0001f600", "́", "\xa0", "\x00", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(made.choice(signs) for _ in range(made.randrange(80)))
        assert own.encode(text) == libraries[0].encode(text, add_special_tokens=False).ids
    for text in ("=" * 200_000, " " * 100_000, "word " * 50_000, "\n \n" * 3000):
        assert own.encode(text) == libraries[0].encode(text, add_special_tokens=False).ids
