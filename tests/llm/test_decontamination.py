import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tiermark.llm import decontamination
from tiermark.llm.decontamination import OP12_SQL, Words, contaminated, op12

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), ids))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("send", [0, 200_000])
def test_equals_brute_force_on_few_words(spark, send):
    """A vocabulary of three words makes ties, overlaps and repeats of runs."""
    made = random.Random(1)
    some = lambda n: " ".join(made.choice(("a", "B", "cc")) for _ in range(n))
    docs = [(i, some(made.randrange(40))) for i in range(150)] + [(1, some(30)), (None, some(30)), (7, None), (8, ""), (9, "...")]
    items = [(i, some(made.randrange(1, 14))) for i in range(6, 40)] + [(None, some(12)), (3, None), (4, "?"), (5, docs[3][1]), (5, docs[4][1]), (6, docs[3][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(contaminated(a, b, broadcast_rows=send)) == by_hand(docs, items)
    longer = [x for x in items if len(words(x[1])) >= 10]
    assert rows_of(contaminated(a, spark.createDataFrame(longer, b.schema), broadcast_rows=send)) == by_hand(docs, longer)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    made = random.Random(2)
    some = lambda n: " ".join(made.choice("abcdefgh") for _ in range(n))
    docs, items = [(i, some(60)) for i in range(40)], [(i, some(4)) for i in range(9)]
    items.append((77, docs[5][1][20:70]))
    monkeypatch.setattr(decontamination, "MOST", 10)
    monkeypatch.setattr(decontamination, "BITS", 1)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == by_hand(docs, items)


def test_spans_and_planted_passage(spark):
    passage = "The quick brown fox jumps over the lazy dog while nine Ravens watch silently"
    docs = [(1, f"Intro words here. {passage.upper()}! And more."), (2, "The quick brown fox jumps over the lazy dog while"), (3, "the quick brown fox jumps over the lazy dog. Stop")]
    got = {r.doc_id: r for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, passage)], "item_id long, text string")).collect()}
    assert [tuple(s) for s in got[1].spans] == [(3, 17)] and got[1].n_hit == 14 and got[1]["items"] == ["5"]
    assert [tuple(s) for s in got[2].spans] == [(0, 10)]
    assert got[3].n_hit == 0 and got[3].spans == []


def test_odd_and_empty_tables(spark, odd, nothing):
    items = [(1, "ONE two three"), (2, "word " * 12), (3, None)]
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, row string")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(contaminated(odd, b)) == by_hand(docs, items)
    assert contaminated(nothing, b).count() == 0
    assert rows_of(contaminated(odd, b.where("false"))) == by_hand(docs, [])


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(OP12_SQL).fetchall()
    got = op12(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[-1] for r in want)
    assert {r[4] for r in want if not r[-1]} == {hashlib.sha256(b"").hexdigest()}


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(str(i * 7919) for i in range(5000)) + " " + "x" * 9000 + " tail"
    whole = Words(text).hashes
    assert len(np.unique(whole)) == len(whole) == 5002
    monkeypatch.setattr(decontamination, "BLOCK", 1 << 10)
    monkeypatch.setattr(Words, "_up", None)
    again = Words(text).hashes
    monkeypatch.setattr(Words, "_up", None)
    assert (again[:5000] == whole[:5000]).all() and len(np.unique(again)) == 5002
