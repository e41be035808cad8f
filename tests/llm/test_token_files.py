import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tiermark.llm import token_files
from tiermark.llm.token_files import Words, op7, read_tokens, token_index, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, rows):
    start, found = 0, []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        found.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_words_equal_whole_texts(library):
    rng, words = random.Random(8), Words(PATH)
    parts = ["Don't", "IT'S", "é", "é", "́", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "ΣΑΣ", "Σ", "ß", "日本", "\U0001f600", "12", "...", "<|endoftext|>", "a", "İ", ".", ",", "!", "|", "x.", "É,", "'s.", "ẞ", "µ!", "Ĳ", "ŉ", "ª", "q" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_stems_are_encoded_once_and_tails_apart(library, monkeypatch):
    words, asked = Words(PATH), []
    learn = words._learn_letters
    monkeypatch.setattr(words, "_learn_letters", lambda some: asked.extend(some) or learn(some))
    rng = random.Random(3)
    stems = ["word", "Word", "WORD", "été", "ÉTÉ", "Straße", "µm", "ªº", "a", "don't", "x1", "<|endoftext", "<|ENDOFTEXT", "q" * 63, "q" * 64, "日本", "_a", "", "e\u0301"]
    tails = ["", ".", ",", "!!", "...", "|>", ")-", "<|", "'", "'s", "=", "\u0338", "."*70]
    texts = [" ".join(rng.choice(stems) + rng.choice(tails) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    for part in (texts[:5], texts[5:1000], texts[1000:]):
        for t, ids in zip(part, words.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(asked) == len(set(asked)) and sorted(asked) == sorted(["word", "été", "straße", "µm", "ªº", "a", "q" * 63, "q" * 64])


def test_columns_with_nulls_and_forgotten_words(library, monkeypatch):
    monkeypatch.setattr(token_files, "KEEP", 3)
    words = Words(PATH)
    rows = ["skipped", None, "", "one  two,\n three", "four " * 3, None, "One two"]
    for _ in range(3):
        ids, sizes = words.encode_column(pa.array(rows, pa.string()).slice(1), [2])
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in rows[1:]]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    ids, sizes = words.encode_column(pa.array([], pa.string()), [2])
    assert len(ids) == len(sizes) == 0 and words.encode([]) == []


def test_query(spark, documents, library):
    rows = op7(spark, "/root/testdata/sf0.001").collect()
    want = plain(library, sorted((r["doc_id"], r["text"]) for r in documents.collect()))
    assert sorted(map(tuple, rows)) == want


def test_files(spark, documents, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_tokens(documents, path, PATH, 2)
    files = sorted((tmp_path / "tokens").glob("*.orc"))
    read = read_tokens(spark, path)
    assert read.where("doc_id = 77").select("doc_id").collect()[0][0] == 77
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in read.where("doc_id = 77")._jdf.queryExecution().toString()
    ids = [orc.ORCFile(f).read(["doc_id"])["doc_id"].to_pylist() for f in files]
    assert all(x == sorted(x) for x in ids) and sum(map(len, ids)) == 200
    last = [x for x in ids if x]
    assert all(a[-1] < b[0] for a, b in zip(last, last[1:], strict=False))


def test_odd_rows(spark, odd, nothing, tmp_path, library):
    write_tokens(odd, f"file://{tmp_path}/odd", PATH, 2)
    rows = sorted(token_index(read_tokens(spark, f"file://{tmp_path}/odd")).collect(), key=lambda r: r["start"])
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in odd.collect()), key=lambda x: x[:2])
    assert [tuple(r) for r in rows] == plain(library, [(i if known else None, t) for known, i, t in texts])
    write_tokens(nothing, f"file://{tmp_path}/none", PATH, 2)
    assert token_index(read_tokens(spark, f"file://{tmp_path}/none")).collect() == []


def test_conditions_on_doc_id_skip_stripes_and_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "STRIPE", 1 << 16)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    pick = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", i), F.lit(500)) + 1).cast("int")))
    write_tokens(spark.range(60000).select(F.col("id").alias("doc_id"), F.array_join(pick, " ").alias("text")), f"file://{tmp_path}/t", PATH, 2)
    assert max(orc.ORCFile(f).nstripes for f in (tmp_path / "t").glob("*.orc")) > 2

    def read(condition):
        """Rows found, and rows that the scan had to read for them."""
        made = read_tokens(spark, f"file://{tmp_path}/t").where(condition).select("doc_id", F.array_max("ids"))
        rows = made.collect()
        return len(rows), made._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()

    assert read("doc_id >= 0") == (60000, 60000)
    found, seen = read("doc_id = 31234")
    assert found == 1 and seen <= 2 * token_files.STRIDE


def test_repeated_doc_id_is_dealt_out(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one row many times").alias("text"))
    write_tokens(rows, f"file://{tmp_path}/same", PATH, 2)
    made = read_tokens(spark, f"file://{tmp_path}/same")
    assert made.groupBy("shard").count().count() > 2
    n = made.first()["n_tokens"]
    assert sorted(r["start"] for r in token_index(made).collect()) == [n * i for i in range(4000)]
