import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tiermark.llm import bpe
from tiermark.llm.bpe import TreeBPE, digests

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_tree_equals_library_on_random_pieces(reference):
    model, rng = TreeBPE(PATH), random.Random(5)
    for _ in range(3000):
        piece = "".join(rng.choice("aaabtheinon éß日\U0001f600") for _ in range(rng.randint(1, 40))).replace(" ", "")
        if piece:
            raw = piece.encode()
            assert [model.ranks[x] for x in model.tree(raw)] == reference._core_bpe.encode_single_piece(raw), piece
    raw = b"a" * 5000
    assert [model.ranks[x] for x in model.tree(raw)] == reference._core_bpe.encode_single_piece(raw)


def test_join_is_associative():
    model, rng = TreeBPE(PATH), random.Random(7)
    for _ in range(300):
        a, b, c = (model.tree(bytes(rng.choice(b"ontheri") for _ in range(rng.randint(1, 9)))) for _ in range(3))
        assert model.joined(model.joined(a, b), c) == model.joined(a, model.joined(b, c))


def test_documents_equal_library(documents, reference):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = digests(documents, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(reference, texts[r["doc_id"]])


def test_odd_rows(odd, nothing, reference):
    rows = digests(odd, PATH, public_tokenizers.PATTERN).collect()
    want = sorted((str(r["doc_id"]), *expected(reference, r["text"])) for r in odd.collect())
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want
    assert digests(nothing, PATH, public_tokenizers.PATTERN).collect() == []


def test_long_runs_and_decoding_up_the_tree():
    import regex

    model = TreeBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    cut = regex.compile(public_tokenizers.PATTERN)
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    for text in ("=" * 9000, "-=" * 3000, "ab" * 5000, "é" * 4001, "x" * 48, "x" * 49):
        ids = model.encode(cut.findall(text))
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert model.decode(ids) == text.encode()
    assert max(map(len, model.pieces)) <= bpe.LONG and max(len(b"".join(x)) for x in model.windows) <= bpe.LONG
