"""Byte-level BPE by monoid tree reduction, and its inverse."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import small_batches

#: Pieces that a worker remembers, windows likewise, and the bytes of the longest of either: what it holds is bounded.
KEEP, WINDOWS, LONG = 1_000_000, 800_000, 48
#: Tokens that are decoded together, as a leaf of the tree.
LEAF = 1024


class TreeBPE:
    """Encodes bytes by ranks: the lowest-ranked pair is merged first, the leftmost of equals.

    A sequence of tokens is the encoding of its bytes if and only if every two
    neighbours are the encoding of their own bytes: merges inside tokens run in the
    same order either way, and the first merge across a border would also be made
    between the two neighbours alone. So encodings of two halves are joined by
    re-encoding a window about the border, grown until its first and last token
    agree with the neighbours outside; all other neighbours have agreed before.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.pieces: dict[bytes, bytes] = {}
        self.windows: dict[tuple[bytes, ...], tuple[bytes, ...]] = {}

    def merged(self, parts: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of a window, merge by merge, from single bytes."""
        found = self.windows.get(parts)
        if found is not None:
            return found
        whole, ranks = b"".join(parts), self.ranks
        if len(whole) > LONG:
            return self.heaped(whole)
        now = [whole[i : i + 1] for i in range(len(whole))]
        while len(now) > 1:
            rank, i = min((ranks.get(now[i] + now[i + 1], 1 << 62), i) for i in range(len(now) - 1))
            if rank == 1 << 62:
                break
            now[i : i + 2] = [now[i] + now[i + 1]]
        if len(self.windows) >= WINDOWS:
            self.windows.clear()
        found = self.windows[parts] = tuple(now)
        return found

    def heaped(self, whole: bytes) -> tuple[bytes, ...]:
        """The same for a long window: pairs wait in a heap, so that time grows with n log n."""
        n, ranks = len(whole), self.ranks
        end = list(range(1, n + 1))  # where the part that begins here ends, 0 if none does any more
        back = list(range(-1, n - 1))  # where the part before begins
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(whole[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, upto = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != upto:
                continue  # one of the two has been merged since
            end[i], end[j] = upto, 0
            if upto < n:
                back[upto] = i
                if (r := ranks.get(whole[i : end[upto]])) is not None:
                    heappush(heap, (r, i, end[upto]))
            if i and (r := ranks.get(whole[back[i] : upto])) is not None:
                heappush(heap, (r, back[i], upto))
        found, i = [], 0
        while i < n:
            found.append(whole[i : end[i]])
            i = end[i]
        return tuple(found)

    def joined(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The monoid's operation: the encoding of two encodings' bytes."""
        i, j = len(left) - 1, 1
        while True:
            window = self.merged(left[i:] + right[:j])
            if i and self.merged((left[i - 1], window[0])) != (left[i - 1], window[0]):
                i = max(0, i - max(1, len(left) - i))
            elif j < len(right) and self.merged((window[-1], right[j])) != (window[-1], right[j]):
                j = min(len(right), 2 * j)
            else:
                return left[:i] + window + right[j:]

    def tree(self, piece: bytes) -> tuple[bytes, ...]:
        """The piece's tokens: halves first, then their join."""
        if len(piece) == 1:
            return (piece,)
        half = len(piece) // 2
        return self.joined(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern, 4 little-endian bytes each."""
        raw = text.encode("utf-8", "surrogatepass")
        tokens = (raw,) if raw in self.ranks else self.tree(raw)
        made = np.array([self.ranks[x] for x in tokens], dtype="<u4").tobytes()
        if len(raw) <= LONG:
            if len(self.pieces) >= KEEP:
                self.pieces.clear()
            self.pieces[text] = made
        return made

    def encode(self, pieces: list[str]) -> bytes:
        get, make = self.pieces.get, self.piece
        return b"".join([get(x) or make(x) for x in pieces])

    def decode(self, ids: bytes) -> bytes:
        """Concatenation up the tree: leaves of a few tokens, then neighbours two by two."""
        tokens = np.frombuffer(ids, dtype="<u4").tolist()
        now = [b"".join(map(self.bytes.__getitem__, tokens[i : i + LEAF])) for i in range(0, len(tokens), LEAF)]
        while len(now) > 1:
            now = [b"".join(now[i : i + 2]) for i in range(0, len(now), 2)]
        return now[0] if now else b""


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> tuple[TreeBPE, regex.Pattern]:
    return TreeBPE(path), regex.compile(pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary).

    path: the vocabulary's file, on every executor; pattern: what a text is cut into
    before it is encoded, each match by itself. A null text counts as an empty one,
    which has no ids. One row for each row of docs, repeated ones too; other columns
    of docs do not matter. Texts are encoded whole.
    """
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cut = _loaded(path, pattern)
        for batch in batches:
            ids = [model.encode(cut.findall(x)) if x else b"" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs."""
    made = encoded(docs, path, pattern)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
