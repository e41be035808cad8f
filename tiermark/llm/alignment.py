"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes; where a token of each ends at one place, groups of
tokens are cut. As long as tokens are one to one, the ends of both stand at the same shift
of their indexes: blocks of ends are compared whole at that shift, doubling while they are
equal and halving to the first that differs. The irregular group there is resolved token
by token, which gives the next shift.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import batches_of, kept, table

#: Id pairs whose counts are sent to all tasks at most (24 bytes each); the others meet theirs by a join.
FREQUENT = 1_000_000
#: Characters of a piece without a break from which on the library with a heap encodes its text.
UNBROKEN = 500


def byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Ids and bytes of a byte-level BPE given as a tokenizers file.

    Texts go through tiktoken with the file's vocabulary, whose ids are the ranks of its
    merges, so both libraries give the same ids; it merges long pieces in quadratic time,
    so texts with one go through the tokenizers library.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        special = {t["content"] for t in known["added_tokens"]}
        back = byte_of()
        ranks = {bytes(back[c] for c in t): i for t, i in known["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.heap = Tokenizer.from_file(path)
        self.heap.encode_special_tokens = True
        self.bytes = [b""] * (max(known["model"]["vocab"].values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b

    def encode(self, text: str) -> list[int]:
        words = text.split()
        longest = max(map(len, words), default=0)
        spaces = len(text) - sum(map(len, words)) - len(words)
        if longest < UNBROKEN and spaces < UNBROKEN:
            return self.fast.encode_ordinary(text)
        return self.heap.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and bytes of a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=2)
def _loaded(a_path: str, b_path: str, pattern: str):
    a, b = ByteLevel(a_path, pattern), Pieces(b_path)
    said = [[str(i) for i in range(len(x.bytes))] for x in (a, b)]
    sizes = [[len(t) for t in x.bytes] for x in (a, b)]
    return a, b, *said, *sizes


def runs(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Groups of tokens that end together, from the ends of two tokenizations of the same bytes.

    Yields from and to in a, then in b; as many of both: each token is a group of its own,
    else all are one group.
    """
    i = j = 0
    n = len(a)
    while i < n:
        size, start = 1, i
        while a[i : i + size] == b[j : j + size] and i < n:
            i, j, size = i + size, j + size, 2 * size
        if i >= n:
            i, j = n, len(b)
            yield start, n, j - (n - start), j
            return
        size //= 2
        while size:  # all before i are equal, and one of the next 2 * size differs
            if a[i : i + size] == b[j : j + size]:
                i, j = i + size, j + size
            size //= 2
        if i > start:
            yield start, i, j - (i - start), j
        x, y, p, q = a[i], b[j], i, j
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        yield p, i, q, j


def aligned(a: list[int], b: list[int], a_ends: list[int], b_ends: list[int], a_said: list[str], b_said: list[str]) -> tuple[int, str, list[int], list[int]]:
    """Number of groups, the groups as text, and the ids of overlapping tokens side by side."""
    n, said, left, right = 0, [], [], []
    for p, i, q, j in runs(a_ends, b_ends):
        x, y = a[p:i], b[q:j]
        if i - p == j - q and (i - p == 1 or a_ends[p] == b_ends[q]):
            n += i - p
            said += [f"{a_said[s]}|{b_said[t]}" for s, t in zip(x, y, strict=True)]
            left += x
            right += y
            continue
        n += 1
        said.append(f"{','.join([a_said[s] for s in x])}|{','.join([b_said[t] for t in y])}")
        while p < i:  # no two of them end together before the last
            left.append(a[p])
            right.append(b[q])
            s, t = a_ends[p], b_ends[q]
            p, q = p + (s <= t), q + (t <= s)
    return n, ";".join(said), left, right


def _read(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Each document's alignment, with its different id pairs (as a * size of B's vocabulary + b) and how often it has each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_model, b_model, a_said, b_said, a_sizes, b_sizes = _loaded(a_path, b_path, pattern)
        wide, row = len(b_sizes), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = (0, 0, 0, 0, "", (), ())
                if text:
                    whole = (" " + text).encode("utf-8", "surrogatepass")
                    a, b = a_model.encode(" " + text), b_model.encode(text)
                    if b"".join([a_model.bytes[i] for i in a]) == whole == b"".join([b_model.bytes[i] for i in b]):
                        ends = [list(accumulate([s[i] for i in x], add)) for x, s in ((a, a_sizes), (b, b_sizes))]
                        n, said, left, right = aligned(a, b, *ends, a_said, b_said)
                        pairs, times = np.unique(np.array(left, np.int64) * wide + np.array(right, np.int64), return_counts=True)
                        found = (len(a), len(b), n, len(left), hashlib.sha256(said.encode()).hexdigest(), pairs, times)
                rows.append((row, doc_id, *found))
                row += 1
            columns = list(zip(*rows, strict=True))
            nested = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, kind), *c]).astype(kind))) for c, kind in ((columns[7], np.int64), (columns[8], np.int32))]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.string()), *nested], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(of, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def _frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The count from which on pairs are sent to all tasks, a power of two, and those pairs sorted: `most` at most."""
    by_power = counts.groupBy(F.floor(F.log2("count")).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # 63 rows at most
    least, total = 1 << 62, 0
    for r in sorted(by_power, reverse=True):
        total += r["n"]
        if total > most:
            break
        least = 1 << r["p"]
    sent = counts.where(F.col("count") >= least).select("pair", "count", "best").toArrow()
    pairs = sent["pair"].to_numpy()
    order = np.argsort(pairs)
    return least, pairs[order], sent["count"].to_numpy()[order], sent["best"].to_numpy()[order]


def alignments(docs: DataFrame, a_path: str, b_path: str, pattern: str, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Each document's alignment of a byte-level and a sentencepiece tokenization, and the counts of id pairs.

    docs: doc_id, text; other columns do not matter. The first frame has a row for each
    row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    The second has a, b, count (rows of docs that hold the pair linked) and best (no pair
    of the a has more). Texts that are null or empty, or that a tokenizer does not give
    back byte by byte, have no tokens: zeros and an empty groups_sha256. Equal rows count
    one each; an empty table gives none.

    Texts are encoded once; ids of pairs are kept in a table below the checkpoint folder.
    Counts are summed within tasks first. The most frequent pairs, up to a bounded number,
    are sent to all tasks, so that no pair that many documents hold is a key of a join;
    the others are joined.
    """
    spark = docs.sparkSession
    with batches_of(spark, 64):
        read = kept(_read(docs, a_path, b_path, pattern), "alignment")
    wide = len(_loaded(a_path, b_path, pattern)[5])
    seen = read.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = kept(seen, "pairs")
    top = counts.groupBy(F.expr(f"pair div {wide}").alias("_a")).agg(F.max("count").alias("_top"))  # a row for each id of A at most
    counts = counts.join(F.broadcast(top), F.expr(f"pair div {wide}") == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))
    least, *table_ = _frequent(counts, frequent)
    sent = spark.sparkContext.broadcast(table_)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = sent.value
        for batch in batches:
            n, flat, times = batch.num_rows, batch.column("pairs"), batch.column("times")
            at = flat.offsets.to_numpy()
            ids, often = flat.flatten().to_numpy(), times.flatten().to_numpy()
            at = at - at[0]
            of_row = np.repeat(np.arange(n), np.diff(at))
            place = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
            held = known[place] == ids if len(known) else np.zeros(len(ids), bool)
            p, w, r = place[held], often[held].astype(np.int64), of_row[held]
            counted, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if len(p):
                np.add.at(counted, r, count[p] * w)
                np.add.at(bests, r, best[p] * w)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of_row[~held], minlength=n))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[~held])) for x in (ids, often)]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(bests), pa.array(counted), *rest], [*names, "n_best", "count_sum", "pairs", "times"])

    with batches_of(spark, 500):
        met = kept(read.mapInArrow(of, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<int>"), "met")
    rest = met.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_x")).select("row", F.col("_x.pairs").alias("pair"), F.col("_x.times").alias("_times"))
    rare = rest.join(counts.where(F.col("count") < least), "pair")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("_best"), F.sum(F.col("count") * F.col("_times")).alias("_sum"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    done = met.where(F.size("pairs") == 0).select(*columns)
    open_ = met.where(F.size("pairs") > 0).join(more, "row").withColumns({"n_best": F.col("n_best") + F.col("_best"), "count_sum": F.col("count_sum") + F.col("_sum")})
    return done.unionByName(open_.select(*columns)), counts.select(F.expr(f"pair div {wide}").alias("a"), (F.col("pair") % wide).alias("b"), "count", "best")


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignments(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)[0]
