"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiermark.llm.common import small_batches, use_checkpoints

#: Words whose ids a worker remembers, and the longest of them in characters: what it holds is bounded.
KEEP, LONG = 1_000_000, 64
#: Words that are encoded in one call, and the character from which on a word is encoded by itself.
TOGETHER, PLAIN = 128, "\u0250"
#: What parts from the letters before it at a word's end: neither letters nor digits, and no apostrophe.
TAIL = ".,;:!?%$#*&|<>()\"-"
#: Bytes of an ORC stripe, rows between two entries of its row index, and bytes of text for a file, about.
STRIPE, STRIDE, FILE = 32 << 20, 1000, 128 << 20


class Words:
    """Ids of whole texts by the tokenizers library, which sees each different word once.

    Only the space and the line feed part words here. The tokenizer drops white space,
    none of its patterns or characters reaches across it, so a text's ids are those
    of its words in a row. A batch's words are told apart by Arrow, so that only its
    different ones are looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        #: The same merges for small Latin-1 letters alone, which its other steps leave as they are.
        self.letters = Tokenizer(self.model.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        #: Whether a token ends a run of letters.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _learn_letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of small Latin-1 letters, many encoded at a time; they end where a token does that ends a run of letters."""
        found: dict[str, bytes] = {}
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, made in zip(groups, self.letters.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, dtype="<u4")
            raw, at = ids.tobytes(), 0
            for w, x in zip(group, (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                found[w] = raw[at:x]
                at = x
        return found

    def _learn_others(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of any characters; their tokens find them by their places."""
        found: dict[str, bytes] = {}
        plain = [w for w in words if len(w) <= LONG and (w.isascii() or max(w) < PLAIN)]
        alone = [[w] for w in words if len(w) > LONG or not w.isascii() and max(w) >= PLAIN]
        groups = [*[plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)], *alone]
        for group, made in zip(groups, self.model.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, dtype="<u4")
            if len(group) == 1:
                upto = [len(ids)]
            else:
                starts = np.cumsum([0, *(len(w) + 1 for w in group[:-1])])
                upto = np.searchsorted([s for s, _ in made.offsets], [*starts[1:], 1 << 60]).tolist()
            raw, at = ids.tobytes(), 0
            for w, x in zip(group, upto, strict=True):
                found[w] = raw[at : 4 * x]
                at = 4 * x
        return found

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words, and of the stems that they share.

        Latin-1 letters before a tail have the ids of the same small letters, then come
        the tail's; all others are encoded as they are.
        """
        whole, stems, tails, others = [], [], [], []
        for w in words:
            stem = w.rstrip(TAIL)
            # a letter beyond Latin-1 may become a letter and a mark when it is made small
            if stem.isalpha() and len(w) <= LONG and (stem.isascii() or max(stem) < "\u0100"):
                whole.append(w)
                stems.append(stem.lower())
                tails.append(w[len(stem) :])
            else:
                others.append(w)
        known = self.known
        new = set(stems).difference(known)
        found = self._learn_others(list(set(tails).difference(known).union(others)))
        found.update(self._learn_letters(list(new)))
        of = lambda some: [known[x] if x in known else found[x] for x in some]
        found.update(zip(whole, map(bytes.__add__, of(stems), of(tails)), strict=True))
        return found

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each of some different words, 4 little-endian bytes each."""
        found = list(map(self.known.get, words))
        made = self.learn([w for w, x in zip(words, found, strict=True) if x is None])
        if len(self.known) + len(made) > KEEP:
            self.known = {"": b""}
        self.known.update(made if max(map(len, made), default=0) <= LONG else {w: x for w, x in made.items() if len(w) <= LONG})
        return [made[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def encode_column(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, end after each, and how many each has."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = cut.values.dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids.append(np.array(end, dtype="<u4").tobytes())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        last = cut.offsets.to_numpy()[1:]
        word = np.insert(coded.indices.to_numpy(), last, len(ids) - 1)
        n = sizes[word]
        upto = np.cumsum(n)
        # each word's first id, less the place that it goes to; in a row, ids are one place apart in both
        from_ = np.repeat((np.cumsum(sizes) - sizes)[word] - (upto - n), n)
        from_ += np.arange(len(from_))
        return np.frombuffer(b"".join(ids), "<u4")[from_], np.diff(upto[last + np.arange(len(last))], prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 little-endian bytes each."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()), [])
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


@lru_cache(maxsize=2)
def _loaded(path: str) -> Words:
    return Words(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes docs' token ids to ORC files at path, in ascending doc_id order.

    docs: doc_id, text; other columns do not matter. A file holds a range of ids: rows
    of shard (the file's number), place (the row's in the file), doc_id, n_tokens and
    ids, which end with end_id. Rows of equal doc_id stand in the order of a hash of
    their texts, and repeats of one row may lie in several files; a null doc_id comes
    first; a null or empty text has end_id alone. Texts are dealt by range once, a file
    for about FILE bytes, then encoded in order, whole. Stripes can be read
    side by side; their statistics, row indexes and Bloom filters skip what a
    condition on doc_id excludes.
    """
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place, shard = _loaded(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, sizes = model.encode_column(batch.column("text"), [end_id])
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), pa.array(ids.view("<i4")))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(place, place + n)), batch.column("doc_id"), pa.array(sizes), values], ["shard", "place", "doc_id", "n_tokens", "ids"])
            place += n

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE))
    # repeats of one row are alike in all but where they were read
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id() % 1024]
    dealt = plain.select("doc_id", "text", *[c.alias(f"_{k}") for k, c in enumerate(order[1:])]).repartitionByRange(files, "doc_id", "_0", "_1").sortWithinPartitions("doc_id", "_0", "_1").select("doc_id", "text")
    made = dealt.mapInArrow(of, "shard int, place long, doc_id long, n_tokens long, ids array<int>")
    options = {"orc.create.index": "true", "orc.row.index.stride": STRIDE, "orc.stripe.size": STRIPE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    made.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, place long, doc_id long, n_tokens long, ids array<int>").orc(path)


def token_index(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each row of token files.

    start: the ids of all rows before it, in the files' order. Rows are summed within
    their file, and files by their totals, of which there are as many as files.
    """
    small_batches(files.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
            n = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), batch.column("doc_id"), n, pa.array(crc, pa.int64())], ["shard", "place", "doc_id", "n_tokens", "ids_crc32"])

    each = files.select("shard", "place", "doc_id", "ids").mapInArrow(of, "shard int, place long, doc_id long, n_tokens long, ids_crc32 long")
    before = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    bases = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    run = each.withColumn("_run", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return run.join(bases, run["shard"] == bases["_shard"]).select("doc_id", (F.col("_base") + F.col("_run")).alias("start"), "n_tokens", "ids_crc32")


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4()}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_index(read_tokens(spark, path))
