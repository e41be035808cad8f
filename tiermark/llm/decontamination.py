"""Benchmark decontamination by winnowing: fingerprints of word runs, joined and extended.

A window is `span` consecutive words of a benchmark item; an item of fewer words is one
window. Texts are winnowed: of each `span - k + 1` consecutive k-word runs the one with
the smallest hash (the last of ties) is kept, so every window that a document and an item
share holds a run that both keep, at the same place in it. Joining kept runs and extending
each match word by word therefore finds every shared window, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.llm.common import batches_of, checkpoint, table

#: Words of a window. Rows of the item side that are sent to all tasks at most, about 300 bytes each.
SPAN, BROADCAST = 10, 200_000
#: Bits of the filter for each fingerprint, and in all at most (16 MiB); past that it lets more through.
BITS, MOST = 128, 27
#: Bytes that are hashed at a time, so that the arrays of a long text stay small.
BLOCK = 1 << 20

#: Bytes of words: digits, letters, and all of characters beyond ASCII; capital letters become small ones.
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * BLOCK, base, np.uint64)]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a text: where they stand in its bytes, with capital letters small, and a hash of each."""

    _up = _down = None

    def __init__(self, text: str):
        if Words._up is None:
            odd = int(_ODD)
            Words._up, Words._down = _powers(odd), _powers(pow(odd, -1, 1 << 64))
        self.bytes = _SMALL[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        inside = np.zeros(len(self.bytes) + 2, bool)
        inside[1:-1] = _INSIDE[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            first = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.ends, first + BLOCK, "right")))
            self.hashes[at:upto] = self._hashed(at, upto)
            at = upto

    def __len__(self) -> int:
        return len(self.starts)

    def _hashed(self, a: int, b: int) -> np.ndarray:
        """Polynomial hashes of words a to b, from running sums over their bytes."""
        first, last = int(self.starts[a]), int(self.ends[b - 1])
        if last - first > 2 * BLOCK:  # one long word
            h = 0
            for x in range(first, last, BLOCK):
                part = self.bytes[x : min(last, x + BLOCK)].astype(np.uint64)
                h = (h * int(_ODD) & 0xFFFFFFFFFFFFFFFF) ^ int((part * Words._up[: len(part)]).sum(dtype=np.uint64))
            return _mixed(np.array([h], np.uint64))
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((self.bytes[first:last].astype(np.uint64) + np.uint64(1)) * Words._up[: last - first], out=sums[1:])
        s, e = self.starts[a:b] - first, self.ends[a:b] - first
        return _mixed((sums[e] - sums[s]) * Words._down[s])

    def kept(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the runs that winnowing for windows of span words keeps."""
        k = (span + 1) // 2
        n, wide = len(self) - k + 1, span - k + 1
        if n < wide:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        run = np.full(n, span, np.uint64)
        for j in range(k):
            run = run * _ODD + self.hashes[j : j + n]
        run = _mixed(run)
        least, at = run[: n - wide + 1].copy(), np.arange(n - wide + 1)
        for j in range(1, wide):
            nearer = run[j : j + len(least)] <= least
            least[nearer] = run[j : j + len(least)][nearer]
            at[nearer] = np.flatnonzero(nearer) + j
        at = np.unique(at)
        return run[at], at

    def said(self, a: int, b: int) -> list[str]:
        return [self.bytes[s:e].tobytes().decode("utf-8", "surrogatepass") for s, e in zip(self.starts[max(a, 0) : max(b, 0)], self.ends[max(a, 0) : max(b, 0)], strict=True)]

    def around(self, span: int, h: np.uint64, at: int) -> dict:
        """A kept run with the words beside it that a window with it can hold, nearest first."""
        k = (span + 1) // 2
        return {"span": span, "hash": int(h.astype(np.int64)), "place": int(at), "run": " ".join(self.said(at, at + k)), "before": self.said(at - (span - k), at)[::-1], "after": self.said(at + k, at + span)}


_FOUND = pa.list_(pa.struct([("span", pa.int32()), ("hash", pa.int64()), ("place", pa.int64()), ("run", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))
_FOUND_SQL = "array<struct<span:int,hash:long,place:long,run:string,before:array<string>,after:array<string>>>"


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter of 2^size bits that stand for a hash."""
    return h >> np.uint64(64 - size), (h * _ODD) >> np.uint64(64 - size)


def _item_runs(items: DataFrame, span: int) -> DataFrame:
    """item_id and the kept runs of each item: a row a run."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                w = Words(text or "")
                own = min(span, len(w))
                found.append([w.around(own, h, at) for h, at in zip(*w.kept(own), strict=True)] if own else [])
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, _FOUND)], ["item_id", "found"])

    plain = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(of, f"item_id string, found {_FOUND_SQL}").select("item_id", F.explode("found").alias("_x")).select("item_id", "_x.*")


def _filter(runs: DataFrame, count: int) -> tuple[int, bytes]:
    """A filter of the item side's hashes: its size as a power of two, and its bits. At most 2^MOST bits reach the driver."""
    size = min(MOST, max(10, (count * BITS - 1).bit_length()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column("hash").to_numpy(zero_copy_only=False).astype(np.uint64), size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "bits"])

    words = runs.select("hash").distinct().mapInArrow(of, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(1 << (size - 6), np.int64)
    whole[words["word"].to_numpy()] = words["bits"].to_numpy()
    return size, whole.tobytes()


def _document_runs(docs: DataFrame, spans: list[int], size: int, bits: bytes) -> DataFrame:
    """row, doc_id, n_words and found: the kept runs whose hashes the filter may hold."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, row = np.frombuffer(sent.value, np.uint64), TaskContext.get().partitionId() << 33
        held = lambda at: (whole[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        for batch in batches:
            n, found = [], []
            for text in batch.column("text").to_pylist():
                w = Words(text or "")
                n.append(len(w))
                here = []
                for span in spans:
                    h, at = w.kept(span)
                    one, two = _bits(h, size)
                    some = np.flatnonzero(held(one) & held(two))
                    here += [w.around(span, h[i], at[i]) for i in some]
                found.append(here)
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, _FOUND)], ["row", "doc_id", "n_words", "found"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(of, f"row long, doc_id long, n_words long, found {_FOUND_SQL}")


def _alike(a: Column, b: Column) -> Column:
    """How many leading elements two arrays have in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, broadcast_rows: int = BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted) and spans, a row for each row of docs.

    docs: doc_id, text; items: item_id, text; other columns do not matter. spans: start
    and end (word numbers, end exclusive) of the words inside windows. Null and empty
    texts, and those without words, have none and hit nothing. Rows of one doc_id count
    by themselves; rows of one item_id are one item; an item whose item_id is null hits
    words, but is not counted or listed. Without items nothing is hit.

    Documents are read once. A filter of the items' hashes (bounded in size, not in what
    it lets pass) keeps their other runs from leaving the task; those that pass are joined
    with the items' runs and extended. Equal surroundings of a run are one row on the item
    side however many items have them, so a passage that many documents and many items
    share is no product. That side is sent to all tasks while it has broadcast_rows rows at
    most, and else joined by a shuffle, in which Spark splits hashes that many documents have.
    """
    spark = docs.sparkSession
    around = ["span", "hash", "run", "before", "after"]
    with batches_of(spark, 64):
        runs = checkpoint(_item_runs(items, span))
        known = checkpoint(runs.select(*around).distinct().select(*around, F.sha2(F.to_json(F.struct(*around)), 256).alias("around")))
        # with no rows there are no spans, and documents are only counted
        spans = sorted(r["span"] for r in known.select("span").distinct().collect())
        count, total = known.count(), runs.count()
        size, bits = _filter(known, count)
        read = checkpoint(_document_runs(docs, spans, size, bits))

    few = count <= broadcast_rows
    send = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    b = known.select(*[F.col(c).alias(f"_{c}") for c in around], "around")
    a = read.where(F.size("found") > 0).select("row", F.explode("found").alias("_x")).select("row", "_x.*")
    met = a.join(send(b), (F.col("hash") == F.col("_hash")) & (F.col("span") == F.col("_span")) & (F.col("run") == F.col("_run")))
    left, right = _alike(F.col("before"), F.col("_before")), _alike(F.col("after"), F.col("_after"))
    k = ((F.col("span") + 1) / 2).cast("int")
    hits = met.select("row", "around", "place", "span", (F.col("place") - left).alias("start"), (F.col("place") + k + right).alias("end")).where("end - start >= span")
    hits = checkpoint(hits.select("row", "around", "place", "start", "end"))

    # runs at one place all hold its words, so their union has no gap
    places = hits.groupBy("row", "place").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    before = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")
    parts = places.withColumn("_new", new).withColumn("_run", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("row", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    words = merged.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    of_items = runs.join(send(known.select(*[F.col(c).alias(f"_{c}") for c in around], "around")), [F.col(c) == F.col(f"_{c}") for c in around]).where("item_id is not null").select("around", "item_id").distinct()
    listed = hits.select("row", "around").distinct().join(F.broadcast(of_items) if total <= broadcast_rows else of_items, "around").select("row", "item_id").distinct()
    listed = listed.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))

    hit = read.where(F.size("found") > 0).select("row", "doc_id", "n_words").join(words, "row", "left").join(listed, "row", "left")
    none = F.lit(None)
    clean = read.where(F.size("found") == 0).select("doc_id", "n_words", none.cast("long").alias("n_hit"), none.cast("array<string>").alias("items"), none.cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    every = clean.unionByName(hit.select("doc_id", "n_words", "n_hit", "items", "spans"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    spans_of = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return every.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), spans_of.alias("spans"))


def op12(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lengths as (select distinct n from windows),
places as (
  select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n)),
hits as (select p.rid, p.i, p.n, x.item_id from places p join windows x on p.gram = x.gram and p.n = x.n),
words as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + n)) as k from (select distinct rid, i, n from hits)) group by rid),
items as (select rid, count(*) as n_items, string_agg(s, ',' order by s) as listed from (select distinct rid, item_id::varchar as s from hits where item_id is not null) group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(words.n_hit, 0)::bigint as n_hit, coalesce(items.n_items, 0)::bigint as n_items,
       sha256(coalesce(items.listed, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words using (rid) left join items using (rid)
"""
