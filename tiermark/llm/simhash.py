"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import checkpoint, small_batches
from tiermark.llm.components import components

SEED = 42
#: A bucket with more fingerprints than this is not joined with itself, but linked by shared neighbours.
BUCKET = 48


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number.

    A-Z become lower case; a text of fewer words than width is one shingle, one
    without words has the fingerprint zero. A bit is set if over half the shingles'
    hashes have it.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = zip(*(found[i:] for i in range(width)), strict=False) if len(found) > width else [found]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in shingles], dtype=">u8")
    ones = sum(np.unpackbits(hashes[i : i + 4096].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), 4096))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits), a row for each row of docs."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x, width) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, fp long")


def _key(fp: Column, blocks: tuple[int, ...], cuts: list[int]) -> Column:
    """The bits of the blocks named, all others zero."""
    mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in blocks)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def near_links(fps: DataFrame, distance: int = 2, blocks: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links that connect all fingerprints at most distance bits apart.

    fps: columns fp and rep (long), each fp once. Returns a and b, values of rep.
    A fingerprint is cut into blocks; two of them that differ in at most distance
    bits share at least blocks - distance blocks, so fingerprints are joined on each
    choice of so many blocks and the pairs verified. In a bucket of more than
    `bucket` fingerprints pairs would grow with its square. Its fingerprints instead
    meet at what lies within distance / 2 bits of both (for an even distance): two
    are linked by way of the smallest rep at the same meeting point. All that meet
    there are within distance of each other, and any two that close do meet. So no
    link between components is lost, and none is added.
    """
    if distance % 2 or distance >= blocks:
        raise ValueError("distance must be even and smaller than blocks")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - distance))
    keyed = fps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("j"), _key(F.col("fp"), c, cuts).alias("key")) for i, c in enumerate(choices)])).alias("x")).select("fp", "rep", "x.j", "x.key")
    sizes = keyed.groupBy("j", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpoint(keyed.join(sizes, ["j", "key"]))
    some = shared.where(F.col("n") <= bucket)
    left, right = some.select("j", "key", F.col("fp").alias("fa"), F.col("rep").alias("a")), some.select("j", "key", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    pairs = left.join(right, ["j", "key"]).where((F.col("a") > F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance)).select("a", "b")
    crowded = shared.where(F.col("n") > bucket).select("fp", "rep").distinct()
    flips = [0, *(sum(1 << i for i in c) for k in range(1, distance // 2 + 1) for c in combinations(range(64), k))]
    meets = crowded.select("rep", F.explode(F.transform(F.array(*[F.lit(x - (1 << 64) if x >= 1 << 63 else x) for x in flips]), lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    # no more than len(flips) fingerprints can meet at one point
    met = meets.groupBy("at").agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1)
    stars = met.select(F.array_min("reps").alias("b"), F.explode("reps").alias("a")).where("a > b").select("a", "b")
    return pairs.union(stars).distinct()


def simhash_groups(docs: DataFrame, width: int = 5, distance: int = 2) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id of the near-duplicates.

    One row for each row of docs; other columns of docs do not matter. A null text
    counts as an empty one; all texts without words share the fingerprint zero and
    are linked like any other. Rows with a null doc_id get a fingerprint, and the
    smallest doc_id that is not null. An empty table gives an empty one.
    """
    each = checkpoint(fingerprints(docs, width))
    reps = each.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(near_links(reps.where("rep is not null"), distance))
    named = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs, width=3, distance=2).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")

