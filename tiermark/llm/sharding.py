"""Sharding by extendible hashing: only shards over the byte limit split on another bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import checkpoint

#: Bits of a key that a directory can use, and bits by which one round may deepen it.
BITS, ROUND = 62, 8
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Bytes of a shard in the query: small, so that a table of some megabytes has dozens.
LIMIT = 128 << 10
#: Shards whose directory is sent to all tasks, at most; beyond it, rows and shards are joined.
SENT = 100_000


def _prefix(key: Column, bits: Column, depth: Column) -> Column:
    """Of a number of so many bits, the first depth ones."""
    return F.call_function("shiftright", key, (bits - depth).cast("int"))


def directory(keyed: DataFrame, limit: int) -> DataFrame:
    """The leaves: depth, prefix, shard_bytes and shard_rows of each shard.

    keyed: key (long of 62 bits) and bytes. A shard begins as the bucket of all keys
    and splits on the next bit while it holds more than limit bytes and more than one
    key. Each round sums the open buckets' bytes, within tasks first, by up to ROUND
    more bits: as many sums as open buckets times 2 to the ROUND at most. Buckets that
    fit close at the least depth at which they do; the others go on.
    """
    rows, done, depth = keyed.select("key", "bytes"), None, 0
    while True:
        to = min(BITS, depth + ROUND)
        at = _prefix(F.col("key"), F.lit(BITS), F.lit(to))
        fine = checkpoint(rows.groupBy(at.alias("at")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most")))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(to)))).withColumn("prefix", _prefix(F.col("at"), F.lit(to), F.col("depth")))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("least").alias("a"), F.max("most").alias("b"))
        fit = sums.where((F.col("shard_bytes") <= limit) | (F.col("a") == F.col("b"))).drop("a", "b")
        found = levels.select("at", "depth", "prefix").join(fit, ["depth", "prefix"], "left")
        leaf = F.min(F.when(F.col("shard_rows").isNotNull(), F.struct("depth", "prefix", "shard_bytes", "shard_rows")))
        first = checkpoint(found.groupBy("at").agg(leaf.alias("leaf")))
        leaves = first.where("leaf is not null").select("leaf.*").distinct()
        done = leaves if done is None else done.unionByName(leaves)
        full = first.where("leaf is null").select(F.col("at").alias("_at"))
        if to == BITS or full.isEmpty():
            return done
        rows, depth = checkpoint(rows.join(full, at == F.col("_at"), "left_semi")), to + 1


def sharded(docs: DataFrame, limit: int) -> DataFrame:
    """For each row of docs: row (its columns, as a struct), bytes, depth, prefix, shard_bytes, shard_rows.

    docs: doc_id, text and any others. A row's key is a hash of its doc_id and text,
    its bytes those of the text and 16 more. Shards are leaves of the directory: the
    first depth bits of the key are the prefix. Every shard holds limit bytes at most,
    but for rows of one key alone: a single row over the limit, or repeats of one row.
    A null or empty text has 16 bytes. An empty table gives an empty one. The same rows
    get the same shards in each run, however they are dealt.
    """
    key = F.xxhash64("doc_id", F.xxhash64("text")).bitwiseAND(F.lit((1 << BITS) - 1))
    size = (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + ROW_BYTES).cast("long")
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), size.alias("bytes"))
    leaves = checkpoint(directory(checkpoint(rows.select("key", "bytes")), limit))
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # 62 at most
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), _prefix(F.col("key"), F.lit(BITS), F.lit(d)).alias("p")) for d in sorted(depths)])) if depths else F.explode(F.array(F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("p"))))
    few = leaves.limit(SENT + 1).count() <= SENT
    placed = rows.withColumn("at", at)
    shards = F.broadcast(leaves) if few else leaves
    return placed.join(shards, (F.col("at.d") == F.col("depth")) & (F.col("at.p") == F.col("prefix"))).select("row", "bytes", "depth", "prefix", "shard_bytes", "shard_rows")


def bits(prefix: Column, depth: Column) -> Column:
    """A shard's prefix as binary digits; empty for the one shard of depth 0."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """Writes docs as Parquet, a folder for each shard; columns are those of docs."""
    made = sharded(docs, limit).select("row.*", F.concat(F.lit("s"), bits(F.col("prefix"), F.col("depth"))).alias("_shard"))
    made.repartition("_shard").write.partitionBy("_shard").parquet(path)


def op9(spark, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = sharded(docs, limit)
    return made.select("row.doc_id", "bytes", bits(F.col("prefix"), F.col("depth")).alias("shard"), F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_rows")
