"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermark.llm.common import WORD, checkpoint, running_total, words

#: Words of a block at most; a source has this many blocks or more, if it has the words.
BLOCK, BLOCKS = 2048, 2048
#: The schedule's points are i * STEP mod POINTS over POINTS, STEP / POINTS next to the golden ratio; POINTS is prime.
POINTS, STEP = 2147483647, 1327217884
#: Cells of [0, 1) by which points find their source.
CELLS = 4096


def targets(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row a source: sid (long), source, source_size and target (double).

    Sources stand in order of code points, null last, and take the weights in turn.
    They share the sum of all sizes by weight; none gets over cap times its size, and
    what it can't take is shared by the others by weight: the target is the smaller
    of cap times the size and a level times the weight, the level being the one at
    which all targets have the sum wanted. Works on the sources' rows only.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    rows = sums.withColumn("sid", F.row_number().over(order).cast("long")).withColumn("w", turn).withColumn("most", (F.col("source_size") * cap).cast("double"))
    full = Window.orderBy(F.col("most") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(full), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(full), F.lit(0.0))))
    # the first source, by its room for a weight, that the level leaves below its cap sets the level
    found = F.min(F.when(F.col("most") / F.col("w") >= F.col("level"), F.struct(F.col("most") / F.col("w"), "sid", "level"))).over(whole)
    return rows.withColumn("at", found["level"]).select("sid", "source", "source_size", F.least("most", F.coalesce(F.col("at") * F.col("w"), F.col("most"))).alias("target"))


def scheduled(sources: DataFrame, cap: int) -> DataFrame:
    """sid, block, times: how often the schedule takes each block of each source.

    sources: sid, source_size, target. A source's block has words / 2048 of its words,
    2048 at most and one at least. The sequence i * golden ratio mod 1 goes through the
    sources' cumulative shares of all slots; a source's slots, ranked, take its
    blocks in turn, none more than cap times.
    """
    sources = sources.where("source_size > 0").withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"source_size div {BLOCKS}"))))
    sources = sources.withColumn("slots", F.col("target") / F.col("block_words")).withColumn("blocks", F.expr("(source_size + block_words - 1) div block_words"))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = checkpoint(sources.withColumn("hi", F.sum("slots").over(upto) / F.sum("slots").over(whole)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0))))
    total = shares.agg(F.sum("slots")).first()[0] or 0
    spark = sources.sparkSession
    points = spark.range(round(total)).select(F.col("id").alias("slot"), ((F.col("id") % POINTS + 1) * STEP % POINTS / F.lit(float(POINTS))).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    cell = lambda x: F.least(F.lit(CELLS - 1), F.floor(F.col(x) * CELLS)).cast("int")
    spans = shares.where("hi > lo").select("sid", "lo", "hi", "blocks", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    slots = points.join(spans, "cell").where("u >= lo and u < hi").select("sid", "slot", "blocks", F.lit(1).cast("long").alias("one"))
    ranked = running_total(checkpoint(slots), "sid", "slot", "one", "rank")
    return ranked.where(F.col("rank") < cap * F.col("blocks")).groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))


def taken(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, key, size, source_size, target and taken for each row of docs.

    docs: doc_id, text, source; other columns do not matter. size: the text's words
    (null or empty: 0); taken: the words that the mix takes, repeats counted, at most
    cap times the size. A source's rows are put in the order of a hash of their
    doc_id and text, key, and its blocks are runs of words in that order, so a block
    may hold parts of texts. Repeated rows each have their own place, as they are
    alike it does not matter which. A null source is a source of its own. An empty
    table gives an empty one. The same rows give the same mix, however they are dealt.
    """
    size = F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long")
    key = F.xxhash64("doc_id", F.xxhash64("text")).bitwiseAND(F.lit((1 << 62) - 1))
    sized = checkpoint(docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size")))
    sources = checkpoint(targets(sized, weights, cap))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"source_size div {BLOCKS}"))).cast("long")
    named = checkpoint(sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "key", "size", "sid", "source_size", "target", block.alias("block_words")))
    columns = ["doc_id", "key", "size", "source_size", "target"]
    # repeats of a row share a key: they are placed together, then each by itself
    alike = named.where("size > 0").groupBy(*columns, "sid", "block_words").agg(F.count(F.lit(1)).alias("copies")).withColumn("all", F.col("size") * F.col("copies"))
    placed = running_total(alike, "sid", "key", "all", "base")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("at", F.col("base") + F.col("copy") * F.col("size"))
    parts = placed.select(*columns, "sid", "at", "block_words", F.explode(F.expr("sequence(at div block_words, (at + size - 1) div block_words)")).alias("block"))
    inside = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest("at", F.col("block") * F.col("block_words"))
    both = parts.withColumn("inside", inside).join(scheduled(sources, cap), ["sid", "block"], "left")
    got = both.groupBy(*columns, "sid", "at").agg(F.sum(F.col("inside") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = named.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return got.select(*columns, "taken").unionByName(none)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with what stands before and between them."""
    between = F.split(text, WORD)
    pairs = F.zip_with(F.slice(between, F.lit(1), n), F.slice(words(text), F.lit(1), n), lambda a, b: F.concat(a, b))
    return F.array_join(pairs, "")


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: docs' rows as often as the mix takes them, with docs' columns.

    What it takes of a text besides whole passes is a row with the text's first so
    many words, as a source's blocks are taken in order; n_chars, if there, follows.
    Rows without words are not taken.
    """
    key = F.xxhash64("doc_id", F.xxhash64("text")).bitwiseAND(F.lit((1 << 62) - 1))
    sums = taken(docs, weights, cap).where("taken > 0").groupBy("doc_id", "key", "size").agg(F.sum("taken").alias("taken"))
    sums = sums.select(F.struct("doc_id", "key").alias("_at"), F.struct("size", "taken").alias("_mix"))
    rows = docs.select(F.struct("doc_id", key.alias("key")).alias("_at"), F.struct("*").alias("_row")).dropDuplicates(["_at"])
    both = rows.join(sums, (rows["_at"]["doc_id"].eqNullSafe(sums["_at"]["doc_id"])) & (rows["_at"]["key"] == sums["_at"]["key"]))
    passes, rest = F.expr("_mix.taken div _mix.size"), F.expr("cast(_mix.taken % _mix.size as int)")
    copies = both.select("_row", rest.alias("_rest"), passes.alias("_passes"), F.explode(F.sequence(F.lit(1).cast("long"), passes + F.when(rest > 0, 1).otherwise(0))).alias("_copy"))
    text = F.when(F.col("_copy") <= F.col("_passes"), F.col("_row.text")).otherwise(first_words(F.col("_row.text"), F.col("_rest")))
    made = copies.withColumn("_text", text)
    other = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return made.select(*[other[x].alias(x) if x in other else F.col("_row")[x].alias(x) for x in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
