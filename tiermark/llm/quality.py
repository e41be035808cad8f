"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import SPACE, kept, words

#: Buckets of the n-grams' hashes (a power of two).
BUCKETS = 1 << 16
#: Share of trusted documents that the threshold keeps.
RECALL = 0.998
#: Weights are whole millionths, so that sums do not depend on their order.
SCALE = 1_000_000
#: Whole scores of a bin, when the threshold is sought.
BIN = 4096
WINDOW = 8


def _pairs(hashes: Column, step: int, combine) -> Column:
    """combine(x[i], x[i + step]) for all i that have both."""
    most = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), most), F.slice(hashes, F.lit(step + 1), most), combine)


def hashed(docs: DataFrame) -> DataFrame:
    """Adds _words, _one and _two: hashes of each word and of each two neighbours."""
    both = lambda a, b: F.xxhash64(a, b)
    return docs.withColumn("_words", words(F.col("_text"))).withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_two", _pairs(F.col("_one"), 1, both))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all documents of good quality that are not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()


def weights(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Each bucket's log ratio of its shares among the n-grams of trusted documents and of all, in millionths.

    docs: _id, _text. Sums every document's n-grams of one and two words by bucket
    within each task before the shuffle; what comes back is BUCKETS rows. The ids may be
    too many to be broadcast: texts are shuffled to them, once, and need no sort. Rows
    without an id meet none.
    """
    named = docs.where("_id is not null").join(trusted.hint("shuffle_hash"), F.col("_id") == F.col("_trusted"), "left")
    grams = hashed(named.unionByName(docs.where("_id is null"), allowMissingColumns=True))
    grams = grams.select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(F.concat("_one", "_two")).alias("h"))
    rows = grams.groupBy(_bucket(F.col("h")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect()
    found = {r["k"]: (r["n"], r["t"]) for r in rows}
    n, t = (sum(x[i] for x in found.values()) + BUCKETS for i in (0, 1))
    one = lambda a, b: round(SCALE * (math.log((b + 1) / t) - math.log((a + 1) / n)))
    return [one(*found.get(k, (0, 0))) for k in range(BUCKETS)]


def _score(one: Column, two: Column, table: list[int]) -> Column:
    """The mean weight of a document's n-grams, given their hashes; null if it has none."""
    w = F.from_json(F.lit(json.dumps(table)), "array<int>")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, h: a + F.get(w, _bucket(h)))
    n = F.size(one) + F.size(two)
    return F.when(n > 0, (total(one) + total(two)) / (n * F.lit(float(SCALE))))


def threshold(scores: DataFrame, trusted: DataFrame, recall: float = RECALL) -> int | None:
    """The largest whole score that `recall` of the trusted documents reach; none if no trusted one has a score.

    scores: _id, _whole. Found exactly, from counts by bins of scores and then by the
    scores of one bin, as weights bound the scores, and so the bins that come back.
    """
    known = scores.where("_whole is not null").join(trusted, F.col("_id") == F.col("_trusted"), "left_semi")
    n = lambda df, key: sorted(map(tuple, df.groupBy(key.alias("k")).count().collect()))
    bins = n(known, F.floor(F.col("_whole") / BIN))
    total = sum(c for _, c in bins)
    below = total - math.ceil(recall * total)
    for at, count in bins:
        if below < count:
            break
        below -= count
    else:
        return None
    for whole, count in n(known.where(F.col("_whole").between(at * BIN, at * BIN + BIN - 1)), F.col("_whole")):
        if below < count:
            return whole
        below -= count


def _repeats(two: Column) -> Column:
    """Words in 8-word windows of which there is another, from the hashes of all two neighbours.

    A window that is found twice holds 4-word runs that are; without those, nothing
    more is computed.
    """
    both = lambda a, b: F.xxhash64(a, b)
    fewer = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    none = F.lit(0).cast("long")
    eight = lambda four: let(_pairs(four, 4, both), lambda h: F.when(fewer(h), _covered(h)).otherwise(none))
    return let(_pairs(two, 2, both), lambda four: F.when(fewer(four), eight(four)).otherwise(none))


def _covered(windows: Column) -> Column:
    """The number of words in windows of which there is another; windows are in order of place."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = _pairs(placed, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    steps = _pairs(at, 1, lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda a, x: a + x)


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it and wherever Spark moves the expression."""
    return F.transform(F.array(value), f)[0]


def _measures(text: Column, table: list[int]) -> Column:
    """A struct of the counts and the score."""
    both = lambda a, b: F.xxhash64(a, b)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))

    def counts(w: Column, one: Column, two: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeats(two).alias("n_repeat_words"),
            _score(one, two, table).alias("score"),
        )

    return let(words(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda one: let(_pairs(one, 1, both), lambda two: counts(w, one, two))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, labels: DataFrame, columns: Sequence[str] = ("*",)) -> DataFrame:
    """For each row of docs: row (its columns, or those named, as a struct), the counts, base_failed, score and kept.

    docs: doc_id, text, and any other columns; columns must have doc_id. labels: doc_id,
    quality, toxic. All trusted documents, of good quality and not toxic, give the target
    multinomial over hashed n-grams of one and two words; all documents give the corpus's.
    A document's score is the mean of its n-grams' log-likelihood ratios. It is kept if it
    passes the base rules and its score is at least the one that 99.8 % of the trusted
    reach, in whole millionths. A null or empty text has no words and fails the base
    rules. Without trusted documents, the base rules alone decide. Repeated rows count as
    often as they are there, and an empty table gives an empty one. One verdict a
    document, the same in each run. Two reads of docs; the second one's rows are written
    below the checkpoint folder, so that the trusted ones' scores are found by id.
    """
    plain = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    trusted = trusted_ids(labels)
    table = weights(plain, trusted)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = kept(docs.select(F.struct(*columns).alias("row"), _measures(text, table).alias("m")), "quality").select("row", "m.*")
    whole = F.floor(F.col("score") * SCALE)
    least = threshold(rows.select(F.col("row.doc_id").alias("_id"), whole.alias("_whole")), trusted)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = F.lit(True) if least is None else F.coalesce(whole, F.lit(0)) >= least
    return rows.select("row", *COUNTS, failed.alias("base_failed"), "score", (~failed & good).alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels, ["doc_id"]).select("row.doc_id", *COUNTS, "base_failed", "kept", "score")
