"""Matching of written text to tables: contained patterns, requests, directories, evidence, agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.operators.rows import first_by


def runs(text: Column, most: Column | int) -> Column:
    """The runs of one to `most` words of a text, each once."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    longest = F.least(F.lit(most) if isinstance(most, int) else most, F.size(words))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    every = F.flatten(F.transform(F.sequence(F.lit(1), longest), of))
    return F.array_distinct(F.when(F.size(words) > 0, every).otherwise(F.array().cast("array<string>")))


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """texts with each pattern that they contain as words: an equal join on runs of as many words as the longest pattern has."""
    most = patterns.agg(F.max(F.size(F.split(pattern, " ")))).first()[0] or 0
    return texts.withColumn(pattern, F.explode(runs(F.col(text), most))).join(patterns, pattern)


def expanded(text: Column, aliases: Mapping[str, str]) -> Column:
    """Words and pairs of words that have an alias, replaced by it; longer ones first."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), F.lit(" "))
    steps = sorted(aliases.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return F.trim(reduce(lambda x, kv: F.replace(x, F.lit(f" {kv[0]} "), F.lit(f" {kv[1]} ")), steps, t))


def requested(requests: DataFrame, plans: DataFrame, keywords: Sequence[str], least: int = 8) -> DataFrame:
    """request, plan and score: the plan that a request's text means, if one scores at least `least`.

    requests: request (text, aliases replaced), each once; plans: plan, carrier, name. A
    carrier's name in the request counts 10, each keyword that both have 8, each other
    word of over three letters 3. The best score wins, then the smallest plan. Terms of
    plans are joined with runs of the request's words. Plans of one carrier and name score
    alike, so only the first of them is joined.
    """
    named = plans.groupBy(F.lower("carrier").alias("carrier"), F.lower("name").alias("name")).agg(F.min("plan").alias("plan"))
    words = F.array_distinct(F.split("name", " "))
    key = F.array(*map(F.lit, keywords))
    term = lambda w: F.struct(w.alias("term"), (F.when(F.array_contains(key, w), 8).otherwise(0) + F.when(F.length(w) > 3, 3).otherwise(0)).alias("weight"))
    own = F.array(F.struct(F.col("carrier").alias("term"), F.lit(10).alias("weight")))
    terms = named.select("plan", F.explode(F.concat(own, F.transform(words, term))).alias("x")).select("plan", "x.term", "x.weight").where("weight > 0")
    met = contained(requests.select("request"), "request", terms.select("term").distinct(), "term").join(terms, "term")
    scored = met.groupBy("request", "plan").agg(F.sum("weight").alias("score")).where(F.col("score") >= least)
    return first_by(scored, ["request"], [-F.col("score"), F.col("plan")], ["plan", "score"])


def in_directory(doctors: DataFrame, entries: DataFrame) -> DataFrame:
    """doctor and id: the entry of a doctor's last name and first initial that fits best.

    doctors: doctor, first, last, city; entries: id, first, last, city, accepting. The
    first name's beginning counts first, then the city, then who accepts patients, then the
    smallest id. Entries alike in all that counts are one before the join, so what is
    joined for a name grows with its first names and cities, not with its entries.
    """
    same = [F.lower("last").alias("last"), F.lower(F.left("first", F.lit(1))).alias("initial")]
    few = entries.groupBy(*same, F.lower("first").alias("given"), F.col("city").alias("place"), "accepting").agg(F.min("id").alias("id"))
    asked = doctors.select("doctor", *same, F.lower("first").alias("said"), F.col("city").alias("home"))
    both = asked.join(few, ["last", "initial"])
    alike = F.col("given").startswith(F.col("said")) | F.col("said").startswith(F.col("given"))
    order = [(~alike).alias("a"), (~F.col("place").eqNullSafe(F.col("home"))).alias("b"), (~F.coalesce("accepting", F.lit(False))).alias("c"), F.col("id")]
    return first_by(both, ["doctor"], order, ["id"])


def by_precedence(asked: DataFrame, evidence: DataFrame, sources: Sequence[str], missing: str = "not checked") -> DataFrame:
    """asked with source and status: of the evidence on an entity, what its most trusted source says for a scope.

    asked: entity, scope; evidence: entity, scope (null: holds for all), source, status, ts,
    id. Sources stand in their order of trust; of one source what names the scope wins,
    then the newest. missing where nothing is known, which is not the same as no.
    """
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    known = evidence.where(rank > 0).withColumn("rank", rank).withColumnRenamed("scope", "of")
    # of each entity, source and scope only the newest can win
    newest = known.groupBy("entity", "of", "rank", "source").agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.max(F.struct("ts", "id")).alias("last"))
    both = asked.join(newest, "entity", "left").where(F.col("source").isNull() | F.col("of").isNull() | (F.col("of") == F.col("scope")))
    best = both.groupBy("entity", "scope").agg(F.max_by(F.struct("source", "status"), F.struct(-F.col("rank"), F.col("of").isNotNull(), "last")).alias("x"))
    return asked.join(best, ["entity", "scope"], "left").select("entity", "scope", F.coalesce("x.source", F.lit("none")).alias("source"), F.coalesce("x.status", F.lit(missing)).alias("status"))


def agreed(votes: DataFrame) -> DataFrame:
    """label, candidate, agreed, seen, covered, accepted for each candidate of each label.

    votes: label, candidate, kind (its ingredients), agree, covered (booleans), a row for
    each row of the label's. A label is accepted if its best candidates agree with all
    rows, two at least, one of them covered, and are all of one kind; then these are.
    """
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = votes.groupBy("label", "candidate", "kind").agg(hit(F.col("agree")).alias("agreed"), F.count(F.lit(1)).alias("seen"), hit(F.col("agree") & F.col("covered")).alias("covered"))
    w = Window.partitionBy("label")
    best = F.max("agreed").over(w)
    ranked = sums.withColumn("_top", (F.col("agreed") == best) & (best > 0))
    ranked = ranked.withColumn("_one", F.min(F.when(F.col("_top"), F.col("kind"))).over(w) == F.max(F.when(F.col("_top"), F.col("kind"))).over(w))
    fine = F.col("_top") & F.col("_one") & (F.col("agreed") == F.col("seen")) & (F.col("seen") >= 2) & (F.col("covered") >= 1)
    return ranked.select("label", "candidate", "agreed", "seen", "covered", F.coalesce(fine, F.lit(False)).alias("accepted"))
