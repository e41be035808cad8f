"""Choosing among rows: which wins, which stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tasks for each core, where rows are multiplied after they are dealt out, which Spark can't foresee.
TASKS = 4


def tasks(spark: SparkSession) -> int:
    """How many parts rows are dealt to that are multiplied afterwards."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that comes first in order; order must be total and hold no descending strings.

    Aggregates a struct, so rows are reduced within tasks before they are shuffled.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_x")).select(*keys, *[F.col(f"_x.{c}") for c in rest])


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that comes last in order."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_x")).select(*keys, *[F.col(f"_x.{c}") for c in rest])


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def soft_filter(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """A key's rows that meet the condition, or all of them if none does."""
    flagged = df.withColumn("_yes", F.coalesce(condition, F.lit(False)))
    return flagged.withColumn("_any", F.max("_yes").over(Window.partitionBy(*keys))).where(F.col("_yes") | ~F.col("_any")).drop("_yes", "_any")


def with_default_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the columns that it lacks."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def replaced(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new's rows, and old's of keys that new does not have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def divides(df: DataFrame, keys: Sequence[str], group: Sequence[str], item: str) -> DataFrame:
    """Groups that have every item that their key has: relational division, by counts."""
    have = df.groupBy(*keys, *group).agg(F.count_distinct(item).alias("_have"))
    want = df.groupBy(*keys).agg(F.count_distinct(item).alias("_want"))
    return have.join(want, list(keys)).where("_have = _want").drop("_have", "_want")
