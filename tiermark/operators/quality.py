"""Checks of loads, and reports of how two sources agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floors(tables: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """name, observed, floor, ok: each table's rows against the fewest it may have."""
    rows = [df.agg(F.count(F.lit(1)).alias("observed")).select(F.lit(n).alias("name"), "observed", F.lit(k).alias("floor"), (F.col("observed") >= k).alias("ok")) for n, (df, k) in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def single_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the number of different values, and whether it is one."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("values")).withColumn("ok", F.col("values") == 1)


def unmatched(pairs: Mapping[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """what, n: rows of each first table whose key the second does not have."""
    rows = [a.join(b.select(k).distinct(), k, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n") for w, (a, b, k) in pairs.items()]
    return reduce(DataFrame.unionByName, rows)


def bands(df: DataFrame, value: Column, upto: Sequence[tuple[int, str]], rest: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """band, n: how many values lie in each band, and how many rows of it meet each condition."""
    band = None
    for most, name in upto:
        band = F.when(value <= most, name) if band is None else band.when(value <= most, name)
    more = [F.count(F.when(c, 1)).alias(k) for k, c in (counts or {}).items()]
    return df.groupBy(band.otherwise(rest).alias("band")).agg(F.count(F.lit(1)).alias("n"), *more)


def warnings(rows: DataFrame, totals: DataFrame, keys: Sequence[str], what: str, plan: str) -> DataFrame:
    """keys, what (in small letters) and said: the plans that a warning holds for, or that it holds for all n of them.

    totals: keys and n. Warnings that differ in letters' case alone are one.
    """
    grouped = rows.groupBy(*keys, F.lower(what).alias(what)).agg(F.sort_array(F.collect_set(plan)).alias("_plans"))
    listed = F.array_join(F.transform("_plans", lambda p: p.cast("string")), ", ")
    every = (F.size("_plans") == F.col("n")) & (F.col("n") > 1)
    return grouped.join(totals, list(keys)).select(*keys, what, F.when(every, F.format_string("all %d plans", "n")).otherwise(listed).alias("said"))


def reasons(conditions: Mapping[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, n) for n, c in conditions.items()]))


def replace_if_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """new if it has a row, else old."""
    return old if new.isEmpty() else new


def at_least(df: DataFrame, key: str, floor: int) -> DataFrame:
    """df, or an error when it is read, if it has fewer than floor different keys."""
    n = df.agg(F.count_distinct(key).alias("_n"))
    fine = F.when(F.col("_n") >= floor, True).otherwise(F.raise_error(F.format_string(f"%d different {key}, {floor} needed", "_n")))
    return df.crossJoin(F.broadcast(n)).where(fine).drop("_n")  # with one row
