"""Which figures are official: values from estimates are not shown as if they were."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gates(meta: DataFrame) -> DataFrame:
    """One row of prices, networks and stars: whether each is official.

    meta: key and value, text, one row a key. Prices and networks are official unless
    prices_estimated or network_estimated is 1; stars if stars_year is the data's year.
    """
    of = lambda k: F.max(F.when(F.col("key") == k, F.trim("value")))
    year = of("stars_year")
    return meta.agg(
        (~of("prices_estimated").eqNullSafe("1")).alias("prices"), (~of("network_estimated").eqNullSafe("1")).alias("networks"),
        F.coalesce(year.rlike(r"^\d+$") & (year.try_cast("int") == of("year").try_cast("int")), F.lit(False)).alias("stars"),
    )


def official_lists(lists: DataFrame) -> DataFrame:
    """list and official: not if its rows come from a carrier (lists: list, source; null counts as official)."""
    return lists.groupBy("list").agg((F.min(F.coalesce("source", F.lit("cms"))) != "carrier").alias("official"))


def masked(rows: DataFrame, meta: DataFrame, columns: Mapping[str, str], lists: DataFrame) -> DataFrame:
    """rows with columns (name: gate) null where their gate is shut, and list_official of column list; a null or unknown list is not.

    A gate is "prices", "networks", "stars" or "list". The gates are one row, so that the join with them moves none.
    """
    flagged = rows.join(official_lists(lists).withColumnRenamed("official", "_official"), "list", "left").withColumn("list_official", F.coalesce("_official", F.lit(False))).drop("_official")
    both = flagged.crossJoin(F.broadcast(gates(meta).select(F.struct("*").alias("_gates"))))
    gate = lambda g: F.col("list_official") if g == "list" else F.col(f"_gates.{g}")
    return both.withColumns({c: F.when(gate(g), F.col(c)) for c, g in columns.items()}).drop("_gates")
