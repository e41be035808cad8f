"""Readers and writers of the files that plan data comes in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of labelled cases of names; the last may be missing in a row.
CASES = ("name", "dosage", "expected", "strengths", "brand", "flag", "hint")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a local session without it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return f"{root}/{name}-{uuid.uuid4()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder below the shared one and read again: what follows does not compute it anew, whichever executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_delimited(spark: SparkSession, path: str, columns: Mapping[str, str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Columns by their names in the header, all strings, as the names given.

    columns: header name to new name. Header names are trimmed, and a byte order mark is
    dropped; a column that is missing is an error. Short rows are padded with nulls.
    """
    raw = spark.read.options(header=True, sep=sep, encoding=encoding, mode="PERMISSIVE", inferSchema=False, maxCharsPerColumn=-1, enforceSchema=False).csv(path)
    clean = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = [c for c in columns if c not in clean.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return clean.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])


def only_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the keys wanted: a semi-join, which Spark sends to all tasks while keys are few."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi")


def read_prefixed(spark: SparkSession, path: str, schema: str, keys: DataFrame, sep: str = "|") -> DataFrame:
    """Delimited lines whose first field is one of keys (column key); others are dropped before they are parsed.

    schema: all columns of the files, in order. Header lines have no key, so they go, too.
    """
    lines = spark.read.text(path)
    ours = lines.join(keys.select(F.col("key").alias("_key")).distinct(), F.substring_index("value", sep, 1) == F.col("_key"), "left_semi")
    return ours.select(F.from_csv("value", F.lit(schema), {"sep": sep, "mode": "PERMISSIVE"}).alias("x")).select("x.*")


def last_per_key(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Of rows that repeat a key, the one with the largest ordinal."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_x")).select(*keys, *[f"_x.{c}" for c in rest])


SEARCH = T.StructType(
    [
        T.StructField("plan_id", T.StringType()),
        T.StructField("zip", T.StringType()),
        T.StructField("drugs_entered", T.ArrayType(T.StringType())),
        T.StructField("pharmacies", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("distance", T.DoubleType())]))),
        T.StructField("yearly_drug_cost", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("deductible_met", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_bad", T.StringType()),
    ]
)


def read_searches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Captured searches as rows of plan_id, zip, drugs, store, cost, met and distance; and the lines that are no JSON.

    A search without costs is a row without a store. met is the month in which the store's
    deductible is met, distance that of the pharmacy of its name.
    """
    docs = spark.read.schema(SEARCH).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").json(path)
    rows = docs.where("plan_id is not null").select("plan_id", "zip", F.size("drugs_entered").alias("drugs"), "pharmacies", "deductible_met", F.explode_outer("yearly_drug_cost").alias("store", "cost"))
    at = F.get(F.filter("pharmacies", lambda p: p["name"] == F.col("store")), F.lit(0))
    good = rows.select("plan_id", "zip", "drugs", "store", "cost", F.try_element_at("deductible_met", F.col("store")).alias("met"), at["distance"].alias("distance"))
    return good, docs.where("plan_id is null and _bad is not null").select(F.col("_bad").alias("line"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases: fields between bars, lines that begin with # left out, the last field optional."""
    schema = ", ".join(f"{c} string" for c in CASES)
    return spark.read.schema(schema).options(sep="|", comment="#", mode="PERMISSIVE").csv(path)


def newest_year(rows: DataFrame, path: Column) -> DataFrame:
    """Rows of the files with the latest year in their names."""
    dated = rows.withColumn("_year", F.regexp_extract(path, r"(20[2-3]\d)[^/]*$", 1).try_cast("int"))
    newest = dated.agg(F.max("_year").alias("_newest"))
    return dated.join(F.broadcast(newest), F.col("_year") == F.col("_newest")).drop("_year", "_newest")


def write_keyed(rows: DataFrame, path: str, keys: Sequence[str], ordinal: str, keep: str = "last", partition: str | None = None) -> None:
    """A table with one row a key: the last by ordinal (replace) or the first (ignore)."""
    by = F.col(ordinal) if keep == "last" else -F.col(ordinal)
    out = last_per_key(rows.withColumn("_by", by), keys, "_by").drop("_by")
    writer = out.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends rows whose keys the table at path does not have; returns how many."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
        rows = rows.join(done, list(keys), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = rows.dropDuplicates(list(keys))
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def write_grid(rows: DataFrame, path: str, row: str, column: str, values: Sequence[str], value: Column) -> None:
    """A CSV grid: a line for each row, a column for each value, - where there is none."""
    grid = rows.groupBy(row).pivot(column, list(values)).agg(value)
    grid.select(row, *[F.coalesce(F.col(f"`{v}`").cast("string"), F.lit("-")).alias(v) for v in values]).write.mode("overwrite").option("header", True).csv(path)
