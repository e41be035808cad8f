"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a class of a regular expression.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept where it survives the loss of executors."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table below the checkpoint folder: smaller than a checkpoint, and columns can be read alone."""
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, as texts can be long; holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is planned and run within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def running_total(df: DataFrame, group: str, key: str, value: str, out: str, per_part: int = 500, whole: int = 100_000) -> DataFrame:
    """Adds out: the sum of value over the group's rows with a smaller key.

    key is a non-negative long that spreads evenly and, within the group, is unique.
    A group is cut into parts by the leading digits of its keys, about per_part rows
    each, so that one group's rows are never all in one task. What precedes a part is a
    running total of the parts' sums, found the same way while there are more than
    `whole` of them. df is computed twice.
    """
    from pyspark.sql import Window

    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("top")).first()
    parts = max(1, -(-stats["n"] // per_part))
    width = max(1, -(-((stats["top"] or 0) + 1) // parts))
    cut = df.withColumn("_part", F.expr(f"`{key}` div {width}"))
    sums = cut.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum"))
    if parts > whole:
        sums = running_total(checkpoint(sums), "_group", "_p", "_sum", "_base", per_part, whole)
    else:
        before = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    within = Window.partitionBy(group, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_run", F.coalesce(F.sum(value).over(within), F.lit(0)))
    sums = sums.select(F.col("_group").alias("_g"), F.col("_p").alias("_at"), F.col("_base").alias("_before"))
    joined = cut.join(sums, cut[group].eqNullSafe(sums["_g"]) & (cut["_part"] == sums["_at"]), "inner")
    return joined.withColumn(out, F.col("_before") + F.col("_run")).drop("_part", "_g", "_at", "_before", "_run")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
