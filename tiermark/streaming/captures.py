"""Captures as they arrive: the newest price of each key, kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tiermark.operators.loads import Store


def _newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, *[f"_x.{c}" for c in rest])


def keep_newest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], files: int = 1) -> StreamingQuery:
    """Starts a stream of capture files into target, a folder for each version of the table.

    Each batch is merged with the version before it, so late files change nothing that a
    newer capture has set, and a batch that is run again writes the same version again.
    Ends when all files there are have been read.
    """
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch.select(*schema.fieldNames())
        if n:
            rows = rows.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{target}/{n - 1}"))
        _newest(rows, keys, order).select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{target}/{n}")

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_newest_parts(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], parts: int = 32, files: int = 1) -> StreamingQuery:
    """Starts a stream of capture files into target, whose rows are dealt out into parts by a hash of the keys.

    A batch writes new versions of the parts that its keys lie in, and of no others; when
    they are written, those parts' older versions go. A batch that is run again reads what
    was there before it, as its own versions do not count, and writes the same. Rows with
    the newest order win, so late files change nothing that a newer capture has set. Ends
    when all files there are have been read; newest_parts reads the table.
    """
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    store = Store(spark, target)

    def merge(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        rows = batch.select(*schema.fieldNames(), F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part"))
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # no more than parts
        versions = {p: [v for v in _versions(store, p) if v < n] for p in touched}
        before = [f"{target}/part={p}/batch={v[-1]}" for p, v in versions.items() if v]
        if before:
            old = session.read.schema(schema).parquet(*before)
            rows = rows.unionByName(old.select(*schema.fieldNames(), F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")))
        new = _newest(rows, [*keys, "part"], order).select(*rows.columns, F.lit(n).alias("batch"))
        new.repartition(max(1, len(touched)), "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(target)
        for p, older in versions.items():
            for v in older:
                store.remove(f"part={p}/batch={v}")

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(store: Store, part: int) -> list[int]:
    return sorted(int(x.partition("=")[2]) for x in store.names(f"part={part}") if x.startswith("batch="))


def newest_parts(spark: SparkSession, schema: StructType, target: str) -> DataFrame:
    """The table that keep_newest_parts keeps: each part's latest version."""
    store = Store(spark, target)
    parts = [(x, _versions(store, int(x.partition("=")[2]))) for x in store.names() if x.startswith("part=")]
    paths = [f"{target}/{p}/batch={v[-1]}" for p, v in parts if v]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_windowed_counts(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, late: str = "1 day", window: str = "6 hours", files: int = 1) -> StreamingQuery:
    """Starts windowed_counts over a folder of event files as a stream into a table of closed windows.

    A window is written once, when the watermark has passed its end; events that come
    later than `late` behind the newest one before are dropped.
    """
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(source)
    counts = windowed_counts(arrivals, late, window).select(F.col("w.start").alias("window_start"), "event_type", "n")
    return counts.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 day", window: str = "6 hours") -> DataFrame:
    """Events by type in windows of time, with a watermark for late ones; for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
