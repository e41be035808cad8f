"""Loads that change a table only if what they bring is as it must be."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CURRENT = "_current"


class Store:
    """Files of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        path = self.at(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The file with a new text: written beside it, then renamed over it in one step."""
        beside = self.at(f".{name}-{uuid.uuid4()}")
        stream = self.fs.create(beside, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        files = self.jvm.org.apache.hadoop.fs
        over = self.jvm.java.lang.reflect.Array.newInstance(files.Options.Rename.OVERWRITE.getClass(), 1)
        over[0] = files.Options.Rename.OVERWRITE
        files.FileContext.getFileContext(self.at("").toUri(), self.conf).rename(beside, self.at(name), over)

    def names(self, name: str = "") -> list[str]:
        path = self.at(name)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def current(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of a table that gated_load keeps; none before the first load."""
    version = Store(spark, table).read(CURRENT)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{table}/{version}")


def gated_load(rows: DataFrame, table: str, measures: Mapping[str, Column], gates: Mapping[str, Callable[[dict], bool]], keep: int = 2) -> tuple[dict, list[str]]:
    """Writes rows as the table's new version, and makes it the current one if all gates allow it.

    measures: aggregates, which are observed in the same pass as the write; gates: name and
    a condition on them. Returns what was measured and the names of the gates that did not
    allow it. Readers see the old version until one rename of the table's pointer; a load
    that is not allowed, or dies, changes nothing. Of older versions keep - 1 stay for
    readers that have begun.
    """
    spark, store = rows.sparkSession, Store(rows.sparkSession, table)
    version, seen = f"v-{uuid.uuid4()}", Observation()
    rows.observe(seen, *[c.alias(n) for n, c in measures.items()]).write.parquet(f"{table}/{version}")
    measured = seen.get
    refused = [name for name, allows in gates.items() if not allows(measured)]
    if refused:
        store.remove(version)
        return measured, refused
    log = json.loads(store.read("_versions") or "[]")
    store.replace(CURRENT, version)
    log.append(version)
    store.replace("_versions", json.dumps(log[-keep:]))
    for old in log[:-keep]:
        store.remove(old)
    return measured, refused


def one_value(name: str, wanted: object | None = None) -> Callable[[dict], bool]:
    """A gate: the measure, a set of values, has exactly one (the one wanted)."""
    return lambda m: len(m[name]) == 1 and (wanted is None or list(m[name]) == [wanted])


def at_least(name: str, floor: int) -> Callable[[dict], bool]:
    """A gate: the measure is no smaller than floor; with 1, a table is replaced only by a load that has rows."""
    return lambda m: (m[name] or 0) >= floor


def load_in_turn(loads: Sequence[tuple[str, DataFrame]], table: str, measures: Mapping[str, Column], gates: Mapping[str, Callable[[dict], bool]], schema: str, after: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Loads one after the other; step, refused, and the columns of after(table) as it reads after each."""
    spark, out = loads[0][1].sparkSession, None
    for name, rows in loads:
        _, refused = gated_load(rows, table, measures, gates, keep=len(loads))
        # a version stays as it is, so what was read after a step can be computed later
        told = after(current(spark, table, schema)).select(F.lit(name).alias("step"), F.lit(",".join(refused)).alias("refused"), "*")
        out = told if out is None else out.unionByName(told)
    return out
