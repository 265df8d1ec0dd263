"""Declared inputs and derived models, seeds, views, partitions, exports, and the state machine of daily runs."""

from __future__ import annotations

import csv
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Declared source tables and models over them. A model is a function of the catalog; it names what it reads by source() and
    ref(), and is built once. Models that need each other are refused."""

    def __init__(self, spark: SparkSession, tables: dict[str, str]):
        self.spark, self.tables, self.models, self.built, self.open = spark, tables, {}, {}, []
        self.needs: dict[str, list[str]] = {}

    def model(self, name: str, build: Callable[[Catalog], DataFrame]) -> None:
        self.models[name] = build

    def source(self, name: str) -> DataFrame:
        """A declared table; others are refused."""
        if name not in self.tables:
            raise LookupError(f"undeclared table {name}")
        return self.spark.read.parquet(self.tables[name])

    def ref(self, name: str) -> DataFrame:
        if self.open:
            self.needs.setdefault(self.open[-1], []).append(name)
        if name in self.open:
            raise ValueError(f"models need each other: {' -> '.join([*self.open, name])}")
        if name not in self.built:
            if name not in self.models:
                raise LookupError(f"unknown model {name}")
            self.open.append(name)
            try:
                self.built[name] = self.models[name](self)
            finally:
                self.open.pop()
        return self.built[name]

    def plan(self, name: str) -> list[str]:
        """The models that a model needs, in the order in which they can be built, itself last."""
        self.ref(name)
        order: list[str] = []

        def visit(x: str) -> None:
            for need in self.needs.get(x, ()):
                visit(need)
            if x not in order:
                order.append(x)

        visit(name)
        return order


def day_as_text(frame: DataFrame, column: str = "day") -> DataFrame:
    """A day column as text, whether it is stored as a date or as text."""
    return frame.withColumn(column, F.col(column).cast("string"))


def partition_days(spark: SparkSession, path: str, column: str = "day") -> list[str]:
    """Days of a partitioned table from its folders; no row is read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()] if fs.exists(target) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def partition_inventory(frame: DataFrame, column: str = "day") -> DataFrame:
    """First and last partition, how many, and rows; reads the partition column alone."""
    per = frame.groupBy(column).agg(F.count("*").alias("rows"))
    return per.agg(F.min(column).alias("first_partition"), F.max(column).alias("last_partition"), F.count("*").alias("partitions"), F.sum("rows").alias("rows"))


def seed(spark: SparkSession, path: str) -> DataFrame:
    """A small CSV of texts as a table; every row must have the header's number of fields."""
    with open(path, newline="") as f:
        header, *rows = list(csv.reader(f))
    bad = [k + 2 for k, r in enumerate(rows) if len(r) != len(header)]
    if bad:
        raise ValueError(f"{path}: lines {bad} do not have {len(header)} fields")
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in header))


def publish_view(frame: DataFrame, name: str) -> None:
    """The definition only; readers run it again."""
    frame.createOrReplaceTempView(name)


def stream_batches(frame: DataFrame, rows: int = 10_000) -> Iterator[list]:
    """Rows in batches to the client, a partition at a time."""
    batch = []
    for r in frame.toLocalIterator(prefetchPartitions=True):
        batch.append(r)
        if len(batch) == rows:
            yield batch
            batch = []
    if batch:
        yield batch


def export_by_key(frame: DataFrame, path: str, column: str, rows: int = 100_000) -> None:
    """Hive-partitioned Parquet by a hash of a column, zstd, sorted within files, in row groups of bounded size. Rows of a key are dealt
    over as many files as their number needs."""
    keyed = frame.withColumn(f"{column}_key", F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 20))
    keyed = keyed.repartition(F.col(f"{column}_key"), F.pmod(F.xxhash64(*frame.columns), F.lit(8))).sortWithinPartitions(f"{column}_key", *frame.columns[:2])
    keyed.write.option("compression", "zstd").option("maxRecordsPerFile", rows).partitionBy(f"{column}_key").mode("errorifexists").parquet(path)


def write_with_digest(frame: DataFrame, path: str) -> dict:
    """Write Parquet, then the digest of each part and of the data set, beside it. The parts are read by Spark, in tasks."""
    spark = frame.sparkSession
    frame.write.mode("errorifexists").parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    parts = [(r.name, r.digest) for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest")).orderBy("name").collect()]
    manifest = {"parts": dict(parts), "digest": hashlib.sha256("".join(d for _, d in parts).encode()).hexdigest()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.digest")
    return manifest


def check_digest(spark: SparkSession, path: str) -> bool:
    """Whether the parts are those that were written."""
    manifest = json.loads(spark.read.text(f"{path.rstrip('/')}.digest").first().value)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    found = {r.name: r.digest for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest")).collect()}
    return found == manifest["parts"]


def batches_by_key(frame: DataFrame, by: str, run: Callable, schema: str) -> DataFrame:
    """A key's rows as Arrow tables to a function, where they are; nothing passes through a client."""
    return frame.groupBy(by).applyInArrow(run, schema)


def report(frame: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table."""
    rows = frame.collect()
    lines = [f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


_READS = re.compile(r"\s*(select|with|show|describe|explain|values)\b", re.I)


def read_only(spark: SparkSession, statement: str, **args) -> DataFrame:
    """Run a statement that reads; others are refused before they run. Values go in as parameters, never as text."""
    if not _READS.match(statement):
        raise PermissionError("only statements that read")
    return spark.sql(statement, args=args or None)


def guarded_path(path: str, allowed: str) -> str:
    """A path that may be written, which lies under the allowed folder."""
    if ".." in path.split("/") or not path.startswith(allowed.rstrip("/") + "/"):
        raise PermissionError(f"{path} is outside {allowed}")
    return path


class DayRuns:
    """Daily runs and their states: refreshing, then complete, partial (inputs missing) or failed. Done days are skipped unless forced.

    A state is a small file a day, written whole; the newest attempt of a day counts.
    """

    DONE = ("complete", "partial")

    def __init__(self, spark: SparkSession, path: str, expected: list[str]):
        self.spark, self.path, self.expected = spark, path, expected

    def set(self, day: str, state: str, **more) -> None:
        entry = {"day": day, "state": state, "at": datetime.now(timezone.utc).isoformat()} | more
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{day}")

    def state(self, day: str) -> dict | None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{day}")
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return json.loads(self.spark.read.text(f"{self.path}/{day}").first().value) if fs.exists(target) else None

    def run(self, day: str, available: set[str], build: Callable[[str, list[str]], None], force: bool = False) -> str:
        """Build one day from the inputs that there are. A build that fails leaves the day failed and raises."""
        known = self.state(day)
        if known and known["state"] in self.DONE and not force:
            return "skipped"
        have, missing = [g for g in self.expected if g in available], [g for g in self.expected if g not in available]
        self.set(day, "refreshing", available=have, missing=missing)
        try:
            build(day, have)
        except Exception as wrong:
            self.set(day, "failed", available=have, missing=missing, error=f"{type(wrong).__name__}: {wrong}"[:4000])
            raise
        state = "partial" if missing else "complete"
        self.set(day, state, available=have, missing=missing)
        return state

    def backfill(self, availability: dict[str, set[str]], build: Callable, days: int, last: str = "final") -> list[tuple[str, str]]:
        """The newest days that have a final output, oldest first."""
        chosen = sorted(d for d, groups in availability.items() if last in groups)[-days:]
        return [(d, self.run(d, availability[d], build)) for d in chosen]
