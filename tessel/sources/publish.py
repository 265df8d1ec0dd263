"""Verified publication: immutable versions with a manifest, partition replacement, resumable bucket loads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.relational import fingerprint


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish_version(frame: DataFrame, path: str, partition_by: list[str] = ()) -> dict:
    """Write an attempt, compare what it holds with the frame, then commit it by renaming its manifest into place. Earlier versions stay.

    The frame is read twice, so it must give the same rows both times (a stored table, or a plan over one). Of two writers at once one gets the
    version's number and the other the next one; an attempt that differs or is not committed is never read.
    """
    spark, version = frame.sparkSession, uuid.uuid4().hex
    target = f"{path}/v-{version}"
    frame.write.partitionBy(*partition_by).parquet(target) if partition_by else frame.write.parquet(target)
    want = fingerprint(frame).first()
    stored = fingerprint(spark.read.schema(frame.schema).parquet(target).select(frame.columns)).first()
    if stored != want:
        raise ValueError(f"{target} holds {stored['rows']} rows, the frame has {want['rows']}; or they differ")
    entry = {"version": version, "rows": stored["rows"], "fingerprint": str(stored["fingerprint"]), "schema": frame.schema.json()}
    draft, fs = _fs(spark, f"{path}/draft-{version}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    fs.mkdirs(_fs(spark, f"{path}/manifest")[0])
    number = len(versions(spark, path))
    while fs.exists(_fs(spark, f"{path}/manifest/{number:08d}.json")[0]) or not fs.rename(draft, _fs(spark, f"{path}/manifest/{number:08d}.json")[0]):
        number += 1
    return entry | {"number": number}


def versions(spark: SparkSession, path: str) -> list[dict]:
    """Manifest entries, oldest first."""
    target, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(target) or not fs.listStatus(target):
        return []
    rows = spark.read.text(f"{path}/manifest").select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).collect()
    return sorted((json.loads(r.value) | {"number": int(r.file.split(".")[0])} for r in rows), key=lambda e: e["number"])


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A pinned version, the latest by default."""
    known = versions(spark, path)
    entry = next((e for e in known if e["version"] == version), None) if version else known[-1] if known else None
    if entry is None:
        raise LookupError(f"no version {version or ''} in {path}")
    return spark.read.parquet(f"{path}/v-{entry['version']}")


def replace_partitions(frame: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that the frame has; running it again leaves the same table."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load_buckets(frame: DataFrame, path: str, bucket: str = "bucket") -> dict[str, list]:
    """Load what is missing, skip buckets that are stored already, refuse those that are stored but differ."""
    spark = frame.sparkSession
    want = {r[bucket]: (r["rows"], r["fingerprint"]) for r in fingerprint(frame, [bucket]).collect()}
    target, fs = _fs(spark, path)
    have = {}
    if fs.exists(target):
        have = {r[bucket]: (r["rows"], r["fingerprint"]) for r in fingerprint(spark.read.schema(frame.schema).parquet(path).select(frame.columns), [bucket]).collect()}
    differ = [b for b in have if b in want and have[b] != want[b]]
    if differ:
        raise ValueError(f"buckets differ from what is stored: {sorted(differ)}")
    missing = sorted(set(want) - set(have))
    if missing:
        replace_partitions(frame.where(F.col(bucket).isin(missing)), path, [bucket])
    stored = {r[bucket]: (r["rows"], r["fingerprint"]) for r in fingerprint(spark.read.schema(frame.schema).parquet(path).select(frame.columns), [bucket]).collect()} if want else {}
    if any(stored.get(b) != s for b, s in want.items()):
        raise ValueError("what was stored differs from the frame")
    return {"loaded": missing, "skipped": sorted(set(want) & set(have))}


def check_schema(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """§1.3: refuse a table whose columns or types are not the declared ones."""
    found = dict(frame.dtypes)
    if found != columns:
        raise TypeError(f"declared {columns}, found {found}")
    return frame
