"""A ledger of runs: what a run reads, means to write, has tried and has committed, so that a run that was cut off goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.operators.relational import fingerprint
from tessel.sources.publish import _fs


class Refused(RuntimeError):
    """What is asked for does not fit what the run has stored."""


def plan_digest(frame: DataFrame) -> str:
    """A digest of a frame's schema and analysed plan, the same in every session.

    Numbers of expressions are counted anew from the first, and folders that are read are not part of it, so that tables stored along
    the way may lie elsewhere in another attempt; which versions a run reads is said when it is opened. A Python function counts by its name.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(key)
    conf.set(key, str(1 << 30))
    try:
        text = frame._jdf.queryExecution().analyzed().toString()
    finally:
        conf.set(key, before)
    seen: dict[str, int] = {}
    text = re.sub(r"#(\d+)", lambda m: f"#{seen.setdefault(m[1], len(seen))}", text)
    return hashlib.sha256((frame.schema.json() + text).encode()).hexdigest()


def write_observed(frame: DataFrame, path: str, partition_by: list[str] = ()) -> dict:
    """Write a frame and return its number of rows and fingerprint, taken from the rows as they are written.

    The frame runs once and what was written is not read again, but for the row counts of the files' footers, which must add up to the same.
    Metrics come from the tasks that write, so that a task that is tried again counts once.
    """
    spark, seen = frame.sparkSession, Observation()
    signature = F.sum(F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in frame.columns]).cast("decimal(38,0)"))
    out = frame.observe(seen, F.count(F.lit(1)).alias("rows"), signature.alias("fingerprint")).write
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    found = seen.get
    rows, mark = found.get("rows", 0), found.get("fingerprint")
    stored = spark.read.schema(frame.schema).parquet(path).count()
    if stored != rows:
        raise ValueError(f"{path} holds {stored} rows, {rows} were written")
    return {"rows": rows, "fingerprint": None if mark is None else str(int(mark))}


class Run:
    """The steps of one run, each written at most once.

    `path/<run>/run.json` says what the run reads (versions of its inputs, a profile). It never changes: a run that is opened with other
    inputs is refused. A step's entry `intent-<n>` with its plan's digest comes before attempt n, which writes to a folder of its own, and
    `commit` after it. A step that is committed is never written again; asked for with another plan it is refused. An attempt without a
    commit is unsure: if its job ended (the committer's mark lies in its folder), what is stored is read, signed and committed; if not, the
    next attempt starts beside it, and nothing is deleted. An attempt that may still run elsewhere does no harm, as one commit alone is made
    and the loser takes the winner's. Entries are renamed into place and read back, which is safe on a file system with
    atomic renames; on an object store one driver at a time may hold a run.
    """

    def __init__(self, spark: SparkSession, path: str, run: str, inputs: dict[str, str] | None = None, profile: str | None = None):
        """`inputs` and `profile` may be left out for a run that exists."""
        if not re.fullmatch(r"[A-Za-z0-9_\-]+", run):
            raise ValueError(f"a run's name has letters, digits, _ and -: {run!r}")
        self.spark, self.path = spark, f"{path}/{run}"
        asked = {k: v for k, v in (("inputs", inputs), ("profile", profile)) if v is not None}
        self.config = self._get("run.json")
        if self.config is None:
            self.config = self._put("run.json", {"inputs": {}, "profile": ""} | asked)
        if any(self.config[k] != v for k, v in asked.items()):
            raise Refused(f"{run} was opened with {self.config}, not {asked}")

    def _get(self, name: str) -> dict | None:
        target, fs = _fs(self.spark, f"{self.path}/{name}")
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _put(self, name: str, entry: dict) -> dict:
        """The entry of this name after the call: ours, or that of whoever was first."""
        target, fs = _fs(self.spark, f"{self.path}/{name}")
        draft = _fs(self.spark, f"{self.path}/drafts/{uuid.uuid4().hex}")[0]
        out = fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        if not fs.exists(target):
            fs.rename(draft, target)
        found = self._get(name)
        if found is None:
            raise OSError(f"{self.path}/{name} was not written")
        return found

    def committed(self, step: str) -> dict | None:
        return self._get(f"{step}/commit.json")

    def steps(self, below: str) -> list[str]:
        """Names of the committed steps right below a path, in order."""
        target, fs = _fs(self.spark, f"{self.path}/{below}")
        names = sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []
        return [n for n in names if self.committed(f"{below}/{n}")]

    def attempts(self, step: str) -> list[dict]:
        """Entries of all attempts, oldest first."""
        found = []
        while (entry := self._get(f"{step}/intent-{len(found) + 1}.json")) is not None:
            found.append(entry)
        return found

    def _folder(self, step: str, attempt: int) -> str:
        return f"{self.path}/{step}/attempt-{attempt}"

    def _settled(self, step: str, schema) -> tuple[int, dict] | None:
        """The newest attempt whose job ended, with the signature of what it stored."""
        for n in range(len(self.attempts(step)), 0, -1):
            mark, fs = _fs(self.spark, f"{self._folder(step, n)}/_SUCCESS")
            if fs.exists(mark):
                signed = fingerprint(self.spark.read.schema(schema).parquet(self._folder(step, n)).select(schema.names)).first()
                return n, {"rows": signed["rows"], "fingerprint": None if signed["fingerprint"] is None else str(int(signed["fingerprint"]))}
        return None

    def publish(self, step: str, frame: DataFrame, partition_by: list[str] = ()) -> dict:
        """Write the step unless it is stored; its commit entry."""
        digest = plan_digest(frame)
        done, tried = self.committed(step), self.attempts(step)
        for entry in [done] if done else tried:
            if entry["digest"] != digest or entry["partition_by"] != list(partition_by):
                raise Refused(f"the plan of {step} is not the one that the run began with; take a new run")
        if done:
            return done
        settled = self._settled(step, frame.schema)
        if settled is None:
            number = len(tried) + 1
            mine = {"digest": digest, "partition_by": list(partition_by), "writer": uuid.uuid4().hex}
            while self._put(f"{step}/intent-{number}.json", mine) != mine:
                number += 1
            settled = number, write_observed(frame, self._folder(step, number), partition_by)
        number, signed = settled
        return self._put(f"{step}/commit.json", {"attempt": number, "digest": digest, "partition_by": list(partition_by), "schema": json.loads(frame.schema.json())} | signed)

    def read(self, step: str) -> DataFrame:
        """A committed step, columns in the order of its frame. Anything else is never read."""
        done = self.committed(step)
        if done is None:
            raise LookupError(f"{step} is not committed")
        schema = _schema(done)
        return self.spark.read.schema(schema).parquet(self._folder(step, done["attempt"])).select(schema.names)

    def table(self, step: str, frame: DataFrame, partition_by: list[str] = ()) -> DataFrame:
        """The step as a stored frame, written if need be; what a flow puts between its steps."""
        self.publish(step, frame, partition_by)
        return self.read(step)

    def load(self, step: str, frame: DataFrame, values: list, bucket: str | Column = "bucket") -> dict[str, list]:
        """Load buckets one at a time, each with a commit of its own; buckets that are committed are skipped.

        A source that is partitioned by the bucket is read once in all, as each job reads its own partition. Every row must be in one of
        `values`, which is the caller's list (a null bucket is a value, None); others are not loaded.
        """
        by = F.col(bucket) if isinstance(bucket, str) else bucket
        told: dict[str, list] = {"loaded": [], "skipped": []}
        for v in values:
            key = f"{step}/{_bucket_name(v)}"
            told["skipped" if self.committed(key) else "loaded"].append(v)
            self.publish(key, frame.where(by.eqNullSafe(F.lit(v))))
        return told

    def loaded(self, step: str, values: list) -> DataFrame:
        """All these buckets, every one of which must be committed."""
        entries = {v: self.committed(f"{step}/{_bucket_name(v)}") for v in values}
        missing = [v for v, e in entries.items() if e is None]
        if missing or not values:
            raise LookupError(f"buckets of {step} that are not committed: {missing}")
        schema = _schema(entries[values[0]])
        return self.spark.read.schema(schema).parquet(*[self._folder(f"{step}/{_bucket_name(v)}", e["attempt"]) for v, e in entries.items()])


def _schema(entry: dict) -> StructType:
    return StructType.fromJson(entry["schema"])


def _bucket_name(value) -> str:
    """A folder for a value of any kind; 1 and '1' are two."""
    return "bucket-" + hashlib.sha256(repr(value).encode()).hexdigest()[:20]
