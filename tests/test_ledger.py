"""Runs that are cut off at every step, and go on."""

import pytest
from pyspark.sql import functions as F

from tessel.operators.relational import fingerprint
from tessel.sources import ledger as L


class Killed(BaseException):
    pass


@pytest.fixture
def frame(spark):
    return spark.range(1000).select("id", (F.col("id") % 16).cast("int").alias("bucket"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("u"), "id")).alias("uid"))


def signed(frame):
    row = fingerprint(frame).first()
    return row["rows"], str(int(row["fingerprint"]))


@pytest.fixture
def writes(monkeypatch):
    """Folders written, in order."""
    seen, write = [], L.write_observed

    def spy(frame, path, partition_by=()):
        seen.append(path)
        return write(frame, path, partition_by)

    monkeypatch.setattr(L, "write_observed", spy)
    return seen


def test_inputs_never_change(spark, tmp_path):
    L.Run(spark, str(tmp_path), "r", {"claims": "v1"}, "sample")
    again = L.Run(spark, str(tmp_path), "r")
    assert again.config == {"inputs": {"claims": "v1"}, "profile": "sample"}
    for inputs, profile in (({"claims": "v2"}, "sample"), ({}, "sample"), ({"claims": "v1"}, "full")):
        with pytest.raises(L.Refused):
            L.Run(spark, str(tmp_path), "r", inputs, profile)
    with pytest.raises(ValueError):
        L.Run(spark, str(tmp_path), "../r")


def test_a_committed_step_is_not_written_again(spark, frame, tmp_path, writes):
    run = L.Run(spark, str(tmp_path), "r", {})
    one = run.publish("s", frame, ["bucket"])
    rebuilt = spark.range(1000).select("id", (F.col("id") % 16).cast("int").alias("bucket"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("u"), "id")).alias("uid"))
    assert L.Run(spark, str(tmp_path), "r").publish("s", rebuilt, ["bucket"]) == one and len(writes) == 1
    assert (one["rows"], one["fingerprint"]) == signed(run.read("s")) == signed(frame) and run.read("s").columns == frame.columns
    for other, by in ((frame.where("id <> 5"), ["bucket"]), (frame, [])):
        with pytest.raises(L.Refused):
            run.publish("s", other, by)
    with pytest.raises(LookupError):
        run.read("t")
    assert len(writes) == 1


@pytest.mark.parametrize("step", ["before the intent", "before the write", "within the write", "before the commit", "after the commit"])
def test_killed_at_every_step(spark, frame, tmp_path, monkeypatch, writes, step):
    run, put, write = L.Run(spark, str(tmp_path), "r", {}), L.Run._put, L.write_observed

    def cut_put(self, name, entry):
        if step == "before the intent" and "intent" in name or step == "before the commit" and "commit" in name:
            raise Killed
        found = put(self, name, entry)
        if step == "after the commit" and "commit" in name:
            raise Killed
        return found

    def cut_write(frame, path, partition_by=()):
        if step == "within the write":
            frame.limit(3).write.parquet(f"{path}/part")  # files of a job that did not end
        if step in ("before the write", "within the write"):
            raise Killed
        return write(frame, path, partition_by)

    with monkeypatch.context() as m:
        m.setattr(L.Run, "_put", cut_put)
        m.setattr(L, "write_observed", cut_write)
        with pytest.raises(Killed):
            run.publish("s", frame)
        assert (run.committed("s") is not None) == (step == "after the commit")
    before = len(writes)
    again = L.Run(spark, str(tmp_path), "r")
    with pytest.raises(L.Refused) if step != "before the intent" else pytest.raises(LookupError):
        again.publish("s", frame.where("id > 1")) if step != "before the intent" else again.read("s")
    entry = again.publish("s", frame)
    assert (entry["rows"], entry["fingerprint"]) == signed(frame) == signed(again.read("s"))
    # what was stored before is settled by what it holds, not written again
    assert len(writes) - before == (0 if step in ("before the commit", "after the commit") else 1)
    assert entry["attempt"] == (2 if step in ("before the write", "within the write") else 1)


def test_of_two_writers_one_commits(spark, frame, tmp_path, monkeypatch):
    one, two, write = L.Run(spark, str(tmp_path), "r", {}), L.Run(spark, str(tmp_path), "r"), L.write_observed
    met = []

    def slow(frame, path, partition_by=()):
        if not met:  # the other writer comes and goes while this one writes
            met.append(path)
            met.append(two.publish("s", frame))
        return write(frame, path, partition_by)

    monkeypatch.setattr(L, "write_observed", slow)
    assert one.publish("s", frame) == met[1] and met[1]["attempt"] == 2
    assert signed(one.read("s")) == signed(frame)


def test_a_load_goes_on_after_seven_buckets(spark, frame, tmp_path, monkeypatch, writes):
    frame.write.partitionBy("bucket").parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    run, publish = L.Run(spark, str(tmp_path), "r", {}), L.Run.publish

    def cut(self, step, frame, partition_by=()):
        if len(writes) == 7:
            raise Killed
        return publish(self, step, frame, partition_by)

    with monkeypatch.context() as m:
        m.setattr(L.Run, "publish", cut)
        with pytest.raises(Killed):
            run.load("s", source, list(range(16)))
    with pytest.raises(LookupError):
        run.loaded("s", list(range(16)))
    told = L.Run(spark, str(tmp_path), "r").load("s", source, list(range(16)))
    assert told == {"loaded": list(range(7, 16)), "skipped": list(range(7))} and len(writes) == 16
    assert signed(run.loaded("s", list(range(16))).select(frame.columns)) == signed(frame)
    assert run.load("s", source, list(range(16)))["loaded"] == [] and len(writes) == 16


def test_empty_and_null_rows(spark, frame, tmp_path):
    run = L.Run(spark, str(tmp_path), "r", {})
    assert run.publish("none", frame.where("id < 0"))["rows"] == 0 and run.read("none").count() == 0
    odd = spark.createDataFrame([(None, None), (None, None), (1, "x")], "bucket int, uid string")
    run.load("s", odd, [None, 1])
    assert sorted(map(tuple, run.loaded("s", [None, 1]).collect()), key=str) == [(1, "x"), (None, None), (None, None)]
    assert run.committed(f"s/{L._bucket_name(None)}")["rows"] == 2


def test_the_frame_runs_once(spark, frame, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    L.write_observed(frame.mapInArrow(count, frame.schema), str(tmp_path / "t"))
    assert passes.value == 1000
