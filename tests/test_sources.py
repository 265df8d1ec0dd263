"""Publication, partitions, bucket loads, catalog, exports and daily runs."""

import glob
import os
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessel.operators import coverage as C
from tessel.sources import catalog as K
from tessel.sources import publish as P
from tessel.streaming import hourly


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(k, f"u{k % 7}", None if k % 5 == 0 else "NY") for k in range(40)], "day long, uid string, state string")


def test_versions_stay_and_are_verified(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one, two = P.publish_version(frame, path), P.publish_version(frame.limit(3).coalesce(1), path, ["state"])
    assert (one["number"], two["number"], one["rows"]) == (0, 1, 40)
    assert P.read_version(spark, path).count() == 3 and P.read_version(spark, path, one["version"]).count() == 40
    with pytest.raises(LookupError):
        P.read_version(spark, path, "none")
    with pytest.raises(ValueError):  # rows that are not the same when they are read again
        P.publish_version(frame.withColumn("x", F.udf(lambda: uuid.uuid4().hex).asNondeterministic()()), path)
    assert len(P.versions(spark, path)) == 2 and P.read_version(spark, path).count() == 3  # the attempt is not committed
    monkeypatch.setattr(P, "versions", lambda *_: [])  # a writer that has not seen the others
    assert P.publish_version(frame, path)["number"] == 2


def test_partitions_are_replaced(spark, frame, tmp_path):
    path = str(tmp_path / "p")
    P.replace_partitions(frame.withColumn("day", F.col("day") % 3), path, ["day"])
    again = spark.createDataFrame([("x", "CA", 1)], "uid string, state string, day long")
    for _ in range(2):
        P.replace_partitions(again, path, ["day"])
    stored = spark.read.parquet(path)
    assert stored.where("day = 1").count() == 1 and stored.where("day <> 1").count() == 27 and K.partition_days(spark, path) == ["0", "1", "2"]


def test_bucket_load_resumes_and_refuses(spark, frame, tmp_path):
    path, rows = str(tmp_path / "b"), frame.withColumn("bucket", F.col("day") % 4).select("day", "uid", "state", "bucket")
    assert P.load_buckets(rows.where("bucket < 2"), path) == {"loaded": [0, 1], "skipped": []}  # a run that was killed after two buckets
    assert P.load_buckets(rows, path) == {"loaded": [2, 3], "skipped": [0, 1]}
    assert P.load_buckets(rows, path) == {"loaded": [], "skipped": [0, 1, 2, 3]} and spark.read.parquet(path).count() == 40
    with pytest.raises(ValueError):
        P.load_buckets(rows.withColumn("uid", F.lit("other")), path)
    assert C.bucket_signatures(frame, "uid", ["state"]).agg(F.sum("rows")).first()[0] == 40


def test_schema_is_declared(frame):
    assert P.check_schema(frame, {"day": "bigint", "uid": "string", "state": "string"}) is frame
    with pytest.raises(TypeError):
        P.check_schema(frame, {"day": "bigint", "uid": "string"})


def test_day_audit(spark, frame):
    audit = C.audit_manifest(frame, frame.repartition(3))
    assert audit.where("not verified").count() == 0 and audit.count() == 40
    other = frame.withColumn("state", F.when(F.col("day") == 3, "TX").otherwise(F.col("state"))).where("day <> 4")
    assert {r.day for r in C.audit_manifest(frame, other).where("not verified").collect()} == {3, 4}


def test_catalog(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "raw"))
    c = K.Catalog(spark, {"raw": str(tmp_path / "raw")})
    c.model("staged", lambda c: c.source("raw").withColumn("clean", F.trim("uid")))
    c.model("counts", lambda c: c.ref("staged").groupBy("clean").count())
    c.model("final", lambda c: c.ref("counts").join(c.ref("staged"), "clean"))
    c.model("a", lambda c: c.ref("b"))
    c.model("b", lambda c: c.ref("a"))
    assert c.ref("final").count() == 40 and c.plan("final") == ["staged", "counts", "final"]
    for wrong, f in ((LookupError, lambda: c.source("other")), (LookupError, lambda: c.ref("none")), (ValueError, lambda: c.ref("a"))):
        with pytest.raises(wrong):
            f()


def test_seed_must_be_rectangular(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("nickname,canonical\nJON,JONATHAN|JOHN\n")
    bad.write_text("nickname,canonical\nJON\n")
    assert [tuple(r) for r in K.seed(spark, str(good)).collect()] == [("JON", "JONATHAN|JOHN")]
    with pytest.raises(ValueError):
        K.seed(spark, str(bad))


def test_exports(spark, frame, tmp_path):
    K.export_by_key(frame, str(tmp_path / "e"), "uid", 3)
    files = glob.glob(f"{tmp_path}/e/uid_key=*/*.parquet")
    assert len({os.path.dirname(f) for f in files}) == 7 and len(files) >= 14 and spark.read.parquet(str(tmp_path / "e")).count() == 40
    manifest = K.write_with_digest(frame.repartition(3), str(tmp_path / "d"))
    assert len(manifest["parts"]) == 3 and K.check_digest(spark, str(tmp_path / "d"))
    with open(sorted(glob.glob(f"{tmp_path}/d/*.parquet"))[0], "ab") as f:
        f.write(b"x")
    for crc in glob.glob(f"{tmp_path}/d/.*.crc"):
        os.remove(crc)
    assert not K.check_digest(spark, str(tmp_path / "d"))
    assert [len(b) for b in K.stream_batches(frame, 15)] == [15, 15, 10]
    assert K.report(frame.groupBy("state").count().orderBy("state"), "States").count("\n") == 5
    K.publish_view(frame, "published")
    assert K.read_only(spark, "SELECT * FROM published WHERE uid = :u", u="u1").count() == 6
    counted = K.batches_by_key(frame, "uid", lambda t: t.group_by("uid").aggregate([("day", "sum")]).rename_columns(["uid", "total"]), "uid string, total long")
    assert counted.count() == 7


def test_guards(spark):
    with pytest.raises(PermissionError):
        K.read_only(spark, "DROP TABLE x")
    assert K.guarded_path("/data/own/x", "/data/own") == "/data/own/x"
    for path in ("/data/other/x", "/data/own/../x"):
        with pytest.raises(PermissionError):
            K.guarded_path(path, "/data/own")


def test_day_runs(spark, tmp_path):
    runs, built = K.DayRuns(spark, str(tmp_path / "s"), ["source", "final"]), []
    build = lambda day, have: built.append((day, have))
    assert runs.state("d1") is None and runs.run("d1", {"source", "final"}, build) == "complete" and runs.run("d1", {"source", "final"}, build) == "skipped"
    assert runs.run("d1", {"source", "final"}, build, force=True) == "complete" and runs.run("d2", {"final"}, build) == "partial" and runs.state("d2")["missing"] == ["source"]
    with pytest.raises(ZeroDivisionError):
        runs.run("d3", {"final"}, lambda *_: 1 / 0)
    assert runs.state("d3")["state"] == "failed" and "ZeroDivisionError" in runs.state("d3")["error"]
    assert runs.backfill({"d3": {"final"}, "d2": {"final"}, "d0": {"final", "source"}, "d9": {"source"}}, build, 2) == [("d2", "skipped"), ("d3", "partial")]
    assert built == [("d1", ["source", "final"])] * 2 + [("d2", ["final"]), ("d3", ["final"])]


def test_hourly_stream_leaves_late_rows(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(datetime(2024, 1, 1, h, 5), k, u) for h, k, u in r], "ts timestamp, key string, uid string")
    path = str(tmp_path / "in")
    rows((1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (9, "a", "x")).coalesce(1).write.mode("append").parquet(path)
    stream = hourly.hourly_counts(spark.readStream.schema("ts timestamp, key string, uid string").parquet(path))

    sink = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    sink()
    rows((2, "a", "late"), (6, "a", "z"), (20, "a", "w")).coalesce(1).write.mode("append").parquet(path)
    sink()
    got = {r.window.start.hour: (r.uids, r.rows) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == (2, 3) and 2 not in got and got.get(6) == (1, 1) and got.get(9) == (1, 1)
