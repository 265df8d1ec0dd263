"""Invariants are silent on sound evidence and find planted faults."""

from pyspark.sql import functions as F

from tessel.operators import links as L
from tessel.operators import statistics as S


def evidence(spark):
    rows = [("s", "a@x", "1", "2024-01-01"), ("s", "a@x", "2", "2024-01-02"), ("s", "b@x", "1", "2024-01-01"), ("s", "b@x", "1", "2024-01-02"), ("s", "c@x", "1", "2024-01-01"), ("s", "c@x", "2", "2024-01-01"), ("s", "d@x", "4", None)]
    seen = spark.createDataFrame(rows, "source string, email string, npi string, day string").withColumn("day", F.col("day").cast("date"))
    linked = L.links(seen)
    return seen, linked, L.email_linkage(linked)


def test_multiplicity(spark):
    _, linked, linkage = evidence(spark)
    assert S.wrong_multiplicity(linked, linkage).count() == 0
    broken = linkage.withColumn("email_npi_count", F.when(F.col("email") == "a@x", 1).otherwise(F.col("email_npi_count")))
    assert [r.email for r in S.wrong_multiplicity(linked, broken).collect()] == ["a@x"]
    assert [r.email for r in S.wrong_multiplicity(linked, linkage.where("email <> 'b@x'")).collect()] == ["b@x"]


def test_reassignment(spark):
    seen, _, linkage = evidence(spark)
    assert S.wrong_reassignment(seen, linkage).count() == 0
    broken = linkage.withColumn("has_been_reassigned", F.col("email").isin("a@x", "c@x"))
    assert [r.email for r in S.wrong_reassignment(seen, broken).collect()] == ["c@x"]


def test_stability(spark):
    _, linked, linkage = evidence(spark)
    sound = L.link_stability(L.link_conflicts(linked, linkage))
    assert S.wrong_stability(sound).count() == 0
    assert S.wrong_stability(sound.withColumn("presence_share", F.lit(1.5))).count() == sound.count()
    assert S.wrong_stability(sound.withColumn("email_day_count", F.lit(0))).count() == 5  # the dated links


def test_membership(spark):
    rows = spark.createDataFrame([("u", "1"), ("u", "1"), ("v", "1"), ("v", "2")], "uid string, group_id string")
    assert [(r.uid, r.groups) for r in S.wrong_membership(rows).collect()] == [("v", 2)]
