"""Bucketed tables: the same rows, joins without an exchange of the stored side, lookups of one bucket."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from tessel.operators import graph as G
from tessel.operators import lookups as K
from tessel.sources import bucketed as B


@pytest.fixture
def plain_joins(spark):
    """Sort-merge joins, and plans as they are first made."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def shown_buckets(spark):
    """Plans that name the buckets they read; without, files of other buckets are passed over likewise, but the plan does not say so."""
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def name():
    return f"t_{uuid.uuid4().hex}"


def exchanges(frame):
    """Keys of each exchange of the plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Exchange (?:hashpartitioning|SinglePartition|rangepartitioning)\(?([^()]*), \d+\)", plan)]


def members(spark, n, shift, first):
    uid = F.concat(F.lit("u"), "id")
    group = F.floor((F.col("id") + shift) / 15).cast("long") + first
    return spark.range(n).select(uid.alias("uid"), group.alias("group_id"), F.lit(0).cast("long").alias("household_id"), (group % 2 == 0).alias("stable"), F.lit("X").alias("reason"))


@pytest.fixture
def edges(spark):
    return spark.range(900).select(F.concat(F.lit("u"), "id").alias("uid1"), F.concat(F.lit("u"), (F.col("id") * 7 + 3) % 997).alias("uid2"), (F.col("id") % 5 + 1).cast("double").alias("weight")).where("uid1 < uid2")


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_align_exchanges_no_claims(spark, plain_joins, name, tmp_path):
    a, b = members(spark, 600, 0, 1000), members(spark, 500, 4, 5000)
    sa, sb = B.stage_claims(a, f"{name}a", 8, str(tmp_path / "a")), B.stage_claims(b, f"{name}b", 8, str(tmp_path / "b"))
    staged = G.align(sa, sb)
    assert not any(e == "uid" for e in exchanges(staged)) and exchanges(G.align(a, b)).count("uid") == 2
    assert rows(staged) == rows(G.align(a, b)) != []
    mapping = G.align(a, b)
    moved = G.output_alignment(sa, sb, G.align(sa, sb), "J")
    assert not any(e == "uid" for e in exchanges(moved)) and rows(moved) == rows(G.output_alignment(a, b, mapping, "J"))


def test_propagate_exchanges_neither_edges_nor_members(spark, plain_joins, edges, name, tmp_path):
    own = members(spark, 400, 0, 1000)
    stored, both = B.stage_claims(own, f"{name}m", 8, str(tmp_path / "m")), B.stage_edges(edges, f"{name}e", 8, str(tmp_path / "e"))
    staged, plain = G.propagate(stored, both, both_ways=True), G.propagate(own, edges)
    assert "uid2" not in exchanges(staged) and "uid2" in exchanges(plain)
    assert rows(staged) == rows(plain) != []
    # what is left is the sums, which are combined before they move, and the winners of each group
    assert len(exchanges(staged)) < len(exchanges(plain))


def test_remainder_moves_edges_for_their_second_end_alone(spark, plain_joins, edges, name, tmp_path):
    done, geo = members(spark, 200, 0, 1), spark.range(1000).select(F.concat(F.lit("u"), "id").alias("uid"), F.concat(F.lit("G"), F.col("id") % 3).alias("geo"))
    by_first = B.write_bucketed(edges, f"{name}e", ["uid1"], 8, str(tmp_path / "e"))
    sd, sg = B.stage_claims(done, f"{name}d", 8, str(tmp_path / "d")), B.stage_claims(geo, f"{name}g", 8, str(tmp_path / "g"))
    staged = G.remainder(by_first, sd, sg)
    plain = G.remainder(edges, done, geo)
    # the open uids with their geos, and the edges once, for their second end
    assert len(exchanges(staged)) == 2 and all("uid2" in e for e in exchanges(staged)) and len(exchanges(plain)) > 2
    assert rows(staged) == rows(plain) != []
    twice = geo.unionAll(geo.where("uid = 'u900'").withColumn("geo", F.lit("G9")))
    ends = {(r.uid, r.geo) for r in twice.collect()} - {(r.uid, g) for r in done.collect() for g in ("G0", "G1", "G2", "G9")}
    want = [(e.uid1, e.uid2, e.weight, g) for e in edges.collect() for g in ("G0", "G1", "G2", "G9") if {(e.uid1, g), (e.uid2, g)} <= ends]
    assert sorted(map(tuple, G.remainder(edges, done, twice).collect())) == sorted(want)


def test_a_lookup_reads_one_bucket(spark, name, tmp_path, shown_buckets):
    published = members(spark, 300, 0, 100).select("uid", F.concat(F.lit("S_"), "group_id").alias("group_id"), F.when(F.col("group_id") < 110, "H1").otherwise("").alias("household_id"))
    stored = B.store_lookups(published, name, str(tmp_path / "l"), 5)
    again = B.open_lookups(spark, name)
    assert rows(stored.match) == rows(K.match_lookup(published)) and rows(again.uid) == rows(K.uid_lookup(published, 5)) and again.household.count() == 0
    one = again.members("NS_S_101")
    assert "SelectedBucketsCount: 1 out of 32" in one._jdf.queryExecution().executedPlan().toString()
    assert rows(one) == rows(published.where("group_id = 'S_101'").select("uid")) and len(rows(one)) == 15
    assert "SelectedBucketsCount: 1 out of 32" in again.graphids("u7")._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in again.graphids("u7").collect()] == ["NS_S_100"] or "NSH_H1" in rows(again.graphids("u7"))[0]
    assert again.members("NSH_none").count() == again.graphids("nobody").count() == 0


def test_null_keys_and_empty_tables(spark, name, tmp_path):
    odd = spark.createDataFrame([(None, 1), (None, 1), ("a", 2)], "uid string, n int")
    assert rows(B.write_bucketed(odd, name, ["uid"], 4, str(tmp_path / "o"))) == rows(odd)
    assert B.write_bucketed(odd.limit(0), f"{name}0", ["uid"], 4, str(tmp_path / "n")).count() == 0
    with pytest.raises(Exception, match="already exists"):
        B.write_bucketed(odd, name, ["uid"], 4)
    assert [B.buckets_for(n, 100) for n in (0, 100, 101, 250, 100_000)] == [1, 1, 2, 4, 1024]
