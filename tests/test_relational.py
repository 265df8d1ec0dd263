"""Operators that hold no key whole, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from tessel.operators.coverage import fan_out
from tessel.operators.relational import compare_clusterings, exact_percentiles


def test_percentiles_of_hot_and_null_keys(spark):
    random.seed(5)
    rows = [(random.choice(["hot"] * 8 + ["b", None]), random.choice([None, *range(200)])) for _ in range(3000)] + [("one", 7), ("none", None)]
    got = exact_percentiles(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", {"p5": 0.05, "p50": 0.5, "p100": 1.0})
    want = {}
    for key in {k for k, v in rows if v is not None}:
        own = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = tuple(own[math.ceil(len(own) * s) - 1] for s in (0.05, 0.5, 1.0))
    assert {r.k: (r.p5, r.p50, r.p100) for r in got.collect()} == want
    whole = exact_percentiles(spark.createDataFrame(rows, "k string, v int"), [], "v", {"p50": 0.5}).collect()
    own = sorted(v for _, v in rows if v is not None)
    assert [r.p50 for r in whole] == [own[math.ceil(len(own) / 2) - 1]]


def test_renamed_groups_are_equal(spark):
    make = lambda groups: spark.createDataFrame([(g, u) for g, us in groups.items() for u in us], "group_id int, uid string")
    left, right = make({1: "abc", 2: "de", 3: "f"}), make({9: "abc", 2: "d", 3: "ef"})
    got = {r.kind: (r.differing, r.left_only, r.right_only) for r in compare_clusterings(left, right).collect()}
    assert got == {"strict": (8, 4, 4), "structural": (6, 3, 3)}


def test_distinct_counts_of_a_constant_key_are_dealt_out_by_value(spark):
    """Values are made distinct by (key, value) and only counts go by key, so a key of all rows is spread over tasks."""
    frame = spark.range(1000).select(F.lit("s").alias("k"), (F.col("id") % 300).alias("v"))
    counted = fan_out(frame.withColumn("k", F.concat("k", (F.col("v") % 1).cast("string"))), "k", "v")
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert [line for line in text.splitlines() if "hashpartitioning(k#" in line and ", v#" in line.split("hashpartitioning")[1]]
    assert [tuple(r) for r in counted.collect()] == [("many", 1)]
