"""Agreement keys against the comparison of all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import agreement as B
from tessel.operators import links as L
from tessel.operators import names as A

FIRST = ["JON", "JONATHAN", "JOHNATHAN", "ANN", "ANNA MARIA", "MARIA", "BOB", "ROBERT", "ROBERTA", "ROB", "LI", "LIZ", "ELIZABETH", "ELISABETH", "J"]
LAST = ["SMITH", "SMYTH", "SMITHE", "SMITH-JONES", "JONES", "VAN DYKE", "VANDYKE", "KOWALCZYK", "KOWALCYK", "KOVALCYK", "BROWN", "BROWNE", "BRONW", "ONEIL", "LI"]
VARIANTS = {"JON": ["JONATHAN"], "BOB": ["ROBERT"], "ROBERT": ["BOB"], "LIZ": ["ELIZABETH"]}
NAME = "struct<first_name: string, last_name: string, first_variants: array<string>>"


def name(first, last):
    return (first, last, sorted({first, *VARIANTS.get(first.split(" ")[0], [])}))


def test_close_strings_are_all_pairs_within_their_edits(spark):
    draw = random.Random(4)
    words = {"".join(draw.choice("AB") for _ in range(draw.randint(3, 10))) for _ in range(150)}
    frame = spark.createDataFrame([(w,) for w in words], "s string")
    pairs = frame.crossJoin(frame.withColumnRenamed("s", "other")).where((F.col("s") != F.col("other")) & T.edit_close(F.col("s"), F.col("other")))
    want = {tuple(r) for r in pairs.collect()}
    assert want and {tuple(r) for r in B.close_strings(frame).collect()} == want


def test_names_agree_just_where_keys_meet(spark):
    names = [name(f, s) for f, s in itertools.product(FIRST, LAST)]
    frame = spark.createDataFrame([(n,) for n in names], f"n {NAME}")
    other = frame.withColumnRenamed("n", "m")
    want = {tuple(r) for r in frame.crossJoin(other).where(~A.disagree(F.col("n"), F.col("m"))).select("n.first_name", "n.last_name", "m.first_name", "m.last_name").collect()}
    held = {}
    for r in B.agreement_keys(frame).collect():
        held.setdefault((r.last_key, r.first_key), []).append((r.n.first_name, r.n.last_name, r.last_full, r.first_full))
    got = {(*a[:2], *b[:2]) for rows in held.values() for a in rows for b in rows if (a[2] or b[2]) and (a[3] or b[3])}
    assert got == want and len(want) > len(names)


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_are_those_of_all_peers(spark, seed):
    draw = random.Random(seed)
    links, values = [], []
    for e, k in itertools.product(range(25), range(4)):
        key = ("s", f"e{e}", f"n{k}")
        links.append((*key, sorted(draw.sample(["2024-01-01", "2024-01-02", "2024-01-03"], draw.randint(0, 2))), True))
        vals = [name(draw.choice(FIRST[:8]), draw.choice(LAST[:7])) for _ in range(draw.choice([0, 1, 1, 2]))]
        if draw.random() > 0.1:
            values.append((*key, vals or draw.choice([None, []])))
    linked = spark.createDataFrame(links, "source string, email string, npi string, conflict_days array<string>, has_conflict_linkage boolean").withColumn("conflict_days", F.col("conflict_days").cast("array<date>"))
    names = spark.createDataFrame(values, f"source string, email string, npi string, vals array<{NAME}>")
    want = {(r.email, r.npi): r.shares for r in L.conflict_peers(linked, names, A.any_alike).collect()}
    assert {(r.email, r.npi): r.shares for r in B.conflict_name_shares(linked, names).collect()} == want
    assert {True, False, None} == set(want.values())


def test_an_email_of_many_npis_takes_no_pairs(spark):
    """3,000 npis of one e-mail-day: 9 million pairs; here no operator makes more than a few hundred rows for each."""
    rows = [("s", "hot", f"n{k:04}", ["2024-01-01"], True, [(f"A{k % 50:02}X", f"Q{k * 7919:09}Z".translate(str.maketrans("0123456789", "ABCDEFGHIJ")), [f"A{k % 50:02}X"])]) for k in range(3000)]
    frame = spark.createDataFrame(rows, f"source string, email string, npi string, conflict_days array<string>, has boolean, vals array<{NAME}>").withColumn("conflict_days", F.col("conflict_days").cast("array<date>"))
    out = B.conflict_name_shares(frame, frame.select(*L.KEY, "vals"))
    keys = B.agreement_keys(frame.select(F.explode("vals").alias("n")).distinct()).count()
    assert out.count() == 3000 and keys < 300 * 3000
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "BroadcastNestedLoopJoin" not in plan
