"""Group quality: coverage, samples, distributions, purity; the daily state lookup; flow metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.text import crc_bucket, sample_bucket
from tessel.operators.relational import fingerprint, mode, running_sums
from tessel.session import materialise


def group_coverage(claims: DataFrame, active: DataFrame) -> DataFrame:
    """Per group its members and how many were active."""
    seen = active.select("uid").distinct().withColumn("_a", F.lit(1))
    return claims.select("group_id", "uid").distinct().join(seen, "uid", "left").groupBy("group_id").agg(F.count("*").alias("members"), F.count("_a").alias("active"))


def count_combinations(coverage: DataFrame) -> DataFrame:
    """Groups by (members, active): a small table that keeps all that distributions need."""
    return coverage.groupBy("members", "active").agg(F.count("*").alias("groups"))


def eligible(coverage: DataFrame, intercept: float, size: float, cap: int) -> DataFrame:
    """Groups under a line of coverage by size, or fully covered small ones; at least one member active."""
    share = 100.0 * F.col("active") / F.col("members")
    n = F.col("members")
    return coverage.where(((share <= intercept * (1 - n / size)) | ((share > 95) & (n < size))) & (F.col("active") >= 1) & (n < cap))


def star_sample(claims: DataFrame, share: float) -> DataFrame:
    """All rows of a deterministic sample of groups; a smaller share gives a part of a larger one."""
    return claims.where(sample_bucket(F.col("group_id")) < int(share * 16**6))


def weighted_ecdf(values: DataFrame, value: str, weight: str) -> DataFrame:
    """Cumulative share of weight at each distinct value."""
    sums = values.groupBy(value).agg(F.sum(weight).alias("w"))
    run = materialise(running_sums(sums, value, ["w"]))
    return run.crossJoin(F.broadcast(run.agg(F.max("w").alias("t")))).select(value, (F.col("w") / F.col("t")).alias("ecdf"))


def _run_of_both(a: DataFrame, b: DataFrame, value: str, weight: str) -> DataFrame:
    both = a.groupBy(value).agg(F.sum(weight).alias("a")).join(b.groupBy(value).agg(F.sum(weight).alias("b")), value, "full").fillna(0, ["a", "b"])
    run = materialise(running_sums(both, value, ["a", "b"]))
    return run.crossJoin(F.broadcast(run.agg(F.max("a").alias("ta"), F.max("b").alias("tb"))))


def ecdf_gap(a: DataFrame, b: DataFrame, value: str, weight: str) -> DataFrame:
    """The largest distance of two distributions' cumulative shares. Null if either is empty."""
    share = lambda x: F.col(x) / F.nullif(F.col(f"t{x}"), F.lit(0))
    return _run_of_both(a, b, value, weight).agg(F.max(F.abs(share("a") - share("b"))).alias("gap"))


def compare_distributions(population: DataFrame, sample: DataFrame, value: str, weight: str, tolerances: dict[str, float]) -> DataFrame:
    """Mean, total variation and largest ECDF gap of a sample against its population, and whether each is within its tolerance."""
    share = lambda frame, name: frame.groupBy(value).agg(F.sum(weight).alias(name))
    both = share(population, "a").join(share(sample, "b"), value, "full").fillna(0, ["a", "b"])
    whole = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    sums = both.crossJoin(F.broadcast(whole)).agg(
        (F.abs(F.sum(F.col(value) * F.col("a") / F.col("ta")) - F.sum(F.col(value) * F.col("b") / F.col("tb")))).alias("mean_gap"),
        (F.sum(F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb"))) / 2).alias("total_variation"))
    out = sums.crossJoin(F.broadcast(ecdf_gap(population, sample, value, weight).withColumnRenamed("gap", "ecdf_gap")))
    return out.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), (F.col(m) <= t).alias("within")) for m, t in tolerances.items()])))


def purity(members: DataFrame) -> DataFrame:
    """Members (group_id, uid, candidate): each uid's vote is shared by its candidates; purity is the strongest candidate's share."""
    n = members.select("group_id", "uid", "candidate").distinct()
    votes = n.join(n.groupBy("group_id", "uid").agg(F.count("*").alias("n")), ["group_id", "uid"])
    support = votes.groupBy("group_id", "candidate").agg(F.sum(1.0 / F.col("n")).alias("support"))
    return support.groupBy("group_id").agg(F.max("support").alias("dominant"), F.sum("support").alias("total"), F.count("*").alias("candidates")).withColumn("purity", F.col("dominant") / F.col("total"))


def fan_out(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with no, one and many values."""
    n = pairs.groupBy(key).agg(F.countDistinct(value).alias("n"))
    return n.groupBy(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many").alias("fan_out")).agg(F.count("*").alias("keys"))


def majority_map(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """A key's most frequent value and its share."""
    return mode(pairs, [key], value).select(key, value, (F.col("n") / F.col("total")).alias("share"))


def bucket_signatures(frame: DataFrame, uid: str, by: list[str], buckets: int = 16) -> DataFrame:
    """Rows and fingerprint of each bucket, to load and verify bucket by bucket."""
    return fingerprint(frame.withColumn("bucket", crc_bucket(F.col(uid), buckets)), [*by, "bucket"])


def newest_days(frame: DataFrame, day: str, n: int = 7) -> DataFrame:
    """Rows of the newest n days that occur."""
    days = frame.select(day).distinct().orderBy(F.desc(day)).limit(n)
    return frame.join(F.broadcast(days), day, "left_semi")


def representation(source: DataFrame, staged: DataFrame) -> DataFrame:
    """Source claims whose uid is staged in the same group, only in others, or not at all; by union and grouping, not a join
    of two bags."""
    a = source.select("uid", "group_id", F.lit(1).alias("s"), F.lit(0).alias("t"))
    b = staged.select("uid", "group_id", F.lit(0).alias("s"), F.lit(1).alias("t"))
    pairs = a.unionByName(b).groupBy("uid", "group_id").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    per = pairs.groupBy("uid").agg(F.max("s").alias("s"), F.max("t").alias("t"), F.max(F.col("s") * F.col("t")).alias("same"))
    kind = F.when(F.col("same") == 1, "same_id").when(F.col("t") == 1, "reassigned_only").otherwise("unrepresented")
    return per.where("s = 1").groupBy(kind.alias("representation")).agg(F.count("*").alias("uids"))


def membership_atoms(sources: dict[str, DataFrame], final: DataFrame) -> DataFrame:
    """Uids by which sources have them (a bit each) and by their final reason."""
    rows = None
    for k, frame in enumerate(sources.values()):
        part = frame.select("uid", F.lit(1 << k).alias("mask"), F.lit(None).cast("string").alias("reason"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.unionByName(final.select("uid", F.lit(0).alias("mask"), "reason"))
    per = rows.groupBy("uid").agg(F.bit_or("mask").alias("mask"), F.count_distinct("reason").alias("n"), F.max("reason").alias("reason"))
    label = F.when(F.col("n") == 0, "unrepresented").when(F.col("n") == 1, F.col("reason")).otherwise("multiple_reasons")
    return per.groupBy("mask", label.alias("reason")).agg(F.count("*").alias("uids"))


def stage_metrics(staged: DataFrame) -> DataFrame:
    """Groups, uids and rows by stage and reason, by stage, and in all, from one scan."""
    return staged.groupingSets([["stage", "reason"], ["stage"], []], "stage", "reason").agg(
        F.grouping("stage").cast("int").alias("all_stages"), F.grouping("reason").cast("int").alias("all_reasons"),
        F.countDistinct("group_id").alias("group_ids"), F.countDistinct("uid").alias("uids"), F.count("*").alias("rows"))


def graph_size(edges: DataFrame) -> DataFrame:
    """M06"""
    return edges.select(F.explode(F.array("uid1", "uid2")).alias("uid"), F.lit(1).alias("x")).agg(F.countDistinct("uid").alias("uids"), F.expr("count(*) div 2").alias("relationships"))


def source_counts(claims: dict[str, DataFrame]) -> DataFrame:
    """Groups, uids and rows of each source, exact."""
    out = None
    for name, frame in claims.items():
        one = frame.agg(F.countDistinct("group_id").alias("group_ids"), F.countDistinct("uid").alias("uids"), F.count("*").alias("rows")).select(F.lit(name).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def stage_publication(staged: DataFrame, final: DataFrame) -> DataFrame:
    """Of each stage's assignments how many (by uid and published group) are in the final result; by union and grouping. Stages overlap,
    so that they do not add up to the final total. staged: stage, uid, group_id, stable; final: uid, group_id as published."""
    named = F.concat(F.when(F.col("stable"), "S_").otherwise(""), F.col("group_id").cast("string"))
    rows = staged.select("uid", named.alias("group_id"), "stage", F.lit(False).alias("published")).unionByName(final.select("uid", "group_id", F.lit(None).cast("string").alias("stage"), F.lit(True).alias("published")))
    per = rows.groupBy("uid", "group_id").agg(F.collect_set("stage").alias("stages"), F.bool_or("published").alias("published"))
    return per.select("group_id", F.explode("stages").alias("stage"), "published").groupBy("stage", "published").agg(F.countDistinct("group_id").alias("group_ids"), F.count("*").alias("assignments"))


def flow_table(metrics: DataFrame, order: list[str]) -> DataFrame:
    """Checkpoints (checkpoint, group_ids, rows) in their order, with the change from the one before and the share of the first that is left."""
    known = F.array(*map(F.lit, order))
    rows = metrics.withColumn("position", F.array_position(known, F.col("checkpoint"))).where("position > 0")
    w = W.orderBy("position")  # a row for each checkpoint
    first = F.first("group_ids").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.select("checkpoint", "group_ids", "rows", (F.col("group_ids") - F.lag("group_ids").over(w)).alias("change"), (F.col("group_ids") / F.nullif(first, F.lit(0))).alias("retained"))


def day_audit(rows: DataFrame) -> DataFrame:
    """Rows, nulls and fingerprint of each day of (day, uid, state)."""
    counts = rows.groupBy("day").agg(F.count("*").alias("rows"), F.count_if(F.col("uid").isNull()).alias("null_uids"), F.count_if(F.col("state").isNull()).alias("null_states"))
    return counts.join(fingerprint(rows.select("day", "uid", "state"), ["day"]).drop("rows"), "day")


def audit_manifest(source: DataFrame, target: DataFrame) -> DataFrame:
    """Whether every day of either side is on both with equal counts and fingerprints."""
    a, b = day_audit(source), day_audit(target)
    both = a.select("day", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "day"]).join(b.select("day", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "day"]), "day", "full")
    same = F.lit(True)
    for c in a.columns:
        if c != "day":
            same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return both.select("day", F.col("a_rows").alias("source_rows"), F.col("b_rows").alias("target_rows"), same.alias("verified"))
