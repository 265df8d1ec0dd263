"""Identity graph: co-location evidence, alignment, propagation, remainder, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.operators.relational import mutual_best, top_k, union_all

CAP = 10


def observations(activity: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    """Distinct (day, key, uid) of keys with `low` to `high` uids; each key's weight 1 is shared by its N uids."""
    seen = activity.select("day", "key", "uid").distinct()
    sizes = seen.groupBy("day", "key").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    return seen.join(sizes, ["day", "key"]).withColumn("weight", 1.0 / F.col("n"))


def pair_days(obs: DataFrame) -> DataFrame:
    """Pairs of uids that share a key on a day; weights of the keys add up."""
    a, b = (obs.select("day", "key", F.col("uid").alias(f"uid{k}"), *([F.col("weight")] if k == 1 else [])) for k in (1, 2))
    return a.join(b, ["day", "key"]).where("uid1 < uid2").groupBy("day", "uid1", "uid2").agg(F.sum("weight").alias("weight"))


def lookback(pairs: DataFrame, day: str, days: int = 15, least: int = 3) -> DataFrame:
    """The last `days` days up to `day`; pairs of at least `least` days."""
    recent = pairs.where(F.col("day").between(F.date_sub(F.lit(day).cast("date"), days - 1), F.lit(day).cast("date")))
    return recent.groupBy("uid1", "uid2").agg(F.sum("weight").alias("weight"), F.count("*").alias("days")).where(F.col("days") >= least).drop("days")


def lookback_count(pairs: DataFrame, day: str, days: int = 31) -> DataFrame:
    """Number of pair rows in the last `days` days."""
    recent = pairs.where(F.col("day").between(F.date_sub(F.lit(day).cast("date"), days - 1), F.lit(day).cast("date")))
    return recent.groupBy("uid1", "uid2").agg(F.count("*").cast("double").alias("weight"))


def merge_clean(edges: list[DataFrame], k: int = CAP) -> DataFrame:
    """The greatest weight of each pair, then pairs among the k heaviest of both their ends."""
    merged = union_all([e.select("uid1", "uid2", "weight") for e in edges]).groupBy("uid1", "uid2").agg(F.max("weight").alias("weight"))
    for own, other in (("uid1", "uid2"), ("uid2", "uid1")):
        merged = merged.withColumn(f"n_{own}", F.row_number().over(W.partitionBy(own).orderBy(F.desc("weight"), F.desc(other))))
    return merged.where((F.col("n_uid1") <= k) & (F.col("n_uid2") <= k)).drop("n_uid1", "n_uid2")


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """One-to-one mapping of left groups to right groups by the number of shared claim rows."""
    a = left.select("uid", F.col("group_id").alias("left_id"))
    b = right.select("uid", F.col("group_id").alias("right_id"), "household_id", "stable", "reason")
    counts = a.join(b, "uid").groupBy("left_id", "right_id").agg(
        F.count("*").alias("cnt"), F.max("household_id").alias("household_id"), F.max("stable").alias("stable"), F.max("reason").alias("reason"))
    return mutual_best(counts, "left_id", "right_id", "cnt")


def output_alignment(left: DataFrame, right: DataFrame, mapping: DataFrame, reason: str | None = None, suffix: str = "") -> DataFrame:
    """All right rows, and left rows of uids that the right lacks, moved to the mapped group. Mapped rows get `reason`, or their right
    side's reason with `suffix`; left rows that stay in their group become stable."""
    named = lambda own: F.lit(reason) if reason else F.concat(own, F.lit(suffix))
    hit = mapping.select(F.col("right_id").alias("group_id"), F.lit(True).alias("_m"))
    kept = right.join(hit, "group_id", "left").withColumn("reason", F.when(F.col("_m"), named(F.col("reason"))).otherwise(F.col("reason"))).drop("_m")
    m = mapping.select(F.col("left_id").alias("group_id"), "right_id", F.col("household_id").alias("_h"), F.col("stable").alias("_s"), F.col("reason").alias("_r"))
    mapped = F.col("right_id").isNotNull()
    moved = left.join(right.select("uid").distinct(), "uid", "left_anti").join(m, "group_id", "left").select(
        "uid", F.coalesce("right_id", "group_id").alias("group_id"), F.when(mapped, F.col("_h")).otherwise(F.col("household_id")).alias("household_id"),
        F.when(mapped, F.col("_s")).otherwise(True).alias("stable"), F.when(mapped, named(F.col("_r"))).otherwise(F.col("reason")).alias("reason"))
    return kept.select(moved.columns).unionByName(moved)


def doubled(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.select(F.inline(F.array(F.struct(F.col("uid1"), F.col("uid2"), "weight"), F.struct(F.col("uid2").alias("uid1"), F.col("uid1").alias("uid2"), "weight"))))


def seeds(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Memberships of uids with an edge, as many rows as there are."""
    ends = edges.select(F.col("uid1").alias("uid")).unionAll(edges.select(F.col("uid2").alias("uid"))).distinct()
    return members.join(ends, "uid", "left_semi").withColumn("reason", F.lit("SEED"))


def propagate(assigned: DataFrame, edges: DataFrame, cap: int = CAP, cap_first: bool = False, both_ways: bool = False) -> DataFrame:
    """Give neighbours of members the group with the greatest summed weight (double if stable), then keep `cap` uids of each
    group, the heaviest. A uid that loses at the cap gets no other group; `cap_first` caps before choosing. `both_ways`: the edges are doubled already."""
    own = assigned.select(F.col("uid").alias("uid2"), "group_id", "household_id", "stable")
    sums = (edges if both_ways else doubled(edges)).join(own, "uid2").groupBy(F.col("uid1").alias("uid"), "group_id", "household_id", "stable").agg(F.sum("weight").alias("w"))
    open_ = sums.withColumn("w", F.when(F.col("stable"), F.col("w") * 2).otherwise(F.col("w"))).join(assigned.select("uid").distinct(), "uid", "left_anti")
    steps = [(["uid"], [F.desc("w"), F.desc("group_id")], 1), (["group_id"], [F.desc("w"), F.desc("uid")], cap)]
    for by, order, k in reversed(steps) if cap_first else steps:
        open_ = top_k(open_, by, order, k)
    return open_.select("uid", "group_id", "household_id", "stable", F.lit("SP").alias("reason"))


def remainder(edges: DataFrame, assigned: DataFrame, geo: DataFrame) -> DataFrame:
    """Edges whose ends are both unassigned and in one geo."""
    open_ = geo.select("uid", "geo").join(assigned.select("uid").distinct(), "uid", "left_anti")
    for end in ("uid1", "uid2"):
        edges = edges.join(open_.select(F.col("uid").alias(end), F.col("geo").alias(f"g_{end}")), end)
    return edges.where("g_uid1 = g_uid2").select("uid1", "uid2", "weight", F.col("g_uid1").alias("geo"))


def collapse(edges: DataFrame, mapping: DataFrame, keep_conflicts: bool = True, self_weight: float = 1e-5) -> DataFrame:
    """Edges between the groups of their ends. Parallel weights add up, edges inside a group become one of a tiny weight, conflicts stay
    if any edge has one."""
    m = lambda k: mapping.select(F.col("uid").alias(f"uid{k}"), F.col("node").alias(f"n{k}"))
    both = edges.join(m(1), "uid1").join(m(2), "uid2").select(F.least("n1", "n2").alias("node1"), F.greatest("n1", "n2").alias("node2"), "weight", "conflict")
    weight = F.when(F.first("inner"), F.lit(self_weight)).otherwise(F.sum("weight"))
    out = both.withColumn("inner", F.col("node1") == F.col("node2")).groupBy("node1", "node2").agg(weight.alias("weight"), F.bool_or(F.col("conflict") & ~F.col("inner")).alias("conflict"))
    return out if keep_conflicts else out.withColumn("conflict", F.lit(False))


def sentinels(assigned: DataFrame) -> DataFrame:
    """Group 0 for a group of one device with one uid, household 0 for a household of one group."""
    devices = assigned.groupBy("group_id").agg(F.countDistinct("device_id").alias("d"), F.countDistinct("uid").alias("u"))
    groups = assigned.groupBy("household_id").agg(F.countDistinct("group_id").alias("g"))
    return assigned.join(devices, "group_id").join(groups, "household_id").select(
        "uid", "device_id", F.when((F.col("d") == 1) & (F.col("u") == 1), 0).otherwise(F.col("group_id")).alias("group_id"), F.when(F.col("g") == 1, 0).otherwise(F.col("household_id")).alias("household_id"))


def publish(stages: list[DataFrame]) -> DataFrame:
    """Drop group 0, spread anchors and blank uids; mark stable groups; household 0 is blank, null stays null."""
    rows = union_all(stages).where("group_id <> 0").where(~(F.col("uid").startswith("A_") & (F.col("reason") == "SP"))).where(~F.col("uid").rlike(r"^[01_!*\-]*$"))
    mark = F.when(F.col("stable"), "S_").otherwise("")
    return rows.select("uid", F.concat(mark, F.col("group_id").cast("string")).alias("group_id"),
        F.when(F.col("household_id") == 0, "").otherwise(F.concat(mark, F.col("household_id").cast("string"))).alias("household_id"), "reason")


def one_way_best(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left group's best right group; several may share one."""
    counts = left.select("uid", F.col("group_id").alias("left_id")).join(right.select("uid", F.col("group_id").alias("right_id")), "uid").groupBy("left_id", "right_id").agg(F.count("*").alias("cnt"))
    return top_k(counts, ["left_id"], [F.desc("cnt"), F.desc("right_id")], 1)


def multiplicity(staged: DataFrame) -> DataFrame:
    """G21"""
    return staged.groupBy("uid").agg(*[F.countDistinct(c).alias(f"{c}s") for c in ("stage", "group_id", "reason")], F.count("*").alias("rows"))
