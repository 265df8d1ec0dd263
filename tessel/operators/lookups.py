"""Second version of the flow: residual merge, group metadata, published lookups and audience segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.graph import one_way_best

MATCH_PREFIX, HOUSEHOLD_PREFIX = "NS_", "NSH_"


def merge_residual(existing: DataFrame, extra: DataFrame) -> DataFrame:
    """Existing (uid, group_id) rows as they are, and the unseen uids of extra groups: in the existing group that shares most rows with
    theirs, or in their own where none does."""
    best = one_way_best(extra, existing).select(F.col("left_id").alias("group_id"), "right_id")
    unseen = extra.join(existing.select("uid").distinct(), "uid", "left_anti").join(best, "group_id", "left")
    return existing.select("uid", "group_id").unionAll(unseen.select("uid", F.coalesce("right_id", "group_id").alias("group_id")))


def group_metadata(rows: DataFrame, columns: list[str], group: str = "group_id") -> DataFrame:
    """Every row with its group's greatest value of each column. The maxima are combined before the shuffle and joined back, so that
    a large group is no single task. Rows of a null group get null."""
    most = rows.groupBy(group).agg(*[F.max(c).alias(f"group_{c}") for c in columns])
    return rows.join(most, group, "left")


def group_lookup(rows: DataFrame, id_col: str, prefix: str, low: int, high: int) -> DataFrame:
    """(graphid, uids) of non-empty groups of `low` to `high` rows. Rows are counted, repeated ones too, and arrays are made for the groups
    that pass alone, so that none exceeds `high` uids."""
    held = rows.where(F.col(id_col) != "")
    sized = held.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n").between(low, high)).select(id_col)
    return held.join(sized, id_col, "left_semi").groupBy(F.concat(F.lit(prefix), F.col(id_col)).alias("graphid")).agg(F.array_sort(F.collect_set("uid")).alias("uids"))


def match_lookup(rows: DataFrame) -> DataFrame:
    return group_lookup(rows, "group_id", MATCH_PREFIX, 2, 49)


def household_lookup(rows: DataFrame) -> DataFrame:
    return group_lookup(rows, "household_id", HOUSEHOLD_PREFIX, 1, 49)


def uid_lookup(rows: DataFrame, longer_than: int = 10) -> DataFrame:
    """(uid, graphids) of graph ids longer than `longer_than` characters; group sizes do not matter."""
    ids = F.array(F.concat(F.lit(MATCH_PREFIX), "group_id"), F.concat(F.lit(HOUSEHOLD_PREFIX), "household_id"))
    return rows.select("uid", F.explode(ids).alias("graphid")).where(F.length("graphid") > longer_than).groupBy("uid").agg(F.array_sort(F.collect_set("graphid")).alias("graphids"))


def exploded(lookup: DataFrame) -> DataFrame:
    """One row (userid, graphid) for each member of a lookup."""
    return lookup.select(F.explode("uids").alias("userid"), "graphid")


def prefixed(segment: Column, old: str, new: str) -> Column:
    """A segment id with the prefix of its provider and graph type; null if it lacks the provider's."""
    return F.when(segment.startswith(old), F.concat(F.lit(new), F.substring(segment, len(old) + 1, 1_000)))


def attach_segments(segments: DataFrame, members: DataFrame, old: str, new: str) -> DataFrame:
    """Distinct (userid, segment, graphid) of segment rows (uid, segment) whose uid is a member; userid is null."""
    renamed = segments.select(F.col("uid").alias("userid"), prefixed(F.col("segment"), old, new).alias("segment")).where("segment IS NOT NULL").distinct()
    return renamed.join(members, "userid").select("segment", "graphid").distinct().select(F.lit(None).cast("string").alias("userid"), "segment", "graphid")
