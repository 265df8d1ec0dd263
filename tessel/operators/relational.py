"""Operators that every family uses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.session import materialise


def mutual_best(counts: DataFrame, left: str, right: str, n: str) -> DataFrame:
    """Pairs that are each other's best by count; a pair that shares its best with another is rejected, not chosen."""
    ranked = counts.withColumn("rank_l", F.rank().over(W.partitionBy(left).orderBy(F.desc(n)))).withColumn("rank_r", F.rank().over(W.partitionBy(right).orderBy(F.desc(n))))
    best = ranked.where("rank_l = 1 and rank_r = 1")
    best = best.withColumn("n_l", F.count("*").over(W.partitionBy(left))).withColumn("n_r", F.count("*").over(W.partitionBy(right)))
    return best.where("n_l = 1 and n_r = 1").drop("rank_l", "rank_r", "n_l", "n_r")


def top_k(frame: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in a total order."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with how many more times the left has them than the right; equal counts are left out. Null equals null."""
    columns = left.columns
    both = left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_s").alias("delta")).where("delta <> 0")


def fingerprint(frame: DataFrame, by: list[str] = ()) -> DataFrame:
    """An order-independent signature with the number of rows. Nulls have their own mark; repeated rows do not cancel."""
    marked = [F.struct(F.col(c).isNull(), F.col(c)) for c in frame.columns if c not in by]
    return frame.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*marked).cast("decimal(38,0)")).alias("fingerprint"))


def _beside(frame: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the totals of their key, null being a key like any other. Totals have a row for each key, one in all without a key."""
    named = totals.withColumnsRenamed({c: f"_of_{c}" for c in by})
    if not by:
        return frame.crossJoin(F.broadcast(named))
    return frame.join(named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])).drop(*[f"_of_{c}" for c in by])


def running_sums(values: DataFrame, value: str, weights: list[str], by: list[str] = ()) -> DataFrame:
    """Rows of distinct values (of each key) with running sums of their weights, in the values' order. Values are dealt out by ranges; each range
    adds the totals of those before it, so that no task sees all values of a key."""
    by = list(by)
    ranged = materialise(values.repartitionByRange(*by, value).withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy("_p", *by).agg(*[F.sum(w).alias(f"_{w}") for w in weights])  # a row for each range and key in it
    before = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_p", *by, *[F.coalesce(F.sum(f"_{w}").over(before), F.lit(0)).alias(f"_{w}") for w in weights])
    own = W.partitionBy("_p", *by).orderBy(value)
    joined = _beside(ranged, starts, ["_p", *by]) if by else ranged.join(F.broadcast(starts), "_p")
    return joined.select(*by, value, *[(F.sum(w).over(own) + F.col(f"_{w}")).alias(w) for w in weights])


def exact_percentiles(frame: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles from value counts and running sums, so only distinct values are sorted, in ranges."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = running_sums(counts, value, ["_c"], by)
    whole = run.groupBy(*by).agg(F.max("_c").alias("_t"))
    at = lambda s: F.min(F.when(F.col("_c") >= F.ceil(F.col("_t") * s), F.col(value)))
    return _beside(run, whole, by).groupBy(*by).agg(*[at(s).alias(name) for name, s in shares.items()])


def mode(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value, the greatest of equally frequent ones, with its share."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("_n", value)).alias(value), F.max("_n").alias("n"), F.sum("_n").alias("total"))


def unique_latest(frame: DataFrame, by: list[str], day: str) -> DataFrame:
    """Flag the row that is the only one, or the only one of the last day."""
    w = W.partitionBy(*by)
    return (
        frame.withColumn("_n", F.count("*").over(w)).withColumn("_m", F.max(day).over(w)).withColumn("_d", F.count("*").over(W.partitionBy(*by, day)))
        .withColumn("is_latest", (F.col("_n") == 1) | F.coalesce((F.col(day) == F.col("_m")) & (F.col("_d") == 1), F.lit(False))).drop("_n", "_m", "_d")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name; schemas must be the same."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def neighbours(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (uid, other) of edges that touch a key at either end, as two equi joins instead of one with OR."""
    one = edges.select(F.col("uid1").alias("uid"), F.col("uid2").alias("other"))
    two = edges.select(F.col("uid2").alias("uid"), F.col("uid1").alias("other"))
    return one.unionAll(two).join(keys.select("uid").distinct(), "uid", "left_semi").distinct()


def members_by_label(frame: DataFrame, label: str, member: str) -> DataFrame:
    """A clustering without its labels: each member with the sorted members of its group."""
    groups = frame.groupBy(label).agg(F.array_join(F.array_sort(F.collect_set(member)), "|").alias("members"))
    return frame.select(label, member).distinct().join(groups, label).select(member, "members")


def groups_of_members(frame: DataFrame, label: str, member: str) -> DataFrame:
    """Each member with the size and 128 bits of hash of its group's members, which no renaming of labels changes. Sums are combined before
    they are shuffled, and no group is held as a list."""
    rows = frame.select(label, member).distinct()
    sums = [F.sum(F.xxhash64(F.lit(k), member).cast("decimal(38,0)")).alias(f"members_{k}") for k in (1, 2)]
    return rows.join(rows.groupBy(label).agg(F.count("*").alias("size"), *sums), label).select(member, "size", "members_1", "members_2")


def compare_clusterings(left: DataFrame, right: DataFrame, label: str = "group_id", member: str = "uid") -> DataFrame:
    """How many rows differ, as they are (strict), and with labels replaced by the groups' members (structural, which no renaming changes)."""

    def counted(kind: str, difference: DataFrame) -> DataFrame:
        up, down = F.sum(F.greatest("delta", F.lit(0))), F.sum(F.greatest(-F.col("delta"), F.lit(0)))
        return difference.agg(F.count("*").alias("differing"), F.coalesce(up, F.lit(0)).alias("left_only"), F.coalesce(down, F.lit(0)).alias("right_only")).select(F.lit(kind).alias("kind"), "*")

    named = [f.select(member, label) for f in (left, right)]
    sets = [groups_of_members(f, label, member).distinct() for f in named]
    return counted("strict", multiset_difference(*named)).unionAll(counted("structural", multiset_difference(*sets)))


def ranked_top(frame: DataFrame, order: list[Column], value: str, k: int) -> DataFrame:
    """The first k rows in an order, with their rank by a value. The rows are cut before they are ranked."""
    top = frame.orderBy(*order).limit(k)
    return top.withColumn("r", F.rank().over(W.orderBy(F.desc(value))))
