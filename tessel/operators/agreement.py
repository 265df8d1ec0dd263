"""Names that are alike meet by equal keys: an index of agreement instead of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators.links import EMAIL, KEY
from tessel.session import materialise

#: Letters from which on one edit is forgiven, and two.
ONE_EDIT, TWO_EDITS, PREFIX = 5, 8, 3


def without_one(v: Column) -> Column:
    """Column: all strings that lack one letter of v."""
    return F.transform(F.sequence(F.lit(1), F.length(v)), lambda k: F.concat(F.substring(v, F.lit(1), k - 1), F.substring(v, k + 1, F.length(v))))


def deletions(v: Column) -> Column:
    """Column: v (five letters or more) and what is left of it after one deletion, from eight letters on after two. Strings that edit_close()
    accepts have one in common."""
    one = F.when(F.length(v) >= ONE_EDIT, without_one(v)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(v) >= TWO_EDITS, F.flatten(F.transform(one, without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(v), one, two))


def close_strings(strings: DataFrame) -> DataFrame:
    """(s, other): pairs of different strings of a dictionary (s) that edit_close() accepts, both ways round."""
    long = strings.where(F.length("s") >= ONE_EDIT).select("s").distinct()
    keyed = long.select("s", F.explode(deletions(F.col("s"))).alias("key"))
    met = keyed.join(keyed.select("key", F.col("s").alias("other")), "key").where("s <> other").select("s", "other").distinct()
    return met.where(T.edit_close(F.col("s"), F.col("other")))


def _keys(names: DataFrame, kind: str, values: Column, full: Column | bool = True) -> DataFrame:
    return names.select("n", F.explode(values).alias("v")).select("n", F.concat(F.lit(f"{kind}:"), "v").alias("key"), (F.lit(True) if full is True else full).alias("full"))


def agreement_keys(names: DataFrame) -> DataFrame:
    """(n, last_key, last_full, first_key, first_full) of distinct names n (first_name, last_name, first_variants), none of them null.

    Two names agree (names_disagree() is false) just if they have a last key and a first key in common such that for each of the two
    keys one name at least holds it fully. Equal letters, tokens and nicknames are held fully. A first token holds its prefixes in part,
    itself fully: one begins with the other if they meet at the shorter. Letters within an edit are held in part under the other's
    spelling, which the other holds fully. Each name has some ten keys of either sort.
    """
    names = names.select("n", T.letters(F.col("n.last_name")).alias("last"), T.first_token(F.col("n.first_name")).alias("token"))
    names = materialise(names.withColumn("first", T.letters(F.col("token"))))
    close = materialise(close_strings(names.select(F.col("last").alias("s")).unionAll(names.select("first"))))
    near = lambda c, kind: names.join(close, names[c] == close.s).select("n", F.concat(F.lit(f"{kind}:"), "other").alias("key"), F.lit(False).alias("full"))
    last = _keys(names, "l", F.array("last")).unionAll(near("last", "l")).unionAll(_keys(names, "t", F.split(F.regexp_replace(F.col("n.last_name"), "[- ]+", " "), " ")))
    prefixes = F.when(F.length("token") >= PREFIX, F.transform(F.sequence(F.lit(PREFIX), F.length("token")), lambda k: F.substring(F.col("token"), F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    starts = names.select("n", "token", F.explode(prefixes).alias("v")).select("n", F.concat(F.lit("p:"), "v").alias("key"), (F.col("v") == F.col("token")).alias("full"))
    spelled = F.when(F.length("first") >= ONE_EDIT, F.array("first")).otherwise(F.array().cast("array<string>"))
    first = _keys(names, "t", F.split(F.col("n.first_name"), " ")).unionAll(starts).unionAll(_keys(names, "n", F.col("n.first_variants"))).unionAll(_keys(names, "e", spelled)).unionAll(near("first", "e"))
    whole = lambda frame, name: frame.groupBy("n", "key").agg(F.bool_or("full").alias(f"{name}_full")).withColumnRenamed("key", f"{name}_key")
    return whole(last, "last").join(whole(first, "first"), "n")


def conflict_name_shares(linked: DataFrame, values: DataFrame) -> DataFrame:
    """L10 for names, without pairs: (key, shares) of links with peers on their conflict days: true if some peer has a name like one of the link's,
    else null if the link or a peer has no name, else false.

    `linked` has conflict_days, `values` (source, email, npi, vals) lists of names. For each (source, email, day) and pair of keys the
    smallest and greatest npi of each sort of holder are kept; a link has a peer there if one of the two is not itself. So the work grows with
    the number of names of an e-mail-day, whatever the number of its npis, and no two links are joined.
    """
    days = linked.select(*KEY, F.explode("conflict_days").alias("d")).join(values.select(*KEY, "vals"), KEY, "left").withColumn("has", F.coalesce(F.size("vals") > 0, F.lit(False)))
    days = materialise(days)
    sizes = days.groupBy(*EMAIL, "d").agg(F.count("*").alias("n"), F.count_if(~F.col("has")).alias("without"))
    plain = lambda n: F.struct(n["first_name"].alias("first_name"), n["last_name"].alias("last_name"), n["first_variants"].alias("first_variants"))
    own = days.select(*KEY, "d", F.explode(F.transform("vals", plain)).alias("n")).distinct()
    keyed = materialise(own.join(agreement_keys(own.select("n").distinct()), "n").drop("n").distinct())
    sorts = {"any": F.lit(True), "last": F.col("last_full"), "first": F.col("first_full"), "both": F.col("last_full") & F.col("first_full")}
    ends = [f(F.when(kind, F.col("npi"))).alias(f"{name}_{side}") for name, kind in sorts.items() for side, f in (("low", F.min), ("high", F.max))]
    bucket = [*EMAIL, "d", "last_key", "first_key"]
    held = keyed.groupBy(*bucket).agg(*ends).where("any_low < any_high")
    # what the other must hold fully is what this name holds in part
    peer = lambda name: F.coalesce((F.col(f"{name}_low") != F.col("npi")) | (F.col(f"{name}_high") != F.col("npi")), F.lit(False))
    met = F.when(F.col("last_full") & F.col("first_full"), peer("any")).when(F.col("last_full"), peer("first")).when(F.col("first_full"), peer("last")).otherwise(peer("both"))
    hit = keyed.join(held, bucket).where(met).select(*KEY, "d").distinct().withColumn("hit", F.lit(True))
    rows = days.join(sizes, [*EMAIL, "d"]).where("n > 1").join(hit, [*KEY, "d"], "left")
    open_ = ~F.col("has") | (F.col("without") > 0)
    return rows.groupBy(*KEY).agg(F.when(F.count_if("hit") > 0, True).when(F.count_if(open_) > 0, F.lit(None)).otherwise(False).alias("shares"))
