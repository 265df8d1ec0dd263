"""Link evidence: links (source, email, npi) from dated observations, and what their histories show. Unknown is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.text import email_domain, email_domain_class, joined_hash
from tessel.operators.relational import fingerprint, mode, union_all
from tessel.session import materialise

KEY = ["source", "email", "npi"]
EMAIL = ["source", "email"]


def links(observations: DataFrame) -> DataFrame:
    """A row for each (source, email, npi) with its distinct days; days are never filled in between."""
    return observations.where("email <> '' and npi <> ''").groupBy(*KEY).agg(
        F.array_sort(F.collect_set("day")).alias("observed_days"), F.min("day").alias("first_seen_day"), F.max("day").alias("last_seen_day"),
        F.count("*").alias("observation_count"), F.count_if(F.col("day").isNull()).alias("undated_observation_count"),
    ).withColumn("link_id", joined_hash(*map(F.col, KEY)))


def email_multiplicity(linked: DataFrame) -> DataFrame:
    """L04"""
    return linked.groupBy(*EMAIL).agg(F.countDistinct("npi").alias("email_npi_count"), F.count_if(F.col("undated_observation_count") > 0).alias("undated_link_count"))


def email_linkage(linked: DataFrame, undated_sources: list[str] = ()) -> DataFrame:
    """Whether an email's set of npis changed between days: true, false, or null if undated links leave it open."""
    daily = linked.select(*EMAIL, "npi", F.explode("observed_days").alias("d")).groupBy(*EMAIL, "d").agg(F.array_sort(F.collect_set("npi")).alias("npis"))
    seen = daily.groupBy(*EMAIL).agg(F.array_sort(F.collect_set(F.when(F.size("npis") > 1, F.col("d")))).alias("conflict_days"), (F.countDistinct("npis") > 1).alias("changed"))
    undated = F.col("source").isin(list(undated_sources)) if undated_sources else F.lit(False)
    single = F.col("email_npi_count") == 1
    dated_rule = F.when(F.coalesce("changed", F.lit(False)), True).when(single, False).when(F.col("undated_link_count") > 0, F.lit(None)).otherwise(False)
    return email_multiplicity(linked).join(seen, EMAIL, "left").select(
        *EMAIL, "email_npi_count", "undated_link_count",
        F.when(undated, F.array().cast("array<date>")).otherwise(F.coalesce("conflict_days", F.array().cast("array<date>"))).alias("conflict_days"),
        F.when(undated, F.when(single, False)).otherwise(dated_rule).alias("has_been_reassigned"))


def link_conflicts(linked: DataFrame, linkage: DataFrame, undated_sources: list[str] = ()) -> DataFrame:
    """Whether a link shares a day with another npi of its email."""
    undated = F.col("source").isin(list(undated_sources)) if undated_sources else F.lit(False)
    rule = F.when(F.arrays_overlap("observed_days", "email_conflict_days"), True).when(F.col("email_npi_count") == 1, False).when(F.col("undated_observation_count") > 0, F.lit(None)).otherwise(False)
    joined = linked.join(linkage.withColumnRenamed("conflict_days", "email_conflict_days"), EMAIL)
    return joined.withColumn("has_conflict_linkage", F.when(undated, F.col("email_npi_count") > 1).otherwise(rule)).withColumn(
        "conflict_days", F.array_sort(F.array_intersect("observed_days", "email_conflict_days"))).drop("email_conflict_days")


def conflict_peers(linked: DataFrame, values: DataFrame, alike=None, dated: bool = True) -> DataFrame:
    """For each link in conflict, the other npis of its email on its conflict days, and whether they share a value.

    `linked` has conflict_days and has_conflict_linkage, `values` (source, email, npi, vals array). Links meet by (source, email, day), so that
    a hot email is spread over its days; links of undated sources (`dated` false) by (source, email). `alike` tells from two arrays
    whether they agree (equal values by default). shares: true, false, or null where either side has no value.
    """
    if dated:
        days = linked.select(*KEY, F.explode("conflict_days").alias("d"))
        peers = days.select(*EMAIL, "d", F.col("npi").alias("peer"))
        pairs = days.join(peers, [*EMAIL, "d"]).where("npi <> peer").groupBy(*KEY, "peer").agg(F.array_sort(F.collect_set("d")).alias("days"))
    else:
        one = linked.where("has_conflict_linkage").select(*KEY)
        pairs = one.join(one.select(*EMAIL, F.col("npi").alias("peer")), EMAIL).where("npi <> peer").distinct().withColumn("days", F.array().cast("array<date>"))
    mine = values.select(*KEY, F.col("vals").alias("own"))
    other = values.select(*EMAIL, F.col("npi").alias("peer"), F.col("vals").alias("theirs"))
    both = pairs.join(mine, KEY, "left").join(other, [*EMAIL, "peer"], "left")
    shared = F.when((F.size("own") > 0) & (F.size("theirs") > 0), F.arrays_overlap("own", "theirs") if alike is None else alike(F.col("own"), F.col("theirs")))
    some, open_ = F.count_if("shares"), F.count_if(F.col("shares").isNull())
    return both.withColumn("shares", shared).groupBy(*KEY).agg(
        F.when(some > 0, True).when(open_ > 0, F.lit(None)).otherwise(False).alias("shares"), F.count("*").alias("peers"),
        F.array_sort(F.collect_list(F.struct("peer", "days", F.array_sort(F.array_intersect("own", "theirs")).alias("shared"), "shares"))).alias("comparisons"))


def conflict_shares(linked: DataFrame, values: DataFrame) -> DataFrame:
    """L10 without the pairs: (key, shares) of links with peers on their conflict days, for values that agree if they are equal.

    A value that two npis of an email have on a day is shared by both. Counts by (source, email, day, value) take the place of pairs, so that the
    work grows with the number of links of an email-day, not with its square.
    """
    days = linked.select(*KEY, F.explode("conflict_days").alias("d")).join(values.select(*KEY, "vals"), KEY, "left").withColumn("has", F.coalesce(F.size("vals") > 0, F.lit(False)))
    sizes = days.groupBy(*EMAIL, "d").agg(F.count("*").alias("n"), F.count_if(~F.col("has")).alias("without"))
    own = days.select(*KEY, "d", F.explode("vals").alias("v")).distinct()
    twice = own.groupBy(*EMAIL, "d", "v").agg(F.count("*").alias("c")).where("c > 1")
    hit = own.join(twice, [*EMAIL, "d", "v"], "left_semi").select(*KEY, "d").distinct().withColumn("hit", F.lit(True))
    rows = days.join(sizes, [*EMAIL, "d"]).where("n > 1").join(hit, [*KEY, "d"], "left")
    open_ = ~F.col("has") | (F.col("without") > 0)
    return rows.groupBy(*KEY).agg(F.when(F.count_if("hit") > 0, True).when(F.count_if(open_) > 0, F.lit(None)).otherwise(False).alias("shares"))


def link_freshness(linked: DataFrame, as_of: str) -> DataFrame:
    """Age of the source and lag of the link behind it, in days; null where a day lies in the future."""
    latest = linked.groupBy("source").agg(F.max("last_seen_day").alias("source_latest_day"))
    day = F.lit(as_of).cast("date")
    return linked.join(latest, "source").select(
        *KEY, "source_latest_day", F.when(F.col("source_latest_day") <= day, F.datediff(day, "source_latest_day")).alias("source_age_days"),
        F.when(F.col("source_latest_day") <= day, F.datediff("source_latest_day", "last_seen_day")).alias("link_lag_days"))


def link_stability(linked: DataFrame) -> DataFrame:
    """On what share of its email's days a link was seen, and what share of those days it shared."""
    days = linked.select(*EMAIL, F.explode("observed_days").alias("d")).groupBy(*EMAIL).agg(F.countDistinct("d").alias("email_day_count"))
    undated = linked.groupBy(*EMAIL).agg(F.bool_or(F.col("undated_observation_count") > 0).alias("has_undated"))
    n = F.size("observed_days")
    return linked.join(days, EMAIL, "left").join(undated, EMAIL).select(
        *KEY, F.coalesce("email_day_count", F.lit(0)).alias("email_day_count"), n.alias("link_day_count"), F.size("conflict_days").alias("conflict_day_count"),
        F.when(n > 0, n / F.nullif("email_day_count", F.lit(0))).alias("presence_share"), F.when(n > 0, F.size("conflict_days") / n).alias("overlap_share"), "has_undated")


def sequence_history(linked: DataFrame, as_of: str, content_versioned: list[str] = ()) -> DataFrame:
    """For each day of an email, up to `as_of`: npis, what came and went, and causal counts of versions, npis, changes, swaps and
    returns. In content-versioned sources a day is a version only if the delivery differs from the one before.

    An npi came if its own last day is not the email's last day, returned if it has an earlier day, and went if its next day is not the
    email's next day. So no set of all npis so far is ever built.
    """
    seen = linked.select(*KEY, F.explode("observed_days").alias("d")).where(F.col("d") <= F.lit(as_of).cast("date")).distinct()
    w, own = W.partitionBy(*EMAIL).orderBy("d"), W.partitionBy(*KEY).orderBy("d")
    days = seen.select(*EMAIL, "d").distinct().withColumn("prev_day", F.lag("d").over(w)).withColumn("next_day", F.lead("d").over(w))
    if content_versioned:
        before = W.partitionBy("source").orderBy("d")
        changed = ~(F.lag("fingerprint").over(before).eqNullSafe(F.col("fingerprint")) & F.lag("rows").over(before).eqNullSafe(F.col("rows")))
        steps = fingerprint(seen, ["source", "d"]).select("source", "d", (changed | ~F.col("source").isin(list(content_versioned))).alias("new_version"))
        days = days.join(steps, ["source", "d"])
    else:
        days = days.withColumn("new_version", F.lit(True))
    rows = seen.withColumn("last", F.lag("d").over(own)).withColumn("next", F.lead("d").over(own)).join(days, [*EMAIL, "d"])
    came = F.col("prev_day").isNotNull() & ~F.col("last").eqNullSafe(F.col("prev_day"))
    sets = lambda flag: F.array_sort(F.collect_set(F.when(flag, F.col("npi"))))
    daily = rows.groupBy(*EMAIL, "d").agg(
        F.any_value("prev_day").alias("prev_day"), F.any_value("new_version").alias("new_version"), F.array_sort(F.collect_set("npi")).alias("npis"), sets(came).alias("added"),
        sets(came & F.col("last").isNotNull()).alias("returned"), F.count_if(F.col("last").isNull()).alias("new"))
    gone = rows.where("next_day IS NOT NULL AND NOT (next <=> next_day)").groupBy(*EMAIL, F.col("next_day").alias("d")).agg(F.array_sort(F.collect_set("npi")).alias("removed"))
    daily = daily.join(gone, [*EMAIL, "d"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<string>"))).withColumn("swap", (F.size("added") > 0) & (F.size("removed") > 0))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return daily.select(
        *EMAIL, F.col("d").alias("day"), "prev_day", "npis", "added", "removed", "returned", F.count_if("new_version").over(upto).alias("versions"), F.sum("new").over(upto).alias("npis_seen"),
        F.count_if((F.size("added") > 0) | (F.size("removed") > 0)).over(upto).alias("changes"), F.count_if("swap").over(upto).alias("swaps"),
        F.count_if(F.col("swap") & (F.size("returned") > 0)).over(upto).alias("flipbacks"))


def sequence_summary(history: DataFrame) -> DataFrame:
    """Counts of the last day of each email."""
    return history.groupBy(*EMAIL).agg(*[F.max(c).alias(c) for c in ("versions", "npis_seen", "changes", "swaps", "flipbacks")], F.count("*").alias("n_days"))


def domain_evidence(linked: DataFrame, states: DataFrame) -> DataFrame:
    """Per email domain: emails, npis, and the state most of its npis have (npi, state), with its share."""
    d = linked.select(email_domain(F.col("email")).alias("domain"), "email", "npi").where("domain is not null")
    sizes = d.groupBy("domain").agg(F.countDistinct("email").alias("emails"), F.countDistinct("npi").alias("npis"))
    top = mode(d.select("domain", "npi").distinct().join(states, "npi"), ["domain"], "state")
    return sizes.join(top, "domain", "left").select("domain", "emails", "npis", F.col("state").alias("top_state"), (F.col("n") / F.col("total")).alias("top_state_share"))


def cross_source(linked: DataFrame) -> DataFrame:
    """For each link the other sources of its email that name its npi, and those that name only others. Links meet the sources of their
    email, then the rows of their npi; no set of npis is built."""
    one = linked.select(*KEY).distinct()
    sources = one.select("email", F.col("source").alias("other")).distinct()
    named = one.select("email", "npi", F.col("source").alias("other"), F.lit(True).alias("_y"))
    seen = one.join(sources, "email").where("source <> other").join(named, ["email", "npi", "other"], "left").withColumn("agrees", F.coalesce("_y", F.lit(False)))
    sets = seen.groupBy(*KEY).agg(*[F.array_sort(F.collect_set(F.when(F.col("agrees") == flag, F.col("other")))).alias(name) for flag, name in ((True, "agree"), (False, "disagree"))])
    empty = F.array().cast("array<string>")
    return one.join(sets, KEY, "left").select(*KEY, F.coalesce("agree", empty).alias("agree"), F.coalesce("disagree", empty).alias("disagree"))


def cross_source_values(linked: DataFrame, column: str, alike=None) -> DataFrame:
    """For each link the other sources that name its npi for its email and whose values agree with its own, and those whose do not. Sources
    without values are in neither."""
    one = linked.select(*KEY, F.col(column).alias("own")).where(F.size("own") > 0)
    other = one.select("email", "npi", F.col("source").alias("other"), F.col("own").alias("theirs"))
    both = one.join(other, ["email", "npi"]).where("source <> other").withColumn("agrees", F.arrays_overlap("own", "theirs") if alike is None else alike(F.col("own"), F.col("theirs")))
    return both.groupBy(*KEY).agg(*[F.array_sort(F.collect_set(F.when(F.col("agrees") == flag, F.col("other")))).alias(name) for flag, name in ((True, "agree"), (False, "disagree"))])


def domain_records(linked: DataFrame) -> DataFrame:
    """L22 by source: e-mails and npis of each domain; for domains that are no free mail, npis with a state and a facility, how many states, the
    share of the most frequent state, and the most frequent facility (the greatest of equal ones) with its share.

    linked: the key, facility_primary_state and facility_npi_values (by npi). Free domains carry counts only.
    """
    kind = email_domain_class(F.col("email"))
    d = linked.select(*KEY, email_domain(F.col("email")).alias("domain"), kind.alias("domain_class"), "facility_primary_state", "facility_npi_values").where("domain IS NOT NULL")
    by = ["source", "domain"]
    counts = d.groupBy(*by).agg(F.max("domain_class").alias("domain_class"), F.countDistinct("email").alias("domain_email_count"), F.countDistinct("npi").alias("domain_npi_count"))
    npis = d.where("domain_class NOT IN ('free', 'unknown')").groupBy(*by, "npi").agg(F.any_value("facility_primary_state").alias("state"), F.any_value("facility_npi_values").alias("facilities"))
    per_state = npis.where("state IS NOT NULL").groupBy(*by, "state").agg(F.count("*").alias("n"))
    states = per_state.groupBy(*by).agg(F.sum("n").alias("npis_with_state"), F.count("*").alias("state_count"), (F.max("n") / F.sum("n")).alias("top_state_share"))
    per_facility = npis.select(*by, F.explode("facilities").alias("f")).groupBy(*by, "f").agg(F.count("*").alias("n"))
    top = per_facility.groupBy(*by).agg(F.max_by("f", F.struct("n", "f")).alias("top_facility_npi"), F.max("n").alias("_most"))
    held = npis.where(F.size("facilities") > 0).groupBy(*by).agg(F.count("*").alias("npis_with_facility"))
    out = counts.join(states, by, "left").join(held, by, "left").join(top, by, "left")
    return out.withColumn("top_facility_share", F.col("_most") / F.col("npis_with_facility")).drop("_most")


def enrich(base: DataFrame, steps: list[tuple[str, DataFrame]], store_after: tuple[str, ...] = ()) -> DataFrame:
    """Links with all evidence, joined in a fixed order by the link (or by whatever columns of the key a step has). A stored step cuts
    the plan there. No step may make or lose a link."""
    out = base
    for name, frame in steps:
        out = out.join(frame, [c for c in KEY if c in frame.columns], "left")
        if name in store_after:
            out = materialise(out)
    return out


def core_union(parts: list[DataFrame]) -> DataFrame:
    """Links of all feeds; columns and types must be the same."""
    kinds = {tuple(sorted(p.dtypes)) for p in parts}
    if len(kinds) != 1:
        raise TypeError(f"schemas differ: {sorted(kinds)}")
    return union_all(parts)


#: An e-mail as it is looked up.
LOOKUP_KEY = "email_key"


def normalised_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def lookup(published: DataFrame, email: str, columns: list[str]) -> DataFrame:
    """The rows of one e-mail, newest first within source and npi. A table with a stored key (see tessel.sources.keyed) is read where
    that key may be; any other is read whole."""
    own = F.col(LOOKUP_KEY) if LOOKUP_KEY in published.columns else normalised_email(F.col("email"))
    hit = published.where(own == normalised_email(F.lit(email)))
    return hit.select(columns).orderBy("source", "npi", F.desc_nulls_last("last_seen_day"), "link_id")
