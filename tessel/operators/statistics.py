"""Summaries of link evidence by source, and invariants: frames of what breaks a rule, empty if it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.links import EMAIL, KEY
from tessel.operators.relational import exact_percentiles


def percent(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.nullif(whole, F.lit(0))


def flag_rates(frame: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Q02, Q03, Q05-Q07, Q13-Q16, Q31: rows, and how many of them are true, false and unknown for each flag, in one scan."""
    counts = [F.count("*").alias("rows")]
    for c in flags:
        counts += [F.count_if(F.col(c)).alias(f"{c}_true"), F.count_if(~F.col(c)).alias(f"{c}_false"), F.count_if(F.col(c).isNull()).alias(f"{c}_unknown")]
    out = frame.groupBy(*by).agg(*counts)
    return out.withColumns({f"{c}_true_pct": percent(F.col(f"{c}_true"), F.col("rows")) for c in flags})


def class_shares(frame: DataFrame, by: list[str], column: str) -> DataFrame:
    """Q04, Q22, Q26: a row for each class of a column with its share of the rows. Classes that do not occur have no row."""
    counts = frame.groupBy(*by, column).agg(F.count("*").alias("rows"))
    whole = counts.groupBy(*by).agg(F.sum("rows").alias("whole"))
    return counts.join(whole, by).select(*by, column, "rows", percent(F.col("rows"), F.col("whole")).alias("pct"))


def observation_counts(linked: DataFrame) -> DataFrame:
    """Q01: links and observations of a source, and exact percentiles of observations a link."""
    sums = linked.groupBy("source").agg(F.count("*").alias("links"), F.sum("observation_count").alias("observations"), F.max("observation_count").alias("most"))
    return sums.join(exact_percentiles(linked, ["source"], "observation_count", {"p50": 0.5, "p95": 0.95}), "source")


def multiplicity_histogram(linked: DataFrame, top: int = 5) -> DataFrame:
    """Q08: emails and links by the number of npis of the email, `top` or more together."""
    emails = linked.groupBy(*EMAIL).agg(F.count("*").alias("links"), F.countDistinct("npi").alias("npis"))
    return emails.groupBy("source", F.least("npis", F.lit(top)).alias("npis")).agg(F.count("*").alias("emails"), F.sum("links").alias("links"))


def linkage_outcomes(conflicts: DataFrame) -> DataFrame:
    """Q09, Q10: emails and links by outcome of reassignment and conflict. An email is in conflict if a link of it is, and open if
    none is and one is unknown."""
    none = ~F.bool_or(F.coalesce("has_conflict_linkage", F.lit(True)))
    emails = conflicts.groupBy(*EMAIL).agg(
        F.count("*").alias("links"), F.bool_or("has_been_reassigned").alias("reassigned"), F.when(F.bool_or("has_conflict_linkage"), True).when(none, False).alias("conflict"))
    return emails.groupBy("source", "reassigned", "conflict").agg(F.count("*").alias("emails"), F.sum("links").alias("links"))


def lag_summary(freshness: DataFrame) -> DataFrame:
    """Q20: links with a lag, exact percentiles of it, and links without."""
    known = freshness.where("link_lag_days IS NOT NULL")
    counts = freshness.groupBy("source").agg(F.count("link_lag_days").alias("dated"), F.count_if(F.col("link_lag_days").isNull()).alias("undated"), F.max("link_lag_days").alias("longest"))
    return counts.join(exact_percentiles(known, ["source"], "link_lag_days", {"p50": 0.5, "p95": 0.95}), "source", "left")


def stability_summary(stability: DataFrame) -> DataFrame:
    """Q21: how many links were seen on all days of their email, and shared none, some or all of theirs."""
    seen, shared = F.col("presence_share"), F.col("overlap_share")
    return stability.groupBy("source").agg(
        F.count("*").alias("links"), F.count(seen).alias("dated"), F.count_if("has_undated").alias("incomplete"), F.count_if(seen == 1).alias("always"), F.count_if(shared == 0).alias("apart"),
        F.count_if(shared > 0).alias("overlapping"), F.count_if(shared == 1).alias("all_overlapping"), F.avg(seen).alias("mean_presence"), F.avg(shared).alias("mean_overlap"), F.max("email_day_count").alias("most_days"))


def source_matrix(cross: DataFrame) -> DataFrame:
    """Q29: links of a source that each other source agrees or disagrees with."""

    def marked(column: str) -> Column:
        return F.transform(column, lambda s: F.struct(s.alias("other"), F.lit(column == "agree").alias("agrees")))

    seen = cross.select("source", F.explode(F.concat(marked("agree"), marked("disagree"))).alias("x"))
    return seen.groupBy("source", F.col("x.other").alias("other")).agg(F.count_if("x.agrees").alias("agree"), F.count_if(~F.col("x.agrees")).alias("disagree"))


def wrong_multiplicity(linked: DataFrame, stored: DataFrame) -> DataFrame:
    """Emails whose stored npi count is not that of their links, or is on one side only."""
    counts = linked.select(*KEY).distinct().groupBy(*EMAIL).agg(F.count("*").alias("found"))
    return counts.join(stored.select(*EMAIL, "email_npi_count"), EMAIL, "full").where(~F.col("found").eqNullSafe(F.col("email_npi_count")))


def wrong_reassignment(observations: DataFrame, stored: DataFrame) -> DataFrame:
    """Emails stored as reassigned whose day after day sets of npis never differ, or the other way round. A set stands for itself as the sum
    of its members' hashes, and is compared with that of the day before: another way than counting sets."""
    from pyspark.sql import Window as W

    daily = observations.where("day IS NOT NULL").select(*KEY, "day").distinct().groupBy(*EMAIL, "day").agg(F.sum(F.xxhash64("npi").cast("decimal(38,0)")).alias("npis"))
    before = F.lag("npis").over(W.partitionBy(*EMAIL).orderBy("day"))
    moved = daily.withColumn("moved", before.isNotNull() & (before != F.col("npis"))).groupBy(*EMAIL).agg(F.bool_or("moved").alias("moved"))
    return stored.join(moved, EMAIL, "left").where(F.coalesce("moved", F.lit(False)) != F.coalesce("has_been_reassigned", F.lit(False))).select(*EMAIL, "moved", "has_been_reassigned")


def wrong_stability(stability: DataFrame) -> DataFrame:
    """I16: links whose counts or shares are out of order or range."""
    n, e, c = (F.col(x) for x in ("link_day_count", "email_day_count", "conflict_day_count"))
    range_ = lambda x: F.col(x).isNotNull() & ~F.col(x).between(0, 1)
    return stability.where((n > e) | (c > n) | range_("presence_share") | range_("overlap_share") | ((n == 0) != F.col("presence_share").isNull()))


def wrong_membership(published: DataFrame) -> DataFrame:
    """Uids in more than one group."""
    return published.groupBy("uid").agg(F.countDistinct("group_id").alias("groups")).where("groups > 1")


def class_overlap(metrics: DataFrame) -> DataFrame:
    """Q07: links with each class, of all links of the source; classes overlap, so shares do not add up. J22: the class array is exploded once."""
    totals = metrics.groupBy("source").agg(F.count("*").alias("links_total"), F.count_if(F.size("match_classes") > 1).alias("links_with_multiple_classes"))
    classes = metrics.select("source", F.explode("match_classes").alias("match_class"), (F.size("match_classes") > 1).alias("m"), "vendor_name_matches_registry_name")
    per = classes.groupBy("source", "match_class").agg(F.count("*").alias("links_with_class"), F.count_if("m").alias("links_with_other_classes"), F.count_if("vendor_name_matches_registry_name").alias("links_with_true_aggregate"))
    return per.join(totals, "source").withColumn("pct", percent(F.col("links_with_class"), F.col("links_total")))


def name_counts(history: DataFrame) -> DataFrame:
    """Q11, Q12: e-mails by their number of names, and links by whether their names disagree; three levels: link, e-mail, source."""
    c = F.col("email_npi_has_name_conflict")
    emails = history.groupBy(*EMAIL).agg(F.max("email_name_count").alias("n"), F.count("*").alias("links"), F.count_if(c).alias("conflicting"), F.count_if(~c).alias("agreeing"), F.count_if(c.isNull()).alias("unknown"))
    sizes = {"no_name_emails": F.col("n") == 0, "one_name_emails": F.col("n") == 1, "two_name_emails": F.col("n") == 2, "three_name_emails": F.col("n") == 3, "more_name_emails": F.col("n") > 3}
    out = emails.groupBy("source").agg(F.count("*").alias("emails"), F.sum("links").alias("links"), *[F.count_if(r).alias(n) for n, r in sizes.items()], F.max("n").alias("most_names"),
        *[F.sum(x).alias(f"{x}_links") for x in ("conflicting", "agreeing", "unknown")])
    return out.withColumn("conflicting_pct", percent(F.col("conflicting_links"), F.col("links")))


def shared_values(conflicts: DataFrame, shares: dict[str, DataFrame]) -> DataFrame:
    """For each dimension (name, state, facility, ...) the links in conflict that share a value with a peer, do not, or
    where it is unknown, with shares of the links in conflict. Each frame has the key and `shares`."""
    out = None
    for name, frame in shares.items():
        rows = conflicts.select(*KEY, "has_conflict_linkage").join(frame.select(*KEY, "shares"), KEY, "left")
        c, s = F.col("has_conflict_linkage"), F.col("shares")
        one = rows.groupBy("source").agg(
            F.count("*").alias("links"), F.count_if(c).alias("conflict_links"), F.countDistinct(F.when(c, F.col("email"))).alias("conflict_emails"), F.count_if(s).alias("shared"), F.count_if(~s).alias("different"),
            F.count_if(c & s.isNull()).alias("unknown"), F.count_if(~c).alias("not_applicable"), F.count_if(c.isNull()).alias("unknown_timing")).withColumn("dimension", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("shared_pct", percent(F.col("shared"), F.col("conflict_links")))


def outcome_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """Q17, Q18: links, distinct e-mail and npi pairs and npis for each outcome."""
    return records.groupBy(*by).agg(F.count("*").alias("links"), F.countDistinct(F.struct("email", "npi")).alias("pairs"), F.countDistinct("npi").alias("npis"))


def availability(records: DataFrame, columns: list[str], dates: list[str]) -> DataFrame:
    """Q17: rows with a value in each column, and with a value that is no date. One row a column."""
    from tessel.functions.text import clean_text, parse_day

    bad = lambda c: F.count_if(clean_text(F.col(c)).isNotNull() & parse_day(F.trim(c)).isNull()) if c in dates else F.lit(0).cast("long")
    sums = records.agg(F.count("*").alias("rows"), F.countDistinct("npi").alias("npis"), *[F.count(c).alias(f"v_{c}") for c in columns], *[bad(c).alias(f"b_{c}") for c in columns])
    return sums.select("rows", "npis", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v_{c}").alias("values"), F.col(f"b_{c}").alias("invalid")) for c in columns])))


def location_sections(records: DataFrame) -> DataFrame:
    """Links, e-mails and pairs by source, and by each of three outcomes, from one scan; a section names what a row groups by."""
    columns = ["location_status", "vendor_state_comparison", "facility_state_comparison"]
    section = F.lit("totals")
    for c in reversed(columns):
        section = F.when(F.grouping(c) == 0, c).otherwise(section)
    return records.groupingSets([["source"], *[["source", c] for c in columns]], "source", *columns).agg(
        section.alias("section"), F.count("*").alias("links"), F.countDistinct("email").alias("emails"), F.countDistinct(F.struct("email", "npi")).alias("pairs"))


def identity_outcomes(records: DataFrame) -> DataFrame:
    """Outcomes of structure, entity type and its reason, by links and by identifiers, with their shares in the source."""
    from pyspark.sql import Window as W

    npis = records.groupBy("source", "npi", "structure_reason", "entity_type", "entity_reason").agg(F.count("*").alias("links"))
    one = npis.select("source", "links", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("outcome")) for d in ("structure_reason", "entity_type", "entity_reason")])))
    sums = one.groupBy("source", "dimension", "outcome").agg(F.sum("links").alias("links"), F.count("*").alias("npis"))
    w = W.partitionBy("source", "dimension")  # a row for each outcome
    return sums.select("*", percent(F.col("links"), F.sum("links").over(w)).alias("links_pct"), percent(F.col("npis"), F.sum("npis").over(w)).alias("npis_pct"))


def sequence_totals(summary: DataFrame, linked: DataFrame, least: int = 3) -> DataFrame:
    """Q25: e-mails with and without dated history, enough of it, swaps and returns; one row an e-mail, whatever its links."""
    emails = linked.groupBy(*EMAIL).agg(F.bool_or(F.col("undated_observation_count") > 0).alias("undated")).join(summary, EMAIL, "left")
    dated = F.col("versions").isNotNull()
    out = emails.groupBy("source").agg(
        F.count("*").alias("emails"), F.count_if(dated).alias("dated_emails"), F.count_if(~dated).alias("undated_emails"), F.count_if(F.col("versions") >= least).alias("sufficient_emails"),
        F.count_if(F.col("swaps") > 0).alias("emails_with_swaps"), F.count_if(F.col("flipbacks") > 0).alias("emails_with_flipbacks"), F.count_if("undated").alias("incomplete_emails"))
    return out.withColumn("swap_pct", percent(F.col("emails_with_swaps"), F.col("dated_emails")))


def claims_bands(records: DataFrame) -> DataFrame:
    """Links by whether claims back the facility and how many there are, with the median claims."""
    c, b = F.col("facility_claim_count"), F.col("facility_claims_backed")
    return records.groupBy("source").agg(
        F.count("*").alias("links"), F.count_if(b.isNull()).alias("no_row"), F.count_if(b).alias("backed"), F.count_if(~b).alias("not_backed"), F.count_if(b.isNotNull() & c.isNull()).alias("no_count"),
        F.count_if(c.between(1, 9)).alias("claims_1_9"), F.count_if(c.between(10, 99)).alias("claims_10_99"), F.count_if(c >= 100).alias("claims_100_plus"), F.percentile_approx(c, 0.5, 1_000_000).alias("claims_p50"))


def domain_concentration(linked: DataFrame, domains: DataFrame) -> DataFrame:
    """Q28: links by domain class, and how concentrated their domains are."""
    from tessel.functions.text import email_domain, email_domain_class

    rows = linked.select(*KEY, email_domain(F.col("email")).alias("domain"), email_domain_class(F.col("email")).alias("email_domain_class")).join(domains.drop("domain_class"), ["source", "domain"], "left")
    return rows.groupBy("source", "email_domain_class").agg(
        F.count("*").alias("links"), F.countDistinct("domain").alias("domains"), F.count_if(F.col("domain_npi_count") == 1).alias("single_npi_links"), F.count_if(F.col("domain_npi_count") >= 10).alias("links_of_ten_npis"),
        F.percentile_approx("domain_npi_count", 0.5, 1_000_000).alias("npis_p50"), F.count_if(F.col("top_state_share") == 1).alias("single_state_links"), F.count_if(F.col("top_facility_share") >= 0.5).alias("top_facility_half_links"))


def general_profile(linked: DataFrame) -> DataFrame:
    """Q30: links, e-mails, npis, observations and days of a source."""
    n, days = F.col("observation_count"), F.size("observed_days")
    return linked.groupBy("source").agg(
        F.count("*").alias("links"), F.countDistinct("email").alias("emails"), F.countDistinct("npi").alias("npis"), F.sum(n).alias("observations"), F.count_if(n > 1).alias("repeated_links"),
        F.percentile_approx(n, 0.5, 1_000_000).alias("p50"), F.percentile_approx(n, 0.95, 1_000_000).alias("p95"), F.max(n).alias("most"), F.min("first_seen_day").alias("first_seen_day"), F.max("last_seen_day").alias("last_seen_day"),
        F.count_if(days > 0).alias("dated_links"), F.count_if(days > 1).alias("many_day_links"), F.count_if(F.col("undated_observation_count") > 0).alias("links_with_undated"))


def answer_profile(metrics: DataFrame, answers: list[str]) -> DataFrame:
    """Each of several three-valued answers in one scan: links and distinct e-mails that are true, false or unknown."""
    rows = metrics.select("source", "email", F.inline(F.array(*[F.struct(F.lit(a).alias("metric"), F.col(a).alias("value")) for a in answers])))
    v = F.col("value")
    kinds = {"matched": v, "unmatched": ~v, "unknown": v.isNull()}
    return rows.groupBy("source", "metric").agg(
        F.count("*").alias("links"), F.countDistinct("email").alias("emails"), *[F.count_if(r).alias(f"{k}_links") for k, r in kinds.items()],
        *[F.countDistinct(F.when(r, F.col("email"))).alias(f"{k}_emails") for k, r in kinds.items()])


def opt_out_impact(linked: DataFrame, excluded: DataFrame) -> DataFrame:
    """Q32: what an opt-out list takes from each source."""
    gone = excluded.select(F.col("npi_clean").alias("npi")).where("npi IS NOT NULL").distinct().withColumn("_x", F.lit(True))
    x = F.coalesce("_x", F.lit(False))
    rows = linked.join(gone, "npi", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("links"), F.count_if(x).alias("excluded_links"), F.countDistinct(F.when(x, F.col("npi"))).alias("excluded_npis"), F.countDistinct(F.when(x, F.col("email"))).alias("excluded_emails"),
        percent(F.count_if(x), F.count("*")).alias("excluded_pct"))


def peer_rows(compared: DataFrame) -> DataFrame:
    """Every comparison of a link with a peer, a row each."""
    return compared.select(*KEY, F.inline("comparisons"))


def latest_differences(any_: DataFrame, latest: DataFrame, answer: str) -> DataFrame:
    """Q05, Q07: links whose answer over all versions is not that of the latest one. `latest` has a row only for links with a latest version."""
    both = any_.select(*KEY, F.col(answer).alias("a")).join(latest.select(*KEY, F.col(answer).alias("l"), F.lit(True).alias("has")), KEY, "left")
    has = F.coalesce("has", F.lit(False))
    return both.groupBy("source").agg(
        F.count("*").alias("links"), F.count_if(has).alias("links_with_latest"), F.count_if(has & ~F.col("a").eqNullSafe(F.col("l"))).alias("differing_links"),
        F.count_if(F.col("a") & ~F.col("l")).alias("any_not_latest_links"), F.count_if(has & F.col("a") & F.col("l").isNull()).alias("any_unknown_latest_links"))


def version_totals(records: DataFrame) -> DataFrame:
    """Q01: versions merged into the links of a source."""
    n = F.col("record_count")
    return records.groupBy("source").agg(F.count("*").alias("links"), F.sum(n).alias("versions"), F.count_if(n > 1).alias("multi_version_links"), F.max(n).alias("most_versions"), F.count_if(~F.col("has_latest")).alias("links_without_latest"))
