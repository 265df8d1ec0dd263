"""Reference lookups by npi: registry lifecycle and entity, facilities, claims, taxonomy; what a source's states and labels say next to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators.links import EMAIL, KEY

TEN_DIGITS = r"\A[0-9]{10}\z"
TEXTS, DAYS = "array<string>", "array<date>"


def _texts(c) -> Column:
    return F.coalesce(c, F.array().cast(TEXTS))


def facility_npis(associations: DataFrame) -> DataFrame:
    """Sorted distinct facility identifiers of a provider over all ranks; only ten digits, not all zero."""
    one = associations.select(F.trim("npi").alias("npi"), F.explode_outer(F.col("facility_npis")).alias("f")).withColumn("f", F.trim("f"))
    valid = F.when(F.col("f").rlike(TEN_DIGITS) & (F.col("f") != "0000000000"), F.col("f"))
    return one.where("npi <> ''").groupBy("npi").agg(F.array_sort(F.collect_set(valid)).alias("facility_npi_values"))


def taxonomy_codes(providers: DataFrame, columns: list[str], dictionary: DataFrame) -> DataFrame:
    """Recognised taxonomy codes of a provider, from all slots; exact codes of ten letters or digits, no labels."""
    known = dictionary.select(F.upper(F.trim("code")).alias("code")).where(F.col("code").rlike(r"\A[0-9A-Z]{10}\z")).distinct()
    codes = providers.select(F.trim(F.col("npi").cast("string")).alias("npi"), F.explode(F.array(*columns)).alias("code")).withColumn("code", F.upper(F.trim("code")))
    return codes.where("npi <> ''").join(known, "code").groupBy("npi").agg(F.array_sort(F.collect_set("code")).alias("specialty_code_values"))


def registry_status(records: DataFrame, as_of: str) -> DataFrame:
    """The status that a registry's reported dates and replacement give, with the first of its reasons that holds, and the evidence.

    records: npi, deactivated, reactivated, replacement, reason (texts). Records of one npi that differ, blanks and nulls alike, are conflicting.
    """
    names = ["deactivated", "reactivated", "replacement", "reason"]
    raw = F.struct(*names)
    variant = F.struct(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in names])
    one = records.where("npi IS NOT NULL").groupBy(F.trim(F.col("npi").cast("string")).alias("npi")).agg(F.count("*").alias("reference_rows"), F.collect_set(variant).alias("variants"), F.array_sort(F.collect_set(raw)).alias("evidence"))
    v = F.try_element_at("variants", F.lit(1))
    one = one.withColumns({"n": F.size("variants"), "d": T.parse_day(v["deactivated"]), "r": T.parse_day(v["reactivated"]), "to": v["replacement"], "why": v["reason"], "d_text": v["deactivated"], "r_text": v["reactivated"]})
    d, r, to, limit = F.col("d"), F.col("r"), F.col("to"), F.lit(as_of).cast("date")
    sound = to.rlike(TEN_DIGITS) & (to != "0000000000")
    reason = (
        F.when(F.col("n") != 1, "conflicting_reference_records").when((F.col("d_text").isNotNull() & d.isNull()) | (F.col("r_text").isNotNull() & r.isNull()), "invalid_lifecycle_date")
        .when((d > limit) | (r > limit), "future_lifecycle_date").when(to == F.col("npi"), "self_replacement").when(~sound, "invalid_replacement_npi")
        .when(F.col("why").isNotNull() & d.isNull(), "reason_without_deactivation").when(d == r, "ambiguous_event_order").when(to.isNotNull() & r.isNotNull() & (d.isNull() | (r > d)), "replacement_with_reactivation")
        .when(to.isNotNull(), "replacement_reported").when(d.isNotNull() & (r.isNull() | (d > r)), "latest_event_deactivation").when(r.isNotNull(), "latest_event_reactivation").otherwise("no_deactivation_reported")
    )
    out = one.withColumn("status_reason", reason)
    status = F.lit("unknown")
    for name, of in (("replaced", "replacement_reported"), ("deactivated", "latest_event_deactivation"), ("reactivated", "latest_event_reactivation"), ("active_as_reported", "no_deactivation_reported")):
        status = F.when(F.col("status_reason") == of, name).otherwise(status)
    single = F.col("n") == 1
    return out.select(
        "npi", status.alias("status"), "status_reason", F.when(single & sound & (to != F.col("npi")), to).alias("replacement_npi"), F.when(single, d).alias("deactivation_date"),
        F.when(single, r).alias("reactivation_date"), "reference_rows", F.col("n").cast("long").alias("variants"), "evidence")


def registry_records(linked: DataFrame, lookup: DataFrame, as_of: str) -> DataFrame:
    """L13 for links: not_found where the registry has no record."""
    out = linked.join(lookup, "npi", "left")
    return out.withColumns({
        "status": F.coalesce("status", F.lit("not_found")), "status_reason": F.coalesce("status_reason", F.lit("no_registry_record")), "reference_rows": F.coalesce("reference_rows", F.lit(0)),
        "variants": F.coalesce("variants", F.lit(0)), "status_as_of_day": F.lit(as_of).cast("date")})


def npi_identity(linked: DataFrame, registry: DataFrame) -> DataFrame:
    """Format, checksum and structure of each link's identifier, and the entity type that all its registry records agree on.

    Links and identifiers meet null-safe: null and empty identifiers are different ones.
    """
    code = F.struct(F.nullif(F.trim("entity"), F.lit("")).alias("code"))
    known = registry.where("npi IS NOT NULL").groupBy(F.trim(F.col("npi").cast("string")).alias("_npi")).agg(F.count("*").alias("reference_rows"), F.array_sort(F.collect_set(F.struct("entity"))).alias("evidence"), F.collect_set(code).alias("codes"))
    npi = F.col("npi")
    ids = linked.select("npi").distinct().join(known, npi == F.col("_npi"), "left").drop("_npi")
    one = F.try_element_at("codes", F.lit(1))["code"]
    reason = (
        F.when(F.col("reference_rows").isNull(), "not_found").when(F.size("codes") != 1, "conflicting_reference_records").when(one.isNull(), "missing_entity_type")
        .when(~one.isin("1", "2"), "unrecognized_entity_type").otherwise("registry_consensus")
    )
    ids = ids.withColumns({
        "format_valid": F.when(T.clean_text(npi).isNotNull(), npi.rlike(r"\A[1-4][0-9]{9}\z")), "checksum_valid": T.npi_checksum_valid(npi), "structure_reason": T.npi_structure_reason(npi), "entity_reason": reason,
        "entity_type": F.when((reason == "registry_consensus") & (one == "1"), "individual").when((reason == "registry_consensus") & (one == "2"), "organization").otherwise("unknown"),
        "reference_rows": F.coalesce("reference_rows", F.lit(0)), "variant_count": F.greatest(F.coalesce(F.size("codes"), F.lit(0)), F.lit(0)).cast("long"),
    }).withColumn("structure_valid", F.col("format_valid") & F.col("checksum_valid")).drop("codes")
    return linked.alias("m").join(ids.alias("i"), F.col("m.npi").eqNullSafe(F.col("i.npi")), "left").select("m.*", *[f"i.{c}" for c in ids.columns if c != "npi"])


def facility_states(locations: DataFrame) -> DataFrame:
    """The one state of a provider's facilities of first rank, with why there is none."""
    rows = locations.where("rank = 1").select(F.trim(F.col("npi").cast("string")).alias("npi"), T.state_code(F.col("state")).alias("state"), T.clean_text(F.col("location")).alias("location")).where("npi <> ''")
    sums = rows.groupBy("npi").agg(
        F.count("*").alias("facility_rows"), F.countDistinct("state").alias("facility_state_count"), F.count_if(F.col("state").isNull()).alias("facility_unknown_state_rows"),
        F.count_if(F.col("location").isNull()).alias("facility_missing_location_rows"), F.max("state").alias("state"))
    status = (
        F.when(F.col("facility_state_count") > 1, "ambiguous_state").when(F.col("facility_missing_location_rows") > 0, "missing_location")
        .when(F.col("facility_unknown_state_rows") > 0, "missing_state").otherwise("usable")
    )
    return sums.withColumn("facility_reference_status", status).withColumn("facility_primary_state", F.when(status == "usable", F.col("state"))).drop("state")


def facility_claims(associations: DataFrame) -> DataFrame:
    """Claims and source labels of a provider's association of first rank."""
    rows = associations.where("rank = 1").select(F.trim("npi").alias("npi"), "claims", F.explode_outer(F.split(F.coalesce("sources", F.lit("")), ",")).alias("s")).where("npi <> ''")
    return rows.groupBy("npi").agg(F.max("claims").alias("facility_claim_count"), F.array_sort(F.collect_set(F.nullif(F.trim("s"), F.lit("")))).alias("facility_sources"))


def state_verdict(states: Column) -> Column:
    """A source's states against the facility's: five outcomes, in order."""
    own = F.col("facility_primary_state")
    return (
        F.when(F.col("facility_reference_status") != "usable", "unknown_facility").when(F.size(states) == 0, "unknown_vendor_state")
        .when(F.array_contains(states, own), F.when(F.size(states) == 1, "corroborated").otherwise("mixed_vendor_states")).otherwise("not_corroborated")
    )


def facility_records(linked: DataFrame, states: DataFrame, claims: DataFrame) -> DataFrame:
    """L14, L15 for links with source_state_values and source_state_values_latest (null without a latest version)."""
    out = linked.join(states, "npi", "left").join(claims.withColumn("_c", F.lit(True)), "npi", "left")
    counts = ["facility_rows", "facility_state_count", "facility_unknown_state_rows", "facility_missing_location_rows"]
    out = out.withColumns({"facility_reference_status": F.coalesce("facility_reference_status", F.lit("no_rank1_association")), **{c: F.coalesce(c, F.lit(0)) for c in counts},
        "facility_claims_backed": F.when(F.col("_c"), F.array_contains("facility_sources", "Claims")), "facility_sources": _texts("facility_sources")})
    out = out.withColumn("vendor_state_evidence", state_verdict(F.col("source_state_values"))).withColumn("vendor_state_evidence_latest", F.when(F.col("source_state_values_latest").isNotNull(), state_verdict(F.col("source_state_values_latest"))))
    known = lambda c: F.when(F.col(c) == "corroborated", True).when(F.col(c) == "not_corroborated", False)
    return out.withColumn("vendor_state_corroborated", known("vendor_state_evidence")).withColumn("vendor_state_corroborated_latest", known("vendor_state_evidence_latest")).drop("_c")


def daily_labels(metadata: DataFrame, specialties: list[str], professions: list[str], by: list[str] = ("npi", "day")) -> DataFrame:
    """Labels that a source gives an npi on a day (or an npi, day and registration guid)."""
    found = metadata.where("npi IS NOT NULL AND day IS NOT NULL").groupBy(*by).agg(*[
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(*[F.col(c).cast("string") for c in cols]) if cols else F.array().cast(TEXTS), lambda x: x.isNotNull()))))).alias(f"raw_{n}")
        for n, cols in (("specialties", specialties), ("professions", professions))])
    return found


def professional_labels(linked: DataFrame, labels: DataFrame, dated: bool = True) -> DataFrame:
    """Labels of a link's own days, and whether other npis of its e-mail in conflict on the same day have one of them.

    `linked`: the key, observed_days, conflict_days, has_conflict_linkage. Each link has a row a day (one of null without any). Peers meet by
    (source, email, day), or by (source, email) in undated sources. Sharing is true, false, or null where a side has no label.
    """
    days = linked.select(*KEY, "conflict_days", "has_conflict_linkage", F.explode_outer("observed_days").alias("day")).join(labels, ["npi", "day"], "left")
    days = days.withColumns({n: T.vendor_labels(_texts(f"raw_{n}")) for n in ("specialties", "professions")})
    in_conflict = days.where(F.col("has_conflict_linkage") & (F.array_contains("conflict_days", F.col("day")) if dated else F.lit(True)))
    by = [*EMAIL, "day"] if dated else EMAIL
    peers = in_conflict.select(*by, F.col("npi").alias("peer"), F.col("specialties").alias("s2"), F.col("professions").alias("p2"))
    pairs = in_conflict.select(*dict.fromkeys([*KEY, *by]), "specialties", "professions").join(peers, by).where("npi <> peer")
    shares = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))
    judged = pairs.withColumns({"specialty": shares("specialties", "s2"), "profession": shares("professions", "p2")})
    told = judged.groupBy(*KEY).agg(*[F.when(F.count_if(c) > 0, True).when(F.count_if(F.col(c).isNull()) > 0, F.lit(None)).otherwise(False).alias(f"conflicting_npis_share_vendor_{c}") for c in ("specialty", "profession")],
        F.count("*").alias("comparisons"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    own = days.groupBy(*KEY).agg(union("specialties").alias("vendor_specialty_values"), union("professions").alias("vendor_profession_values"),
        F.array_sort(F.collect_set(F.struct("day", "specialties", "professions"))).alias("vendor_professional_evidence"))
    return own.join(told, KEY, "left").withColumn("comparisons", F.coalesce("comparisons", F.lit(0)))


def registration_status(guid_days: DataFrame, undated: DataFrame, as_of: str) -> DataFrame:
    """Per link its most recently seen registration, and whether that registration has since moved to another npi.

    guid_days: the key, guid and day (null: seen without one); undated: (source, email, npi) of links with undated observations.
    """
    limit = F.lit(as_of).cast("date")
    seen = guid_days.select(*KEY, "guid", F.when(F.col("day") <= limit, F.col("day")).alias("day")).distinct()
    links = seen.groupBy(*KEY, "guid").agg(F.max("day").alias("link_last_day"))
    open_ = undated.select(*KEY).distinct().withColumn("_u", F.lit(True))
    group = [*EMAIL, "guid"]
    per = seen.join(open_, KEY, "left").groupBy(*group).agg(F.max("day").alias("latest_day"), F.bool_or(F.coalesce("_u", F.lit(False))).alias("has_undated"))
    last = per.where("latest_day IS NOT NULL").alias("p").join(seen.alias("s"), F.expr("p.source = s.source AND p.email = s.email AND p.guid <=> s.guid AND p.latest_day = s.day"))
    holders = last.groupBy("p.source", "p.email", "p.guid").agg(F.array_sort(F.collect_set("s.npi")).alias("latest_npis"))
    same = lambda a, b: F.expr(f"{a}.source = {b}.source AND {a}.email = {b}.email AND {a}.guid <=> {b}.guid")
    later = links.alias("l").join(seen.alias("n"), same("l", "n") & F.expr("n.day > l.link_last_day")).groupBy(*[F.col(f"l.{c}").alias(c) for c in (*KEY, "guid")]).agg(F.min("n.day").alias("replaced_since"))
    rows = links.alias("l").join(per.alias("p"), same("l", "p")).join(holders.alias("h"), same("l", "h"), "left").join(later.alias("t"), same("l", "t") & F.expr("l.npi = t.npi"), "left")
    rows = rows.select("l.*", "p.latest_day", "p.has_undated", _texts(F.col("h.latest_npis")).alias("latest_npis"), "t.replaced_since")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc_nulls_last("link_last_day"), F.asc_nulls_last("guid")))).where("_n = 1").drop("_n")
    known = F.col("guid").isNotNull() & F.col("latest_day").isNotNull() & F.col("link_last_day").isNotNull() & ~F.col("has_undated")
    mine = F.array_contains("latest_npis", F.col("npi"))
    status = F.when(~known, "unknown").when(F.size("latest_npis") != 1, "ambiguous_latest").when(mine, "latest_observed").otherwise("superseded")
    gone = status == "superseded"
    has = F.col("guid").isNotNull()
    return rows.select(
        *KEY, F.col("guid").alias("registration_guid"), status.alias("registration_link_status"), F.when(has, F.col("latest_day")).alias("registration_latest_day"),
        F.when(has, F.col("latest_npis")).otherwise(F.array().cast(TEXTS)).alias("registration_latest_npis"), F.when(has, F.col("link_last_day")).alias("registration_link_last_day"),
        F.when(gone, F.col("replaced_since")).alias("registration_superseded_since_day"), F.when(gone, F.col("latest_npis")).otherwise(F.array().cast(TEXTS)).alias("registration_superseded_by_npis"))
