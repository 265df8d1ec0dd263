"""Queries of statistics by source, of the whole chain of link evidence, and of invariants on sound and on tampered evidence.

Their SQL reads other oracles as subqueries, so that each number is worked out in SQL from the driver's tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import invariants as N
from tessel.operators import links as L
from tessel.operators import names as A
from tessel.operators import references as X
from tessel.operators import relational as R
from tessel.operators import statistics as S
from tessel.plans import link_queries as Q
from tessel.plans.inputs import load, with_inputs
from tessel.plans.queries import LINKS, ORACLE_SQL, _claims, _conflicts, _links, g20_publish, joined, query, rounded, share, shared_steps
from tessel.session import materialise, shared_folder
from tessel.sources.keyed import write_keyed


def sub(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


ANSWERS = ["email_matches_source_name", "email_matches_registry_name", "vendor_name_matches_registry_name"]


def _metrics(spark, sf):
    return materialise(A.link_name_metrics(Q._compared(spark, sf)))


def d_flag(c):
    return f"count(*) FILTER ({c}) AS {c}_true, count(*) FILTER (NOT {c}) AS {c}_false, count(*) FILTER ({c} IS NULL) AS {c}_unknown, round(100.0::double * count(*) FILTER ({c}) / count(*), 6) AS {c}_true_pct"


@query(LINKS + f""", f AS (SELECT source, regexp_full_match(email, '[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{{2,}}') AS valid, coalesce(regexp_extract(email, '^([^@]+)@', 1) IN ({", ".join(f"'{x}'" for x in T.ROLE_ACCOUNTS)}), false) AS role FROM l)
SELECT source, count(*) AS rows, {d_flag("valid")}, {d_flag("role")} FROM f GROUP BY source""")
def q02_email_rates(spark, sf):
    e = F.col("email")
    rows = _links(spark, sf).select("source", T.email_format_valid(e).alias("valid"), T.email_role_account(e).alias("role"))
    return rounded(S.flag_rates(rows, ["source"], ["valid", "role"]), "valid_true_pct", "role_true_pct")


@query(f"SELECT source, count(*) AS rows, {', '.join(d_flag(c) for c in ANSWERS)} FROM {sub('l07_names')} GROUP BY source")
def q05_name_rates(spark, sf):
    return rounded(S.flag_rates(_metrics(spark, sf), ["source"], ANSWERS), *[f"{c}_true_pct" for c in ANSWERS])


#: Comparisons of the latest version's name alone.
LATEST = Q.LINK_RECORDS.replace(with_inputs("observations"), Q.NAMES, 1).replace("WHERE npi NOT IN (SELECT npi_clean FROM out) ", "") + f""", ln AS (SELECT source, email, npi, max(f) FILTER (latest) AS fa, max(s) FILTER (latest) AS la FROM x GROUP BY ALL HAVING count(*) FILTER (latest) > 0),
ls AS (SELECT ln.*, {Q.d_set("fa")} AS sa, regexp_replace(lower(regexp_extract(email, '^([^@]*)@', 1)), '[^a-z]', '', 'g') AS local FROM ln LEFT JOIN variants ON token = split_part(fa, ' ', 1)), lm AS (SELECT source, email, npi, {Q.d_fuzzy("local", "sa", "la")} AS m FROM ls)"""


@query(LATEST + """, am AS (SELECT source, email, npi, bool_or(sm) AS m FROM cmp GROUP BY ALL) SELECT a.source, count(*) AS links, count(lm.npi) AS links_with_latest, count(*) FILTER (lm.npi IS NOT NULL AND a.m IS DISTINCT FROM lm.m) AS differing_links, count(*) FILTER (a.m AND NOT lm.m) AS any_not_latest_links,
count(*) FILTER (lm.npi IS NOT NULL AND a.m AND lm.m IS NULL) AS any_unknown_latest_links FROM am a LEFT JOIN lm ON lm.source = a.source AND lm.email = a.email AND lm.npi = a.npi GROUP BY a.source""")
def q05_latest(spark, sf):
    records = materialise(_all_records(spark, sf))
    latest = records.where("latest_record_id IS NOT NULL").select(*L.KEY, F.col("latest_first_name").alias("first_name"), F.col("latest_last_name").alias("last_name"))
    v = Q._variants(spark)
    now = A.link_name_metrics(A.compared_names(latest, A.registry_names(load(spark, sf, "registry_names"), v), v))
    return S.latest_differences(_metrics(spark, sf), now, "email_matches_source_name")


def _all_records(spark, sf):
    """Links of versions, opted out or not."""
    staged = Q.R.stage(load(spark, sf, "observations").withColumn("day", F.col("day").cast("string")))
    v = Q.R.record_versions(staged, Q.SPEC, None, "events").withColumn("email_list", F.col("email")).drop("email")
    code = T.state_code(F.col("state"))
    one = Q.R.emails_of_list(v, "email_list").withColumns({"source_tables": F.array(F.lit("events")), "first_name": T.norm_name(F.col("first_name")), "last_name": T.norm_name(F.col("last_name")),
        "state_values": F.filter(F.array(code), lambda x: x.isNotNull()), "specialty_values": F.filter(F.array(T.vendor_label(F.col("specialty"))), lambda x: x.isNotNull())})
    return Q.R.link_records(one).withColumn("source_state_values_latest", F.when(F.col("latest_record_id").isNotNull(), F.col("source_state_values_latest")))


@query(f"""WITH m AS {sub('l07_names')}, t AS (SELECT source, count(*) AS links_total, count(*) FILTER (contains(match_classes, '|')) AS links_with_multiple_classes FROM m GROUP BY source), c AS (SELECT source, unnest(string_split(match_classes, '|')) AS match_class, contains(match_classes, '|') AS k, vendor_name_matches_registry_name AS v FROM m)
SELECT c.source, match_class, count(*) AS links_with_class, count(*) FILTER (k) AS links_with_other_classes, count(*) FILTER (v) AS links_with_true_aggregate, any_value(links_total) AS links_total, any_value(links_with_multiple_classes) AS links_with_multiple_classes, round(100.0::double * count(*) / any_value(links_total), 6) AS pct FROM c JOIN t ON t.source = c.source GROUP BY ALL""")
def q07_classes(spark, sf):
    return rounded(S.class_overlap(_metrics(spark, sf)), "pct")


@query(f"""WITH e AS (SELECT source, email, max(email_name_count) AS n, count(*) AS links, count(*) FILTER (email_npi_has_name_conflict) AS c, count(*) FILTER (NOT email_npi_has_name_conflict) AS a, count(*) FILTER (email_npi_has_name_conflict IS NULL) AS u FROM {sub('l09_name_history')} GROUP BY ALL)
SELECT source, count(*) AS emails, sum(links)::bigint AS links, count(*) FILTER (n = 0) AS no_name_emails, count(*) FILTER (n = 1) AS one_name_emails, count(*) FILTER (n = 2) AS two_name_emails, count(*) FILTER (n = 3) AS three_name_emails, count(*) FILTER (n > 3) AS more_name_emails, max(n) AS most_names,
sum(c)::bigint AS conflicting_links, sum(a)::bigint AS agreeing_links, sum(u)::bigint AS unknown_links, round(100.0::double * sum(c) / sum(links), 6) AS conflicting_pct FROM e GROUP BY source""")
def q11_name_counts(spark, sf):
    return rounded(S.name_counts(A.name_history(_metrics(spark, sf))), "conflicting_pct")


#: Peers of links in conflict with arrays of values by npi.
PEER_VALUES = """, v AS (SELECT npi, list(DISTINCT f) AS vals FROM fv GROUP BY npi), p AS (SELECT DISTINCT a.source, a.email, a.npi, b.npi AS peer FROM lc a JOIN lc b ON a.source = b.source AND a.email = b.email AND a.d = b.d AND a.npi <> b.npi)
SELECT p.source, p.email, p.npi, count(*) AS peers, CASE WHEN count(*) FILTER (list_has_any(x.vals, y.vals)) > 0 THEN true WHEN count(*) FILTER (x.vals IS NULL OR y.vals IS NULL) > 0 THEN NULL ELSE false END AS shares FROM p LEFT JOIN v x ON p.npi = x.npi LEFT JOIN v y ON p.peer = y.npi GROUP BY ALL"""


def _peer_values(spark, sf, values):
    linked = _conflicts(spark, sf)
    npi, vals = values.columns
    return L.conflict_peers(linked, linked.select(*L.KEY).join(values.select("npi", F.col(vals).alias("vals")), "npi"))


@query(LINKS.replace(with_inputs("observations", "npi_states"), with_inputs("observations", "npi_states", "facilities"), 1) + ", fv AS (SELECT npi, f FROM (SELECT npi, trim(unnest(string_split(facility_npis, '|'))) AS f FROM facilities) WHERE regexp_full_match(f, '[0-9]{10}') AND f <> '0000000000')" + PEER_VALUES)
def l10_peer_facilities(spark, sf):
    return _peer_values(spark, sf, Q._facility_npis(spark, sf)).select(*L.KEY, "peers", "shares")


@query(LINKS.replace(with_inputs("observations", "npi_states"), with_inputs("observations", "npi_states", "taxonomy", "provider_codes"), 1) + ", fv AS (SELECT u.npi, u.f FROM (SELECT npi, upper(trim(unnest([code_1, code_2, code_3]))) AS f FROM provider_codes) u JOIN taxonomy t ON t.code = u.f)" + PEER_VALUES)
def l10_peer_taxonomy(spark, sf):
    return _peer_values(spark, sf, Q._taxonomy(spark, sf)).select(*L.KEY, "peers", "shares")


def _shares(spark, sf, values):
    linked = _conflicts(spark, sf)
    return L.conflict_shares(linked, linked.select(*L.KEY).join(values.toDF("npi", "vals"), "npi"))


@query(f"SELECT source, email, npi, shares FROM {sub('l10_peer_states')}")
def l10_state_shares(spark, sf):
    return _shares(spark, sf, load(spark, sf, "npi_states").groupBy("npi").agg(F.collect_set("state")))


@query(f"SELECT source, email, npi, shares FROM {sub('l10_peer_taxonomy')}")
def l10_taxonomy_shares(spark, sf):
    return _shares(spark, sf, Q._taxonomy(spark, sf))


DIMENSIONS = {"name": "l10_peer_names", "state": "l10_peer_states", "facility": "l10_peer_facilities", "taxonomy": "l10_peer_taxonomy"}


@query(f"WITH c AS {sub('l06_conflicts')} " + " UNION ALL ".join(f"""SELECT c.source, count(*) AS links, count(*) FILTER (has_conflict_linkage) AS conflict_links, count(DISTINCT c.email) FILTER (has_conflict_linkage) AS conflict_emails, count(*) FILTER (shares) AS shared, count(*) FILTER (NOT shares) AS different,
count(*) FILTER (has_conflict_linkage AND shares IS NULL) AS unknown, count(*) FILTER (NOT has_conflict_linkage) AS not_applicable, count(*) FILTER (has_conflict_linkage IS NULL) AS unknown_timing, '{d}' AS dimension, round(100.0::double * count(*) FILTER (shares) / nullif(count(*) FILTER (has_conflict_linkage), 0), 6) AS shared_pct
FROM c LEFT JOIN {sub(q)} s ON s.source = c.source AND s.email = c.email AND s.npi = c.npi GROUP BY c.source""" for d, q in DIMENSIONS.items()))
def q13_shared_values(spark, sf):
    with shared_steps():
        found = {"name": Q.l10_name_shares(spark, sf), "state": l10_state_shares(spark, sf), "facility": _shares(spark, sf, Q._facility_npis(spark, sf)), "taxonomy": l10_taxonomy_shares(spark, sf)}
        return rounded(S.shared_values(_conflicts(spark, sf), found), "shared_pct")


@query(f"""WITH c AS {sub('l06_conflicts')}, s AS {sub('l19_labels')} SELECT c.source, dimension, count(*) AS links, count(*) FILTER (has_conflict_linkage) AS conflict_links, count(DISTINCT c.email) FILTER (has_conflict_linkage) AS conflict_emails, count(*) FILTER (shares) AS shared, count(*) FILTER (NOT shares) AS different,
count(*) FILTER (has_conflict_linkage AND shares IS NULL) AS unknown, count(*) FILTER (NOT has_conflict_linkage) AS not_applicable, count(*) FILTER (has_conflict_linkage IS NULL) AS unknown_timing, round(100.0::double * count(*) FILTER (shares) / nullif(count(*) FILTER (has_conflict_linkage), 0), 6) AS shared_pct
FROM c JOIN (SELECT source, email, npi, 'specialty' AS dimension, conflicting_npis_share_vendor_specialty AS shares FROM s UNION ALL SELECT source, email, npi, 'profession', conflicting_npis_share_vendor_profession FROM s) s ON s.source = c.source AND s.email = c.email AND s.npi = c.npi GROUP BY ALL""")
def q23_shared_labels(spark, sf):
    labels = materialise(Q._labels(spark, sf))
    parts = {d: labels.select(*L.KEY, F.col(f"conflicting_npis_share_vendor_{d}").alias("shares")) for d in ("specialty", "profession")}
    return rounded(S.shared_values(_conflicts(spark, sf), parts), "shared_pct")


@query(with_inputs("registry") + "".join([" SELECT * FROM (", " UNION ALL ".join(f"""SELECT count(*) AS rows, count(DISTINCT npi) AS npis, '{c}' AS column, count({c}) AS values, {f"count(*) FILTER (nullif(trim({c}), '') IS NOT NULL AND try_cast(trim({c}) AS date) IS NULL)" if c in ("deactivated", "reactivated") else "0::bigint"} AS invalid FROM registry""" for c in ("deactivated", "reactivated", "replacement", "reason")), ")"]))
def q17_availability(spark, sf):
    return S.availability(load(spark, sf, "registry"), ["deactivated", "reactivated", "replacement", "reason"], ["deactivated", "reactivated"])


@query(f"SELECT source, status, status_reason, count(*) AS links, count(DISTINCT (email, npi)) AS pairs, count(DISTINCT npi) AS npis FROM {sub('l13_registry_links')} GROUP BY ALL")
def q17_registry(spark, sf):
    return S.outcome_counts(Q.l13_registry_links(spark, sf), ["source", "status", "status_reason"])


@query(f"SELECT source, vendor_state_evidence, facility_reference_status, count(*) AS links, count(DISTINCT (email, npi)) AS pairs, count(DISTINCT npi) AS npis FROM {sub('l14_vendor_facility')} GROUP BY ALL")
def q18_state_outcomes(spark, sf):
    return S.outcome_counts(Q._facility_links(spark, sf), ["source", "vendor_state_evidence", "facility_reference_status"])


@query(f"""SELECT source, location_status, vendor_state_comparison, facility_state_comparison, CASE WHEN grouping(location_status) = 0 THEN 'location_status' WHEN grouping(vendor_state_comparison) = 0 THEN 'vendor_state_comparison' WHEN grouping(facility_state_comparison) = 0 THEN 'facility_state_comparison' ELSE 'totals' END AS section,
count(*) AS links, count(DISTINCT email) AS emails, count(DISTINCT (email, npi)) AS pairs FROM {sub('l26_location_records')} GROUP BY GROUPING SETS ((source), (source, location_status), (source, vendor_state_comparison), (source, facility_state_comparison))""")
def q19_location_sections(spark, sf):
    return S.location_sections(Q._location(spark, sf))


@query(f"""WITH n AS (SELECT source, npi, structure_reason, entity_type, entity_reason, count(*) AS links FROM {sub('l18_identity')} GROUP BY ALL), o AS (SELECT source, links, 'structure_reason' AS dimension, structure_reason AS outcome FROM n UNION ALL SELECT source, links, 'entity_type', entity_type FROM n UNION ALL SELECT source, links, 'entity_reason', entity_reason FROM n),
g AS (SELECT source, dimension, outcome, sum(links)::bigint AS links, count(*) AS npis FROM o GROUP BY ALL) SELECT *, round(100.0::double * links / sum(links) OVER (PARTITION BY source, dimension), 6) AS links_pct, round(100.0::double * npis / sum(npis) OVER (PARTITION BY source, dimension), 6) AS npis_pct FROM g""")
def q22_identity(spark, sf):
    return rounded(S.identity_outcomes(Q.l18_identity(spark, sf)), "links_pct", "npis_pct")


@query(f"""WITH s AS {sub('l20_sequence')}, u AS (SELECT source, email, bool_or(day IS NULL) AS undated FROM ({with_inputs("observations")} SELECT * FROM observations) GROUP BY ALL)
SELECT u.source, count(*) AS emails, count(versions) AS dated_emails, count(*) FILTER (versions IS NULL) AS undated_emails, count(*) FILTER (versions >= 3) AS sufficient_emails, count(*) FILTER (swaps > 0) AS emails_with_swaps, count(*) FILTER (flipbacks > 0) AS emails_with_flipbacks, count(*) FILTER (undated) AS incomplete_emails,
round(100.0::double * count(*) FILTER (swaps > 0) / nullif(count(versions), 0), 6) AS swap_pct FROM u LEFT JOIN s ON s.source = u.source AND s.email = u.email GROUP BY u.source""")
def q25_sequences(spark, sf):
    linked = _links(spark, sf)
    return rounded(S.sequence_totals(L.sequence_summary(L.sequence_history(linked, "2024-01-25")), linked), "swap_pct")


@query(f"WITH c AS (SELECT source, registration_link_status, count(*) AS rows FROM {sub('l21_registration')} GROUP BY ALL) SELECT *, round(100.0::double * rows / sum(rows) OVER (PARTITION BY source), 6) AS pct FROM c")
def q26_registrations(spark, sf):
    return rounded(S.class_shares(Q._registration(spark, sf), ["source"], "registration_link_status"), "pct")


@query(f"""SELECT source, count(*) AS links, count(*) FILTER (facility_claims_backed IS NULL) AS no_row, count(*) FILTER (facility_claims_backed) AS backed, count(*) FILTER (NOT facility_claims_backed) AS not_backed, count(*) FILTER (facility_claims_backed IS NOT NULL AND facility_claim_count IS NULL) AS no_count,
count(*) FILTER (facility_claim_count BETWEEN 1 AND 9) AS claims_1_9, count(*) FILTER (facility_claim_count BETWEEN 10 AND 99) AS claims_10_99, count(*) FILTER (facility_claim_count >= 100) AS claims_100_plus, quantile_disc(facility_claim_count, 0.5) AS claims_p50 FROM {sub('l14_vendor_facility')} GROUP BY source""")
def q27_claims(spark, sf):
    return S.claims_bands(Q._facility_links(spark, sf))


DOMAINS = Q.VERDICTS + f""", fn AS (SELECT npi, list_sort(list_distinct(list(f))) AS fl FROM (SELECT npi, trim(unnest(string_split(facility_npis, '|'))) AS f FROM facilities) WHERE regexp_full_match(f, '[0-9]{{10}}') AND f <> '0000000000' GROUP BY npi),
db AS (SELECT v.source, v.email, v.npi, lower(regexp_extract(v.email, '@(.*)$', 1)) AS domain, ps, coalesce(fl, []::VARCHAR[]) AS fl, CASE WHEN regexp_matches(lower(regexp_extract(v.email, '@(.*)$', 1)), '{T.INSTITUTION}') THEN 'institutional' WHEN regexp_matches(lower(regexp_extract(v.email, '@(.*)$', 1)), '{T.FREE}') THEN 'free' ELSE 'custom' END AS dc FROM ver2 v LEFT JOIN fn ON fn.npi = v.npi),
dn AS (SELECT DISTINCT source, domain, npi, ps, fl FROM db WHERE dc <> 'free'), dcnt AS (SELECT source, domain, max(dc) AS domain_class, count(DISTINCT email) AS domain_email_count, count(DISTINCT npi) AS domain_npi_count FROM db GROUP BY ALL),
dst AS (SELECT source, domain, sum(n)::bigint AS npis_with_state, count(*) AS state_count, max(n)::double / sum(n) AS top_state_share FROM (SELECT source, domain, ps, count(*) AS n FROM dn WHERE ps IS NOT NULL GROUP BY ALL) GROUP BY ALL), dfw AS (SELECT source, domain, count(*) AS npis_with_facility FROM dn WHERE len(fl) > 0 GROUP BY ALL),
dfc AS (SELECT source, domain, f, count(*) AS n, row_number() OVER (PARTITION BY source, domain ORDER BY count(*) DESC, f DESC) AS r FROM (SELECT source, domain, unnest(fl) AS f FROM dn) GROUP BY source, domain, f),
drec AS (SELECT c.*, npis_with_state, state_count, top_state_share, npis_with_facility, t.f AS top_facility_npi, t.n::double / npis_with_facility AS top_facility_share FROM dcnt c LEFT JOIN dst s ON s.source = c.source AND s.domain = c.domain LEFT JOIN dfw w ON w.source = c.source AND w.domain = c.domain LEFT JOIN dfc t ON t.source = c.source AND t.domain = c.domain AND t.r = 1)"""


def _domains(spark, sf):
    held = Q._facility_links(spark, sf).join(Q._facility_npis(spark, sf), "npi", "left").withColumn("facility_npi_values", F.coalesce("facility_npi_values", F.array().cast("array<string>")))
    return materialise(L.domain_records(held))


@query(DOMAINS + " SELECT * REPLACE (round(top_state_share, 6) AS top_state_share, round(top_facility_share, 6) AS top_facility_share) FROM drec")
def l22_domain_records(spark, sf):
    return rounded(_domains(spark, sf), "top_state_share", "top_facility_share")


@query(DOMAINS + """ SELECT b.source, dc AS email_domain_class, count(*) AS links, count(DISTINCT b.domain) AS domains, count(*) FILTER (domain_npi_count = 1) AS single_npi_links, count(*) FILTER (domain_npi_count >= 10) AS links_of_ten_npis, quantile_disc(domain_npi_count, 0.5) AS npis_p50,
count(*) FILTER (top_state_share = 1) AS single_state_links, count(*) FILTER (top_facility_share >= 0.5) AS top_facility_half_links FROM db b JOIN drec d ON d.source = b.source AND d.domain = b.domain GROUP BY ALL""")
def q28_domains(spark, sf):
    return S.domain_concentration(Q._facility_links(spark, sf), _domains(spark, sf))


@query(LINKS + """SELECT source, count(*) AS links, count(DISTINCT email) AS emails, count(DISTINCT npi) AS npis, sum(observation_count)::bigint AS observations, count(*) FILTER (observation_count > 1) AS repeated_links, quantile_disc(observation_count, 0.5) AS p50, quantile_disc(observation_count, 0.95) AS p95, max(observation_count) AS most,
min(first_seen_day) AS first_seen_day, max(last_seen_day) AS last_seen_day, count(*) FILTER (len(ds) > 0) AS dated_links, count(*) FILTER (len(ds) > 1) AS many_day_links, count(*) FILTER (undated > 0) AS links_with_undated FROM l GROUP BY source""")
def q30_profile(spark, sf):
    return S.general_profile(_links(spark, sf))


@query(f"""WITH m AS {sub('l07_names')}, r AS ({" UNION ALL ".join(f"SELECT source, email, '{a}' AS metric, {a} AS v FROM m" for a in ANSWERS)}) SELECT source, metric, count(*) AS links, count(DISTINCT email) AS emails, count(*) FILTER (v) AS matched_links, count(*) FILTER (NOT v) AS unmatched_links, count(*) FILTER (v IS NULL) AS unknown_links,
count(DISTINCT email) FILTER (v) AS matched_emails, count(DISTINCT email) FILTER (NOT v) AS unmatched_emails, count(DISTINCT email) FILTER (v IS NULL) AS unknown_emails FROM r GROUP BY ALL""")
def q31_answers(spark, sf):
    return S.answer_profile(_metrics(spark, sf), ANSWERS)


def _opted_out(spark, sf):
    return spark.sql(Q.OPT_OUT.replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf}/supplier.parquet"))


@query(LINKS + f""", o AS ({Q.OPT_OUT}), j AS (SELECT l.*, npi_clean IS NOT NULL AS x FROM l LEFT JOIN o ON npi_clean = npi) SELECT source, count(*) AS links, count(*) FILTER (x) AS excluded_links, count(DISTINCT npi) FILTER (x) AS excluded_npis, count(DISTINCT email) FILTER (x) AS excluded_emails, round(100.0::double * count(*) FILTER (x) / count(*), 6) AS excluded_pct FROM j GROUP BY source""")
def q32_opt_out(spark, sf):
    return rounded(S.opt_out_impact(_links(spark, sf), _opted_out(spark, sf)), "excluded_pct")


@query(LINKS + """, v AS (SELECT npi, list_sort(list(DISTINCT state)) AS vals FROM npi_states GROUP BY npi), p AS (SELECT a.source, a.email, a.npi, b.npi AS peer, string_agg(DISTINCT cast(a.d AS string), '|' ORDER BY cast(a.d AS string)) AS days FROM lc a JOIN lc b ON a.source = b.source AND a.email = b.email AND a.d = b.d AND a.npi <> b.npi GROUP BY ALL)
SELECT p.*, coalesce(array_to_string(list_sort(list_intersect(x.vals, y.vals)), '|'), '') AS shared, list_has_any(x.vals, y.vals) AS shares FROM p LEFT JOIN v x ON x.npi = p.npi LEFT JOIN v y ON y.npi = p.peer""")
def q34_peer_rows(spark, sf):
    states = load(spark, sf, "npi_states").groupBy("npi").agg(F.collect_set("state").alias("vals"))
    rows = S.peer_rows(_peer_values(spark, sf, states))
    return rows.withColumn("days", joined("days")).withColumn("shared", F.coalesce(F.array_join("shared", "|"), F.lit("")))


@query(Q.LINK_RECORDS + """, r AS (SELECT source, email, npi, count(*) AS n, count(*) FILTER (latest) > 0 AS h FROM x GROUP BY ALL) SELECT source, count(*) AS links, sum(n)::bigint AS versions, count(*) FILTER (n > 1) AS multi_version_links, max(n) AS most_versions, count(*) FILTER (NOT h) AS links_without_latest FROM r GROUP BY source""")
def q01_versions(spark, sf):
    return S.version_totals(Q._link_records(spark, sf).withColumn("has_latest", F.col("latest_record_id").isNotNull()))


# --- the chain ------------------------------------------------------------------------------------------------------------------------

#: Steps of the chain with the columns that the query shows.
CHAIN = {
    "l06_conflicts": ["conflict_day_count", "has_conflict_linkage"], "l07_names": ANSWERS, "l09_name_history": ["email_name_count", "email_npi_has_name_conflict"], "l13_registry_links": ["status", "status_reason"],
    "l14_vendor_facility": ["facility_reference_status", "vendor_state_evidence"], "l16_freshness": ["link_lag_days"], "l17_stability": ["presence_share", "has_undated"], "l18_identity": ["structure_reason", "entity_type"],
    "l19_labels": ["conflicting_npis_share_vendor_specialty"], "l21_registration": ["registration_link_status"], "l20_sequence": ["versions", "swaps"], "l23_cross_source": ["agree", "disagree"], "l26_location_records": ["location_status", "vendor_state_comparison"],
}
CHAIN_SQL = "SELECT b.source, b.email, b.npi, b.link_id, b.observation_count, " + ", ".join(f"{n}.{c}" for n, cs in CHAIN.items() for c in cs) + f" FROM {sub('l03_links')} b " + " ".join(
    f"LEFT JOIN {sub(n)} {n} ON {n}.source = b.source AND {n}.email = b.email" + ("" if n == "l20_sequence" else f" AND {n}.npi = b.npi") for n in CHAIN)


def _chain(spark, sf, asked=None):
    """All evidence of all links, or of those that `asked` is true of; the steps share what they have in common."""
    from tessel.plans.queries import QUERIES

    with shared_steps():
        steps = [(n, QUERIES[n](spark, sf).select(*[c for c in L.KEY if n != "l20_sequence" or c != "npi"], *cs)) for n, cs in CHAIN.items()]
        base = _links(spark, sf).select(*L.KEY, "link_id", "observation_count", "last_seen_day")
        return L.enrich(base if asked is None else base.where(asked), steps, ("l13_registry_links", "l19_labels"))


@query(CHAIN_SQL)
def l27_chain(spark, sf):
    return _chain(spark, sf).drop("last_seen_day")


@query(ORACLE_SQL["l06_conflicts"])
def l28_union(spark, sf):
    """Feed by feed, and put together again: what all feeds at once would give, as no step reads beyond a feed."""
    o = load(spark, sf, "observations")
    parts = []
    for name in sorted(r.source for r in o.select("source").distinct().collect()):
        linked = L.links(o.where(F.col("source") == name))
        parts.append(L.link_conflicts(linked, L.email_linkage(linked)).select(*L.KEY, F.size("conflict_days").alias("conflict_day_count"), "has_conflict_linkage"))
    return L.core_union(parts)


@query(f"SELECT source, email, npi, link_id, observation_count, email_matches_source_name, has_conflict_linkage FROM ({CHAIN_SQL}) WHERE email = 'jsmith1@clinic.example'")
def l30_lookup(spark, sf):
    """The e-mail is looked for among the links, before they meet their evidence."""
    asked = " JSmith1@clinic.example "
    return L.lookup(_chain(spark, sf, L.normalised_email(F.col("email")) == L.normalised_email(F.lit(asked))), asked, [*L.KEY, "link_id", "observation_count", "email_matches_source_name", "has_conflict_linkage", "last_seen_day"]).drop("last_seen_day")


@query(f"SELECT source, email, npi, link_id, observation_count, last_seen_day FROM {sub('l03_links')} WHERE lower(trim(email)) = 'jsmith1@clinic.example'")
def l30_keyed_lookup(spark, sf):
    """All links are laid out by e-mail; the lookup then reads the row groups that may hold one."""
    links = write_keyed(_links(spark, sf), f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}")
    return L.lookup(links, " JSmith1@clinic.example ", [*L.KEY, "link_id", "observation_count", "last_seen_day"])


# --- invariants -----------------------------------------------------------------------------------------------------------------------

#: What is tampered with, as SQL over the tables: how many rows break the rule then.
TAMPERED = {
    "row_count": "SELECT 1", "integrity": f"SELECT count(*) FILTER (last_seen_day IS NOT NULL AND observation_count > 3 AND first_seen_day < last_seen_day) FROM {sub('l03_links')}", "versions": "SELECT 1",
    "multiplicity": f"SELECT count(*) FROM {sub('l04_multiplicity')} WHERE email_npi_count = 2", "reassignment": f"SELECT count(*) FROM {sub('l05_reassignment')} WHERE email_npi_count = 1",
    "name_history": f"SELECT count(*) FROM {sub('l09_name_history')} WHERE email_npi_has_name_conflict", "name_evidence": f"SELECT count(*) FROM {sub('l07_names')} WHERE email_matches_source_name",
    "peer_names": f"SELECT count(*) FROM {sub('l10_peer_names')} WHERE NOT shares", "peer_states": f"SELECT count(*) FROM {sub('l10_peer_states')} WHERE shares", "peer_facilities": f"SELECT count(*) FROM {sub('l10_peer_facilities')} WHERE shares IS NULL",
    "peer_taxonomy": f"SELECT count(*) FROM {sub('l10_peer_taxonomy')} WHERE shares", "registry": f"SELECT count(*) FROM {sub('l13_registry_links')} WHERE status = 'replaced'",
    "facility": f"SELECT count(*) FROM {sub('l14_vendor_facility')} WHERE vendor_state_evidence = 'corroborated'", "claims": f"SELECT count(*) FROM {sub('l14_vendor_facility')} WHERE facility_claims_backed",
    "freshness": f"SELECT count(*) FROM {sub('l16_freshness')} WHERE link_lag_days = 1", "stability": f"SELECT count(*) FROM {sub('l17_stability')} WHERE presence_share IS NOT NULL AND has_undated", "identity": f"SELECT count(*) FROM {sub('l18_identity')} WHERE checksum_valid",
    "labels": f"SELECT count(*) FROM {sub('l19_labels')} WHERE conflicting_npis_share_vendor_specialty", "opt_out": LINKS + f", o AS ({Q.OPT_OUT}) SELECT count(*) FROM l JOIN o ON npi_clean = npi",
    "sequence": f"SELECT sum(n_days) FROM {sub('l20_sequence')} WHERE swaps > 0 AND n_days > 0", "registration": f"SELECT count(*) FROM {sub('l21_registration')} WHERE registration_link_status = 'superseded'",
    "location": f"SELECT count(*) FROM {sub('l26_location_records')} WHERE location_status = 'observed'", "domains": f"SELECT count(*) FROM {sub('l22_domain_records')} WHERE npis_with_state IS NOT NULL",
    "cross_source": f"SELECT count(*) FROM {sub('l23_cross_source')} WHERE agree <> ''", "core": f"SELECT count(DISTINCT source) FROM {sub('l03_links')} WHERE source <> 'view'",
    "membership": f"SELECT count(*) FROM (SELECT uid FROM {sub('g20_publish')} GROUP BY uid)", "lost_uids": f"SELECT count(DISTINCT uid) FROM ({with_inputs('claims_a')} SELECT * FROM claims_a) WHERE starts_with(uid, 'A_')",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS invariant, {'0::bigint' if n != 'membership' else '-1::bigint'} AS sound, ({s})::bigint AS tampered" for n, s in TAMPERED.items()))
def i00_invariants(spark, sf):
    """Rows that break each rule, in sound evidence (none) and after one column or table was tampered with. Publication has uids of several
    groups by design, so its sound count is not shown (-1)."""
    with shared_steps():
        return spark.createDataFrame(_broken_rules(spark, sf), "invariant string, sound long, tampered long")


def _broken_rules(spark, sf):
    """(rule, broken in sound evidence, broken in tampered evidence); both are counted in one job, which does what they have in common once."""
    o = load(spark, sf, "observations")
    linked, conflicts, metrics = _links(spark, sf), _conflicts(spark, sf), _metrics(spark, sf)
    linkage, history, versions = materialise(L.email_linkage(linked)), materialise(A.name_history(metrics)), materialise(Q._versions(spark, sf))
    share(Q._versions, sf, versions)
    facility, location, identity = Q._facility_links(spark, sf), materialise(Q._location(spark, sf)), materialise(Q.l18_identity_records(spark, sf))
    labels, registration, domains = materialise(Q._labels(spark, sf)), materialise(Q._registration(spark, sf)), _domains(spark, sf)
    registry = materialise(X.registry_records(linked.select(*L.KEY), X.registry_status(load(spark, sf, "registry"), Q.STATUS_DAY), Q.STATUS_DAY))
    freshness, stability, cross = materialise(L.link_freshness(linked, "2024-02-10")), materialise(L.link_stability(conflicts)), materialise(L.cross_source(linked))
    sequence, published, a = materialise(L.sequence_history(linked, "2024-01-25")), materialise(g20_publish(spark, sf)), _claims(spark, sf)[0]
    names = metrics.select(*L.KEY, F.col("source_name_values").alias("vals"))
    by_npi = lambda f: conflicts.select(*L.KEY).join(f.toDF("npi", "vals"), "npi")
    values = {"peer_names": (names, A.any_alike), "peer_states": (by_npi(load(spark, sf, "npi_states").groupBy("npi").agg(F.collect_set("state"))), None), "peer_facilities": (by_npi(Q._facility_npis(spark, sf)), None), "peer_taxonomy": (by_npi(Q._taxonomy(spark, sf)), None)}
    put = lambda f, column, when, value: f.withColumn(column, F.when(F.expr(when), value).otherwise(F.col(column)))
    full = conflicts.withColumn("email_npi_count", F.col("email_npi_count"))
    shorter = R.union_all([versions.limit(0), versions.orderBy("record_id").limit(1)])
    rules = {
        "row_count": (lambda s: N.wrong_row_count(o, s), Q.R.stage(o), Q.R.stage(o.where("event_id > 0"))),
        "integrity": (lambda f: N.wrong_integrity(f).where("reason = 'reversed_dates'").select(F.explode(F.array_repeat(F.lit(1), F.col("failures").cast("int")))), full, full.withColumn("first_seen_day", F.when(F.expr("observation_count > 3 AND first_seen_day < last_seen_day"), F.date_add("last_seen_day", 1)).otherwise(F.col("first_seen_day")))),
        "versions": (lambda v: N.wrong_versions(o.join(_opted_out(spark, sf), o.npi == F.col("npi_clean"), "left_anti"), v), versions, versions.unionByName(shorter)),
        "multiplicity": (lambda s: S.wrong_multiplicity(linked, s), L.email_multiplicity(linked), put(L.email_multiplicity(linked), "email_npi_count", "email_npi_count = 2", F.lit(3))),
        "reassignment": (lambda s: S.wrong_reassignment(o, s), linkage, put(linkage, "has_been_reassigned", "email_npi_count = 1", F.lit(True))),
        "name_history": (lambda s: N.wrong_name_history(metrics, s), history, put(history, "email_npi_has_name_conflict", "email_npi_has_name_conflict", F.lit(None))),
        "name_evidence": (N.wrong_name_evidence, metrics, put(metrics, "email_matches_source_name", "email_matches_source_name", F.lit(False))),
        "registry": (N.wrong_registry, registry, put(registry, "replacement_npi", "status = 'replaced'", F.col("npi"))),
        "facility": (N.wrong_facility, facility, put(facility, "vendor_state_evidence", "vendor_state_evidence = 'corroborated'", F.lit("mixed_vendor_states"))),
        "claims": (N.wrong_claims, facility, put(facility, "facility_claims_backed", "facility_claims_backed", F.lit(False))),
        "freshness": (lambda s: N.wrong_freshness(linked, s, "2024-02-10"), freshness, put(freshness, "link_lag_days", "link_lag_days = 1", F.lit(2))),
        "stability": (S.wrong_stability, stability, put(stability, "presence_share", "presence_share IS NOT NULL AND has_undated", F.lit(1.5))),
        "identity": (N.wrong_identity, identity, put(identity, "checksum_valid", "checksum_valid", F.lit(False))),
        "labels": (lambda s: N.wrong_labels(conflicts, s), labels, put(labels, "conflicting_npis_share_vendor_specialty", "conflicting_npis_share_vendor_specialty", F.lit(False))),
        "opt_out": (lambda f: N.wrong_opt_out(f, _opted_out(spark, sf)), Q._link_records(spark, sf), linked),
        "sequence": (lambda s: N.wrong_sequence(s), sequence, sequence.join(L.sequence_summary(sequence).where("swaps > 0").select(*L.EMAIL, F.lit(True).alias("_h")), L.EMAIL, "left").withColumn("flipbacks", F.when(F.col("_h"), F.col("swaps") + 1).otherwise(F.col("flipbacks")))),
        "registration": (N.wrong_registration, registration, put(registration, "registration_superseded_since_day", "registration_link_status = 'superseded'", F.col("registration_link_last_day"))),
        "location": (N.wrong_location, location, put(location, "location_first_day", "location_status = 'observed'", F.lit(None))),
        "domains": (N.wrong_domains, domains, put(domains, "top_state_share", "npis_with_state IS NOT NULL", F.lit(1.2))),
        "cross_source": (N.wrong_cross_source, cross, put(cross, "disagree", "size(agree) > 0", F.col("agree"))),
        "core": (lambda f: N.changed_core(linked, f, ["source", "email", "npi", "observation_count"]), linked, put(linked, "observation_count", "source <> 'view'", F.lit(0))),
        "membership": (S.wrong_membership, published, published.withColumn("group_id", F.monotonically_increasing_id().cast("string")).unionByName(published.withColumn("group_id", F.lit("one more")))),
        "lost_uids": (lambda f: N.lost_uids(a, f), published, published.where("NOT startswith(uid, 'A_')")),
    }
    for name, (vals, alike) in values.items():
        stored = materialise(L.conflict_peers(conflicts, vals, alike))
        broken = {"peer_names": put(stored, "shares", "NOT shares", F.lit(True)), "peer_facilities": put(stored, "shares", "shares IS NULL", F.lit(False))}.get(name, put(stored, "shares", "shares", F.lit(None)))
        rules[name] = (lambda s, vals=vals, alike=alike: N.wrong_peers(conflicts, vals, s, alike), stored, broken)
    rows = []
    for name, (rule, sound, tampered) in rules.items():
        counted = [rule(f).agg(F.count("*").alias("n")).withColumn("at", F.lit(at)) for at, f in (("sound", sound), ("tampered", tampered)) if (name, at) != ("membership", "sound")]
        n = {r["at"]: r["n"] for r in R.union_all(counted).collect()}
        rows.append((name, n.get("sound", -1), n["tampered"]))
    return rows
