"""Queries of name evidence, versions, references and location evidence, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import agreement as B
from tessel.operators import links as L
from tessel.operators import location as W
from tessel.operators import names as A
from tessel.operators import records as R
from tessel.operators import references as X
from tessel.plans import inputs as I
from tessel.plans.inputs import load, with_inputs
from tessel.plans.queries import LINKS, _conflicts, _links, joined, query, step
from tessel.session import materialise

# --- the rules of names, in DuckDB ----------------------------------------------------------------------------------------------------


def d_squash(x):
    return f"trim(regexp_replace(translate({x}, chr(9) || chr(10) || chr(13) || chr(160), '    '), ' +', ' ', 'g'))"


def d_norm(x):
    kept = f"CASE WHEN lower(trim({x})) IN ('', 'null', 'nan', chr(92) || 'n') THEN NULL ELSE {x} END"
    plain = f"regexp_replace(translate(upper({d_squash(kept)}), '{T.ACCENTED}', '{T.PLAIN}'), '[^A-Z'' -]', '', 'g')"
    return f"nullif({d_squash(plain)}, '')"


def d_letters(x):
    return f"regexp_replace({x}, '[^A-Z]', '', 'g')"


def d_edit(a, b):
    return f"((least(length({a}), length({b})) >= 5 AND levenshtein({a}, {b}) <= 1) OR (least(length({a}), length({b})) >= 8 AND levenshtein({a}, {b}) <= 2))"


def d_last(a, b):
    parts = [f"string_split(regexp_replace({x}, '[- ]+', ' ', 'g'), ' ')" for x in (a, b)]
    return f"CASE WHEN {d_letters(a)} = {d_letters(b)} THEN 'exact' WHEN list_has_any({parts[0]}, {parts[1]}) THEN 'token' WHEN {d_edit(d_letters(a), d_letters(b))} THEN 'edit' ELSE 'none' END"


def d_first(sa, a, sb, b):
    x, y = f"split_part({a}, ' ', 1)", f"split_part({b}, ' ', 1)"
    near = f"{x} = {y} OR list_has_any(string_split({a}, ' '), string_split({b}, ' ')) OR (least(length({x}), length({y})) >= 3 AND (starts_with({x}, {y}) OR starts_with({y}, {x})))"
    return f"CASE WHEN {a} = {b} THEN 'exact' WHEN {near} THEN 'token' WHEN list_has_any({sa}, {sb}) THEN 'nickname' WHEN {d_edit(d_letters(x), d_letters(y))} THEN 'edit' ELSE 'none' END"


def d_usable(f, s):
    return f"coalesce(length({d_letters(f)}) >= 1 AND length({d_letters(s)}) >= 2, false)"


def d_class(fa, la, fb, lb, fk="fk", lk="lk"):
    return f"""CASE WHEN {fa} IS NULL OR {la} IS NULL OR {fb} IS NULL OR {lb} IS NULL THEN NULL WHEN {lk} = 'none' AND {fk} <> 'none' THEN 'married' WHEN {lk} = 'none' OR {fk} = 'none' THEN 'none'
 WHEN {lk} = 'edit' OR {fk} = 'edit' THEN 'edit' WHEN {fk} = 'nickname' THEN 'nickname' WHEN {lk} = 'token' OR {fk} = 'token' THEN 'token' ELSE 'exact' END"""


def d_registry_class(su, ru, cls, fk="fk", lk="lk"):
    return f"CASE WHEN NOT {su} OR NOT {ru} THEN 'unknown' WHEN {lk} = 'none' AND {fk} <> 'none' THEN 'first_only' WHEN {fk} = 'none' AND {lk} <> 'none' THEN 'last_only' ELSE {cls} END"


def d_email(local, f, s):
    return f"""CASE WHEN coalesce({f}, '') = '' OR length(coalesce({s}, '')) < 2 THEN NULL WHEN length({f}) >= 2 AND contains({local}, {f}) AND contains({local}, {s}) THEN true
 WHEN length({local}) > length({s}) AND ((starts_with({local}, left({f}, 1)) AND ends_with({local}, {s})) OR (starts_with({local}, {s}) AND right({local}, 1) = left({f}, 1))) THEN true ELSE false END"""


def d_fuzzy(local, variants, s):
    low, sur = f"lower({d_letters('v')})", f"lower({d_letters(f'coalesce({s}, chr(0))')})"
    pairs = [f"{low} || {sur}", f"{sur} || {low}", f"left({low}, 1) || {sur}", f"{sur} || left({low}, 1)"]
    close = " OR ".join(f"levenshtein({local}, {p}) <= 1" for p in pairs)
    any_ = lambda c: f"len(list_filter({variants}, lambda v: {c})) > 0"
    return f"CASE WHEN len({variants}) = 0 OR length({sur}) < 2 OR NOT {any_(f'length({low}) >= 1')} THEN NULL WHEN {any_('(' + d_email(local, low, sur) + ')')} THEN true WHEN length({local}) >= 6 AND {any_('(' + close + ')')} THEN true ELSE false END"


VARIANTS = f"""nick(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in I.NICKNAMES)}),
variants AS (SELECT a AS token, list_sort(list(DISTINCT b)) AS vs FROM (SELECT a, b FROM nick UNION SELECT b, a FROM nick) GROUP BY a)"""


def d_set(first, vs="vs"):
    return f"list_distinct(list_filter(list_prepend({first}, coalesce({vs}, []::VARCHAR[])), lambda x: x IS NOT NULL))"


def _variants(spark):
    return A.nickname_variants(spark.createDataFrame(I.NICKNAMES, "nickname string, canonical string"))


@query(with_inputs("nicknames") + """, pairs AS (SELECT nickname, unnest(string_split(canonical, '|')) AS canonical FROM nicknames)
SELECT a AS first_name, array_to_string(list_sort(list(DISTINCT b)), '|') AS variants FROM (SELECT nickname AS a, canonical AS b FROM pairs UNION SELECT canonical, nickname FROM pairs) GROUP BY a""")
def l08_variants(spark, sf):
    return A.nickname_variants(load(spark, sf, "nicknames")).select("first_name", joined("variants"))


@query(with_inputs("names") + ", " + VARIANTS + f""", n AS (SELECT id, {d_norm("first_name")} AS fa, {d_norm("last_name")} AS la, {d_norm("other_first")} AS fb, {d_norm("other_last")} AS lb,
 regexp_replace(lower(regexp_extract(email, '^([^@]*)@', 1)), '[^a-z]', '', 'g') AS local FROM names),
s AS (SELECT n.*, {d_set("fa", "v.vs")} AS sa, {d_set("fb", "w.vs")} AS sb FROM n LEFT JOIN variants v ON v.token = split_part(fa, ' ', 1) LEFT JOIN variants w ON w.token = split_part(fb, ' ', 1)),
k AS (SELECT *, {d_last("la", "lb")} AS lk, {d_first("sa", "fa", "sb", "fb")} AS fk, {d_usable("fa", "la")} AS ua, {d_usable("fb", "lb")} AS ub FROM s)
SELECT id, fa AS first_name, la AS last_name, lk AS last_kind, fk AS first_kind, {d_class("fa", "la", "fb", "lb")} AS match_class, {d_registry_class("ua", "ub", d_class("fa", "la", "fb", "lb"))} AS registry_class,
 ua AS usable, {d_email("local", f"lower({d_letters('fa')})", f"lower({d_letters('la')})")} AS in_email, {d_fuzzy("local", "sa", "la")} AS in_email_fuzzy FROM k""")
def f10_names(spark, sf):
    c, v = F.col, _variants(spark)
    n = load(spark, sf, "names").select("id", *[T.norm_name(c(x)).alias(y) for x, y in (("first_name", "fa"), ("last_name", "la"), ("other_first", "fb"), ("other_last", "lb"))], T.local_letters(c("email")).alias("local"))
    n = A.with_first_set(A.with_first_set(n, v, "fa", "sa"), v, "fb", "sb")
    n = n.withColumns({"lk": T.last_kind(c("la"), c("lb")), "fk": T.first_kind(c("sa"), c("fa"), c("sb"), c("fb")), "usable": T.usable_name(c("fa"), c("la")), "ub": T.usable_name(c("fb"), c("lb"))})
    kind = F.when(c("fa").isNotNull() & c("la").isNotNull() & c("fb").isNotNull() & c("lb").isNotNull(), T.match_class(c("fk"), c("lk")))
    return n.select("id", c("fa").alias("first_name"), c("la").alias("last_name"), c("lk").alias("last_kind"), c("fk").alias("first_kind"), kind.alias("match_class"), T.registry_class(c("usable"), c("ub"), c("fk"), c("lk")).alias("registry_class"),
        "usable", T.name_in_email(c("local"), F.lower(T.letters(c("fa"))), F.lower(T.letters(c("la")))).alias("in_email"), T.name_in_email_fuzzy(c("local"), c("sa"), c("la")).alias("in_email_fuzzy"))


#: Links with their names, registry names and all comparisons of the two.
NAMES = with_inputs("observations", "registry_names") + ", " + VARIANTS + f""",
on1 AS (SELECT DISTINCT source, email, npi, {d_norm("first_name")} AS fa, {d_norm("last_name")} AS la FROM observations),
on2 AS (SELECT k.*, o.fa, o.la FROM (SELECT DISTINCT source, email, npi FROM on1) k LEFT JOIN on1 o ON o.source = k.source AND o.email = k.email AND o.npi = k.npi AND (o.fa IS NOT NULL OR o.la IS NOT NULL)),
rn1 AS (SELECT DISTINCT npi, {d_norm("first_name")} AS fb, {d_norm("last_name")} AS lb FROM registry_names),
rn2 AS (SELECT rn1.*, {d_set("fb")} AS sb FROM rn1 LEFT JOIN variants ON token = split_part(fb, ' ', 1)),
on3 AS (SELECT on2.*, {d_set("fa")} AS sa, regexp_replace(lower(regexp_extract(email, '^([^@]*)@', 1)), '[^a-z]', '', 'g') AS local FROM on2 LEFT JOIN variants ON token = split_part(fa, ' ', 1)),
cmp0 AS (SELECT o.*, r.fb, r.lb, coalesce(r.sb, []::VARCHAR[]) AS sb, r.npi IS NOT NULL AS present, {d_usable("fa", "la")} AS ua, {d_usable("fb", "lb")} AS ub FROM on3 o LEFT JOIN rn2 r ON o.npi = r.npi),
cmp1 AS (SELECT *, {d_last("la", "lb")} AS lk, {d_first("sa", "fa", "sb", "fb")} AS fk FROM cmp0),
cmp AS (SELECT *, {d_registry_class("ua", "ub", d_class("fa", "la", "fb", "lb"))} AS cls, {d_fuzzy("local", "sa", "la")} AS sm, {d_fuzzy("local", "sb", "lb")} AS rm FROM cmp1)"""
SHOWN = "coalesce(fa, '') || '~' || coalesce(la, '') || '~' || coalesce(fb, '') || '~' || coalesce(lb, '') || '~' || CASE WHEN ua AND ub THEN fk ELSE 'unknown' END || '~' || CASE WHEN ua AND ub THEN lk ELSE 'unknown' END || '~' || cls"


@step(stored=True)
def _compared(spark, sf):
    v = _variants(spark)
    return materialise(A.compared_names(A.source_names(load(spark, sf, "observations")), A.registry_names(load(spark, sf, "registry_names"), v), v))


@step()
def _name_metrics(spark, sf):
    return A.link_name_metrics(_compared(spark, sf))


@step()
def _name_values(spark, sf):
    """Usable names of each link; what compares them with each other needs no registry."""
    return A.name_values(A.source_names(load(spark, sf, "observations")), _variants(spark))


@query(NAMES + f""", evidence AS (SELECT *, CASE WHEN ua AND ub THEN cls IN ('exact', 'nickname', 'token', 'edit') END AS vm, bool_or(ua) OVER (PARTITION BY source, email, npi) AS any_ua FROM cmp)
SELECT source, email, npi, bool_or(sm) AS email_matches_source_name, bool_or(rm) AS email_matches_registry_name, bool_or(vm) AS vendor_name_matches_registry_name, bool_or(ua) AS source_name_usable, bool_or(ub) AS registry_name_usable,
 bool_or(present) AS registry_npi_present, string_agg(DISTINCT cls, '|' ORDER BY cls) FILTER (ua OR NOT any_ua) AS match_classes,
 string_agg(DISTINCT CASE WHEN ua THEN {SHOWN} ELSE '~~' || coalesce(fb, '') || '~' || coalesce(lb, '') || '~unknown~unknown~unknown' END, '|' ORDER BY CASE WHEN ua THEN {SHOWN} ELSE '~~' || coalesce(fb, '') || '~' || coalesce(lb, '') || '~unknown~unknown~unknown' END) FILTER (ua OR NOT any_ua) AS evidence
 FROM evidence GROUP BY ALL""")
def l07_names(spark, sf):
    out = _name_metrics(spark, sf)
    shown = F.transform("name_match_evidence", lambda x: F.array_join(F.array(*[F.coalesce(x[c], F.lit("")) for c in ("source_first_name", "source_last_name", "registry_first_name", "registry_last_name", "first_name_match_kind", "last_name_match_kind", "match_class")]), "~"))
    return out.select(*L.KEY, "email_matches_source_name", "email_matches_registry_name", "vendor_name_matches_registry_name", "source_name_usable", "registry_name_usable", "registry_npi_present",
        joined("match_classes"), F.array_join(F.array_sort(F.array_distinct(shown)), "|").alias("evidence"))


#: Usable names of each link, and which links disagree.
HISTORY = NAMES + f""", usable AS (SELECT DISTINCT source, email, npi, fa, la, sa FROM on3 WHERE {d_usable("fa", "la")}),
name_pairs AS (SELECT a.source, a.email, a.npi, b.npi AS peer, a.fa, a.la, a.sa, b.fa AS fb, b.la AS lb, b.sa AS sb FROM usable a JOIN usable b ON a.source = b.source AND a.email = b.email),
kinds AS (SELECT source, email, npi, peer, {d_last("la", "lb")} = 'none' OR {d_first("sa", "fa", "sb", "fb")} = 'none' AS apart FROM name_pairs)"""


@query(HISTORY + """, links AS (SELECT DISTINCT source, email, npi FROM observations), c AS (SELECT source, email, npi, bool_or(apart) AS conflict FROM kinds WHERE npi = peer GROUP BY ALL),
n AS (SELECT source, email, count(*) AS n FROM (SELECT DISTINCT source, email, fa, la FROM usable) GROUP BY ALL)
SELECT l.source, l.email, l.npi, coalesce(n.n, 0) AS email_name_count, c.conflict AS email_npi_has_name_conflict FROM links l LEFT JOIN n ON n.source = l.source AND n.email = l.email LEFT JOIN c ON c.source = l.source AND c.email = l.email AND c.npi = l.npi""")
def l09_name_history(spark, sf):
    return A.name_history(_name_values(spark, sf).withColumnRenamed("vals", "source_name_values"))


PEERS = LINKS.replace(with_inputs("observations", "npi_states"), HISTORY, 1) + """, peers AS (SELECT DISTINCT a.source, a.email, a.npi, b.npi AS peer FROM lc a JOIN lc b ON a.source = b.source AND a.email = b.email AND a.d = b.d AND a.npi <> b.npi),
shared_names AS (SELECT source, email, npi, peer, bool_or(NOT apart) AS shares FROM kinds GROUP BY ALL)"""


@query(PEERS + """ SELECT p.source, p.email, p.npi, count(*) AS peers, CASE WHEN count(*) FILTER (s.shares) > 0 THEN true WHEN count(*) FILTER (s.shares IS NULL) > 0 THEN NULL ELSE false END AS shares
FROM peers p LEFT JOIN shared_names s ON p.source = s.source AND p.email = s.email AND p.npi = s.npi AND p.peer = s.peer GROUP BY ALL""")
def l10_peer_names(spark, sf):
    names = _name_values(spark, sf)
    return L.conflict_peers(_conflicts(spark, sf), names, A.any_alike).select("source", "email", "npi", "peers", "shares")


@query(PEERS + """ SELECT p.source, p.email, p.npi, CASE WHEN count(*) FILTER (s.shares) > 0 THEN true WHEN count(*) FILTER (s.shares IS NULL) > 0 THEN NULL ELSE false END AS shares
FROM peers p LEFT JOIN shared_names s ON p.source = s.source AND p.email = s.email AND p.npi = s.npi AND p.peer = s.peer GROUP BY ALL""")
def l10_name_shares(spark, sf):
    names = _name_values(spark, sf)
    return B.conflict_name_shares(_conflicts(spark, sf), names)


@query(NAMES + """ SELECT source, email, npi, upper(sha256(source || chr(0) || email || chr(0) || npi)) AS link_id, fa AS first_name, la AS last_name, fb AS registry_first_name, lb AS registry_last_name, cls AS match_class, sm AS source_match, rm AS registry_match FROM cmp""")
def l29_debug_rows(spark, sf):
    return A.debug_rows(_links(spark, sf), _compared(spark, sf)).drop("first_kind", "last_kind", "vendor_match", "debug_id")


# --- versions, candidates, links ------------------------------------------------------------------------------------------------------

IDENTITY = ["source", "email", "npi", "first_name", "last_name", "state", "specialty", "guid"]
SPEC = R.SourceSpec("events", tuple(IDENTITY), volatile=("profession",))
OPT_OUT = "SELECT DISTINCT '1' || lpad(cast(s_suppkey * 7 AS string), 9, '0') AS npi_clean FROM supplier"
VERSIONS = with_inputs("observations") + f""", out AS ({OPT_OUT}),
ver AS (SELECT {", ".join(IDENTITY)}, list_sort(list_distinct(list(day) FILTER (day IS NOT NULL))) AS ds, min(day) AS first_seen_day, max(day) AS last_seen_day, nullif(count(DISTINCT day), 0) AS observed_day_count,
 count(*) AS observation_count, count(*) FILTER (day IS NULL) AS undated_observation_count, list_sort(list_distinct(list(nullif(trim(profession), '')) FILTER (nullif(trim(profession), '') IS NOT NULL))) AS professions
 FROM observations WHERE npi NOT IN (SELECT npi_clean FROM out) GROUP BY ALL)"""


@step(stored=True)
def _versions(spark, sf):
    """Observations as delivered records; their day goes in as text, as feeds give it. Not stored: most queries read them once."""
    staged = R.stage(load(spark, sf, "observations").withColumn("day", F.col("day").cast("string")))
    excluded = spark.sql(OPT_OUT.replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{sf}/supplier.parquet"))
    return R.record_versions(staged, SPEC, excluded, "events")


@query(VERSIONS + f""" SELECT {", ".join(IDENTITY)}, coalesce(array_to_string(ds, '|'), '') AS observed_days, first_seen_day, last_seen_day, observed_day_count, observation_count, undated_observation_count,
0::bigint AS invalid_day_observation_count, coalesce(array_to_string(professions, '|'), '') AS profession_values FROM ver""")
def l01_versions(spark, sf):
    return _versions(spark, sf).drop("record_payload", "record_id", "npi_clean").withColumn("observed_days", joined("observed_days")).withColumn("profession_values", joined("profession_values"))


def _candidates(spark, sf):
    v = _versions(spark, sf).withColumn("email_list", F.concat("email", F.lit("| |"), F.upper("email")))
    one = R.emails_of_list(v.drop("email"), "email_list")
    code = T.state_code(F.col("state"))
    return one.withColumns({"source_tables": F.array(F.lit("events")), "first_name": T.norm_name(F.col("first_name")), "last_name": T.norm_name(F.col("last_name")),
        "state_values": F.filter(F.array(code), lambda x: x.isNotNull()), "specialty_values": F.filter(F.array(T.vendor_label(F.col("specialty"))), lambda x: x.isNotNull())})


STATE_SQL = "CASE upper(regexp_replace(trim(state), '\\s+', ' ', 'g')) " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in (T.STATES | {c: c for c in T.STATES.values()}).items()) + " END"
LABEL_SQL = lambda c: f"CASE WHEN upper(regexp_replace(trim({c}), '\\s+', ' ', 'g')) NOT IN ({', '.join(repr(x) for x in T.NO_LABEL if chr(92) not in x)}, chr(92) || 'N') THEN upper(regexp_replace(trim({c}), '\\s+', ' ', 'g')) END"
LINK_RECORDS = VERSIONS + f""", w AS (SELECT *, {d_norm("first_name")} AS f, {d_norm("last_name")} AS s, {STATE_SQL} AS code, {LABEL_SQL("specialty")} AS label, count(*) OVER (PARTITION BY source, email, npi) AS vc,
 max(last_seen_day) OVER (PARTITION BY source, email, npi) AS ld, count(*) OVER (PARTITION BY source, email, npi, last_seen_day) AS sd FROM ver),
x AS (SELECT *, coalesce(vc = 1 OR (last_seen_day = ld AND sd = 1), false) AS latest FROM w)"""


@query(LINK_RECORDS + """ SELECT source, email, npi, upper(sha256(source || chr(0) || email || chr(0) || npi)) AS link_id, min(first_seen_day) AS first_seen_day, max(last_seen_day) AS last_seen_day,
 coalesce(array_to_string(list_sort(list_distinct(flatten(list(ds) FILTER (ds IS NOT NULL)))), '|'), '') AS observed_days, sum(observation_count)::bigint AS observation_count, sum(undated_observation_count)::bigint AS undated_observation_count,
 count(*) AS record_count, count(*) FILTER (latest) > 0 AS has_latest, max(f) FILTER (latest) AS latest_first_name, max(s) FILTER (latest) AS latest_last_name, max(guid) FILTER (latest) AS latest_guid,
 coalesce(string_agg(DISTINCT code, '|' ORDER BY code), '') AS source_state_values, coalesce(max(code) FILTER (latest), '') AS source_state_values_latest, coalesce(string_agg(DISTINCT label, '|' ORDER BY label), '') AS specialty_values,
 count(DISTINCT coalesce(f, '~') || '/' || coalesce(s, '~')) FILTER (f IS NOT NULL OR s IS NOT NULL) AS names, 'email_token_1|email_token_3' AS email_origins FROM x GROUP BY ALL""")
def l03_link_records(spark, sf):
    out = R.link_records(_candidates(spark, sf))
    return out.select(*L.KEY, "link_id", "first_seen_day", "last_seen_day", joined("observed_days"), "observation_count", "undated_observation_count", "record_count", F.col("latest_record_id").isNotNull().alias("has_latest"),
        "latest_first_name", "latest_last_name", "latest_guid", joined("source_state_values"), joined("source_state_values_latest"), joined("specialty_values"), F.size("source_names").cast("long").alias("names"), joined("email_origins"))


@query(with_inputs("names") + """, e AS (SELECT id, unnest([email, '', upper(other_first), NULL, email]) AS raw, unnest(range(1, 6)) AS n FROM names), o AS (SELECT id, unnest([email, other_last]) AS raw, unnest(range(1, 3)) AS n FROM names),
l AS (SELECT id, 'list' AS shape, lower(trim(raw)) AS email, 'email_token_' || n AS origin FROM (SELECT id, unnest([email, ' ', 'X@Y.test ']) AS raw, unnest(range(1, 4)) AS n FROM names))
SELECT id, shape, email, origin FROM (SELECT * FROM l UNION ALL SELECT id, 'slots', lower(trim(raw)), 'email_' || n || '_address' FROM e
 UNION ALL SELECT id, 'nested', lower(trim(raw)), 'emails[' || n || ']' FROM o UNION ALL SELECT id, 'nested', lower(trim(email)), 'work' FROM names UNION ALL SELECT id, 'nested', lower(trim(first_name)), 'home' FROM names) WHERE email <> ''""")
def l02_candidates(spark, sf):
    n = load(spark, sf, "names")
    lists = R.emails_of_list(n.withColumn("many", F.concat("email", F.lit("| |X@Y.test "))).drop("email"), "many").withColumn("shape", F.lit("list"))
    slots = n.select("id", F.col("email").alias("e1"), F.lit("").alias("e2"), F.upper("other_first").alias("e3"), F.lit(None).cast("string").alias("e4"), F.col("email").alias("e5"))
    slots = R.emails_of_slots(slots, ["e1", "e2", "e3", "e4", "e5"]).withColumn("shape", F.lit("slots"))
    nested = n.select("id", F.array(F.struct("email"), F.struct(F.col("other_last").alias("email"))).alias("emails"), F.col("email").alias("work"), F.col("first_name").alias("home"))
    nested = R.emails_nested(nested, "emails", ["work", "home"]).withColumn("shape", F.lit("nested"))
    parts = [f.select("id", "shape", "email", F.col("email_origin").alias("origin")) for f in (lists, slots, nested)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- references -----------------------------------------------------------------------------------------------------------------------

STATUS_DAY = "1998-01-01"
REGISTRY = with_inputs("registry") + f""", reg AS (SELECT npi, count(*) AS reference_rows, count(DISTINCT coalesce(nullif(trim(deactivated), ''), '~') || '/' || coalesce(nullif(trim(reactivated), ''), '~') || '/' || coalesce(nullif(trim(replacement), ''), '~') || '/' || coalesce(nullif(trim(reason), ''), '~')) AS variants,
 any_value(deactivated) AS dt, any_value(reactivated) AS rt, any_value(replacement) AS replacement, any_value(reason) AS why FROM registry GROUP BY npi),
par AS (SELECT *, try_cast(dt AS date) AS d, try_cast(rt AS date) AS r FROM reg),
cls AS (SELECT *, CASE WHEN variants <> 1 THEN 'conflicting_reference_records' WHEN (dt IS NOT NULL AND d IS NULL) OR (rt IS NOT NULL AND r IS NULL) THEN 'invalid_lifecycle_date' WHEN d > DATE '{STATUS_DAY}' OR r > DATE '{STATUS_DAY}' THEN 'future_lifecycle_date'
 WHEN replacement = npi THEN 'self_replacement' WHEN replacement IS NOT NULL AND (NOT regexp_full_match(replacement, '[0-9]{{10}}') OR replacement = '0000000000') THEN 'invalid_replacement_npi' WHEN why IS NOT NULL AND d IS NULL THEN 'reason_without_deactivation'
 WHEN d = r THEN 'ambiguous_event_order' WHEN replacement IS NOT NULL AND r IS NOT NULL AND (d IS NULL OR r > d) THEN 'replacement_with_reactivation' WHEN replacement IS NOT NULL THEN 'replacement_reported'
 WHEN d IS NOT NULL AND (r IS NULL OR d > r) THEN 'latest_event_deactivation' WHEN r IS NOT NULL THEN 'latest_event_reactivation' ELSE 'no_deactivation_reported' END AS status_reason FROM par),
status AS (SELECT npi, CASE status_reason WHEN 'replacement_reported' THEN 'replaced' WHEN 'latest_event_deactivation' THEN 'deactivated' WHEN 'latest_event_reactivation' THEN 'reactivated' WHEN 'no_deactivation_reported' THEN 'active_as_reported' ELSE 'unknown' END AS status, status_reason,
 CASE WHEN variants = 1 AND regexp_full_match(replacement, '[0-9]{{10}}') AND replacement <> '0000000000' AND replacement <> npi THEN replacement END AS replacement_npi, CASE WHEN variants = 1 THEN d END AS deactivation_date, CASE WHEN variants = 1 THEN r END AS reactivation_date, reference_rows, variants FROM cls)"""


@query(REGISTRY + " SELECT * FROM status")
def l13_registry_status(spark, sf):
    return X.registry_status(load(spark, sf, "registry"), STATUS_DAY).drop("evidence")


LINKED = ", links AS (SELECT DISTINCT source, email, npi FROM observations)"


@query(REGISTRY.replace(with_inputs("registry"), with_inputs("registry", "observations"), 1) + LINKED + """ SELECT l.*, coalesce(status, 'not_found') AS status, coalesce(status_reason, 'no_registry_record') AS status_reason, replacement_npi, deactivation_date, reactivation_date,
coalesce(reference_rows, 0) AS reference_rows, coalesce(variants, 0) AS variants FROM links l LEFT JOIN status s ON s.npi = l.npi""")
def l13_registry_links(spark, sf):
    links = load(spark, sf, "observations").select(*L.KEY).distinct()
    return X.registry_records(links, X.registry_status(load(spark, sf, "registry"), STATUS_DAY), STATUS_DAY).drop("evidence", "status_as_of_day")


@query(with_inputs("facilities") + """, f AS (SELECT npi, trim(unnest(string_split(facility_npis, '|'))) AS f FROM facilities), n AS (SELECT DISTINCT npi FROM facilities)
SELECT n.npi, coalesce(string_agg(DISTINCT f, '|' ORDER BY f) FILTER (regexp_full_match(f, '[0-9]{10}') AND f <> '0000000000'), '') AS facility_npi_values FROM n LEFT JOIN f ON f.npi = n.npi GROUP BY n.npi""")
def l11_facility_npis(spark, sf):
    return _facility_npis(spark, sf).withColumn("facility_npi_values", joined("facility_npi_values"))


def _facility_npis(spark, sf):
    return X.facility_npis(load(spark, sf, "facilities").withColumn("facility_npis", F.split("facility_npis", r"\|")))


@query(with_inputs("taxonomy", "provider_codes") + """, u AS (SELECT npi, upper(trim(unnest([code_1, code_2, code_3]))) AS code FROM provider_codes)
SELECT u.npi, string_agg(DISTINCT u.code, '|' ORDER BY u.code) AS specialty_code_values FROM u JOIN taxonomy t ON t.code = u.code GROUP BY u.npi""")
def l12_taxonomy(spark, sf):
    return _taxonomy(spark, sf).withColumn("specialty_code_values", joined("specialty_code_values"))


def _taxonomy(spark, sf):
    return X.taxonomy_codes(load(spark, sf, "provider_codes"), ["code_1", "code_2", "code_3"], load(spark, sf, "taxonomy"))


FACILITY = f""", fs0 AS (SELECT npi, {STATE_SQL} AS st, nullif(trim(location), '') AS loc FROM facilities WHERE rank = 1),
fs AS (SELECT npi, count(*) AS facility_rows, count(DISTINCT st) AS facility_state_count, count(*) FILTER (st IS NULL) AS facility_unknown_state_rows, count(*) FILTER (loc IS NULL) AS facility_missing_location_rows,
 CASE WHEN count(DISTINCT st) > 1 THEN 'ambiguous_state' WHEN count(*) FILTER (loc IS NULL) > 0 THEN 'missing_location' WHEN count(*) FILTER (st IS NULL) > 0 THEN 'missing_state' ELSE 'usable' END AS facility_reference_status, max(st) AS st FROM fs0 GROUP BY npi),
fc0 AS (SELECT npi, claims, trim(unnest(string_split(coalesce(sources, ''), ','))) AS s FROM facilities WHERE rank = 1),
fc AS (SELECT npi, max(claims) AS facility_claim_count, list_sort(list_distinct(list(s) FILTER (s <> ''))) AS srcs FROM fc0 GROUP BY npi)"""


@query(with_inputs("facilities") + FACILITY + """ SELECT fs.* EXCLUDE (st), CASE WHEN facility_reference_status = 'usable' THEN st END AS facility_primary_state, facility_claim_count, coalesce(array_to_string(srcs, '|'), '') AS facility_sources FROM fs JOIN fc ON fc.npi = fs.npi""")
def l14_facilities(spark, sf):
    f = load(spark, sf, "facilities")
    return X.facility_states(f).join(X.facility_claims(f), "npi").withColumn("facility_sources", joined("facility_sources"))


VERDICTS = LINK_RECORDS.replace(with_inputs("observations"), with_inputs("observations", "facilities"), 1) + FACILITY + """, lk AS (SELECT source, email, npi, list_sort(list_distinct(list(code) FILTER (code IS NOT NULL))) AS sv, count(*) FILTER (latest) > 0 AS has_latest, max(code) FILTER (latest) AS sl FROM x GROUP BY ALL),
ver2 AS (SELECT lk.*, coalesce(sv, []) AS sv2, CASE WHEN sl IS NULL THEN []::VARCHAR[] ELSE [sl] END AS sl2, coalesce(facility_reference_status, 'no_rank1_association') AS rs, CASE WHEN facility_reference_status = 'usable' THEN st END AS ps,
 fc.npi IS NOT NULL AS has_claims, facility_claim_count, coalesce(srcs, []::VARCHAR[]) AS srcs FROM lk LEFT JOIN fs ON fs.npi = lk.npi LEFT JOIN fc ON fc.npi = lk.npi)"""


def d_verdict(states):
    return f"CASE WHEN rs <> 'usable' THEN 'unknown_facility' WHEN len({states}) = 0 THEN 'unknown_vendor_state' WHEN list_contains({states}, ps) THEN CASE WHEN len({states}) = 1 THEN 'corroborated' ELSE 'mixed_vendor_states' END ELSE 'not_corroborated' END"


@query(VERDICTS + f""" SELECT source, email, npi, rs AS facility_reference_status, ps AS facility_primary_state, facility_claim_count, CASE WHEN has_claims THEN list_contains(srcs, 'Claims') END AS facility_claims_backed,
{d_verdict("sv2")} AS vendor_state_evidence, CASE WHEN has_latest THEN {d_verdict("sl2")} END AS vendor_state_evidence_latest FROM ver2""")
def l14_vendor_facility(spark, sf):
    return _facility_links(spark, sf).select(*L.KEY, "facility_reference_status", "facility_primary_state", "facility_claim_count", "facility_claims_backed", "vendor_state_evidence", "vendor_state_evidence_latest")


@step()
def _link_records(spark, sf):
    return R.link_records(_candidates(spark, sf)).withColumn("source_state_values_latest", F.when(F.col("latest_record_id").isNotNull(), F.col("source_state_values_latest")))


@step()
def _facility_links(spark, sf):
    f = load(spark, sf, "facilities")
    return X.facility_records(_link_records(spark, sf), X.facility_states(f), X.facility_claims(f))


@query(with_inputs("observations", "registry") + LINKED + """, c AS (SELECT npi, count(*) AS reference_rows, count(DISTINCT coalesce(nullif(trim(entity), ''), '~')) AS v, max(nullif(trim(entity), '')) AS code FROM registry GROUP BY npi),
z AS (SELECT npi, 24 + list_sum(list_transform(range(10), lambda k: CASE WHEN k % 2 = 0 THEN CASE WHEN cast(substr(npi, k + 1, 1) AS int) > 4 THEN 2 * cast(substr(npi, k + 1, 1) AS int) - 9 ELSE 2 * cast(substr(npi, k + 1, 1) AS int) END ELSE cast(substr(npi, k + 1, 1) AS int) END)) AS t FROM (SELECT DISTINCT npi FROM links)),
e AS (SELECT l.*, t % 10 = 0 AS ok, coalesce(reference_rows, 0) AS reference_rows, coalesce(v, 0) AS variant_count, CASE WHEN reference_rows IS NULL THEN 'not_found' WHEN v <> 1 THEN 'conflicting_reference_records' WHEN code IS NULL THEN 'missing_entity_type' WHEN code NOT IN ('1', '2') THEN 'unrecognized_entity_type' ELSE 'registry_consensus' END AS entity_reason, code
 FROM links l JOIN z ON z.npi = l.npi LEFT JOIN c ON c.npi = l.npi)
SELECT source, email, npi, regexp_full_match(npi, '[1-4][0-9]{9}') AS format_valid, ok AS checksum_valid, regexp_full_match(npi, '[1-4][0-9]{9}') AND ok AS structure_valid, CASE WHEN NOT ok THEN 'checksum_failure' ELSE 'valid' END AS structure_reason,
CASE WHEN entity_reason <> 'registry_consensus' THEN 'unknown' WHEN code = '1' THEN 'individual' ELSE 'organization' END AS entity_type, entity_reason, reference_rows, variant_count FROM e""")
def l18_identity(spark, sf):
    return l18_identity_records(spark, sf).drop("evidence")


def l18_identity_records(spark, sf):
    return X.npi_identity(load(spark, sf, "observations").select(*L.KEY).distinct(), load(spark, sf, "registry"))


LABELS = LINKS.replace(with_inputs("observations", "npi_states"), with_inputs("observations", "npi_states"), 1) + f""", meta AS (SELECT npi, day AS d, list_distinct(list(sl) FILTER (sl IS NOT NULL)) AS sp, list_distinct(list(pl) FILTER (pl IS NOT NULL)) AS pr FROM (SELECT npi, day, {LABEL_SQL("specialty")} AS sl, {LABEL_SQL("profession")} AS pl FROM observations WHERE day IS NOT NULL) GROUP BY ALL),
own AS (SELECT ld.*, coalesce(sp, []::VARCHAR[]) AS sp, coalesce(pr, []::VARCHAR[]) AS pr FROM ld LEFT JOIN meta m ON m.npi = ld.npi AND m.d = ld.d),
cd AS (SELECT own.* FROM own JOIN conf c ON c.source = own.source AND c.email = own.email AND c.d = own.d),
judged AS (SELECT a.source, a.email, a.npi, CASE WHEN len(a.sp) > 0 AND len(b.sp) > 0 THEN list_has_any(a.sp, b.sp) END AS s, CASE WHEN len(a.pr) > 0 AND len(b.pr) > 0 THEN list_has_any(a.pr, b.pr) END AS p FROM cd a JOIN cd b ON a.source = b.source AND a.email = b.email AND a.d = b.d AND a.npi <> b.npi),
told AS (SELECT source, email, npi, CASE WHEN count(*) FILTER (s) > 0 THEN true WHEN count(*) FILTER (s IS NULL) > 0 THEN NULL ELSE false END AS s, CASE WHEN count(*) FILTER (p) > 0 THEN true WHEN count(*) FILTER (p IS NULL) > 0 THEN NULL ELSE false END AS p, count(*) AS comparisons FROM judged GROUP BY ALL)"""


@query(LABELS + """, v AS (SELECT source, email, npi, array_to_string(list_sort(list_distinct(flatten(list(sp)))), '|') AS sv, array_to_string(list_sort(list_distinct(flatten(list(pr)))), '|') AS pv FROM own GROUP BY ALL)
SELECT l.source, l.email, l.npi, coalesce(sv, '') AS vendor_specialty_values, coalesce(pv, '') AS vendor_profession_values, t.s AS conflicting_npis_share_vendor_specialty, t.p AS conflicting_npis_share_vendor_profession, coalesce(comparisons, 0) AS comparisons
FROM l LEFT JOIN v ON v.source = l.source AND v.email = l.email AND v.npi = l.npi LEFT JOIN told t ON t.source = l.source AND t.email = l.email AND t.npi = l.npi""")
def l19_labels(spark, sf):
    return _labels(spark, sf).withColumn("vendor_specialty_values", joined("vendor_specialty_values")).withColumn("vendor_profession_values", joined("vendor_profession_values")).drop("vendor_professional_evidence")


def _labels(spark, sf):
    return X.professional_labels(_conflicts(spark, sf), X.daily_labels(load(spark, sf, "observations"), ["specialty"], ["profession"]))


SEQUENCE_DAY = "2024-01-25"
REGISTRATION = with_inputs("observations") + f""", s AS (SELECT DISTINCT source, email, npi, guid, CASE WHEN day <= DATE '{SEQUENCE_DAY}' THEN day END AS d FROM observations), u AS (SELECT DISTINCT source, email, npi FROM observations WHERE day IS NULL),
li AS (SELECT source, email, npi, guid, max(d) AS ll FROM s GROUP BY ALL), g AS (SELECT s.source, s.email, s.guid, max(d) AS latest, bool_or(u.npi IS NOT NULL) AS open FROM s LEFT JOIN u ON u.source = s.source AND u.email = s.email AND u.npi = s.npi GROUP BY ALL),
h AS (SELECT g.source, g.email, g.guid, list_sort(list_distinct(list(s.npi))) AS npis FROM g JOIN s ON s.source = g.source AND s.email = g.email AND s.guid IS NOT DISTINCT FROM g.guid AND s.d = g.latest GROUP BY ALL),
t AS (SELECT li.source, li.email, li.npi, li.guid, min(s.d) AS since FROM li JOIN s ON s.source = li.source AND s.email = li.email AND s.guid IS NOT DISTINCT FROM li.guid AND s.d > li.ll GROUP BY ALL),
j AS (SELECT li.*, g.latest, g.open, coalesce(h.npis, []::VARCHAR[]) AS npis, t.since, row_number() OVER (PARTITION BY li.source, li.email, li.npi ORDER BY ll DESC NULLS LAST, li.guid NULLS LAST) AS r FROM li JOIN g ON g.source = li.source AND g.email = li.email AND g.guid IS NOT DISTINCT FROM li.guid
 LEFT JOIN h ON h.source = li.source AND h.email = li.email AND h.guid IS NOT DISTINCT FROM li.guid LEFT JOIN t ON t.source = li.source AND t.email = li.email AND t.npi = li.npi AND t.guid IS NOT DISTINCT FROM li.guid),
k AS (SELECT *, CASE WHEN guid IS NULL OR latest IS NULL OR ll IS NULL OR open THEN 'unknown' WHEN len(npis) <> 1 THEN 'ambiguous_latest' WHEN list_contains(npis, npi) THEN 'latest_observed' ELSE 'superseded' END AS st FROM j WHERE r = 1)"""


@query(REGISTRATION + """ SELECT source, email, npi, guid AS registration_guid, st AS registration_link_status, CASE WHEN guid IS NOT NULL THEN latest END AS registration_latest_day, CASE WHEN guid IS NOT NULL THEN array_to_string(npis, '|') ELSE '' END AS registration_latest_npis,
CASE WHEN guid IS NOT NULL THEN ll END AS registration_link_last_day, CASE WHEN st = 'superseded' THEN since END AS registration_superseded_since_day, CASE WHEN st = 'superseded' THEN array_to_string(npis, '|') ELSE '' END AS registration_superseded_by_npis FROM k""")
def l21_registration(spark, sf):
    return _registration(spark, sf).withColumn("registration_latest_npis", joined("registration_latest_npis")).withColumn("registration_superseded_by_npis", joined("registration_superseded_by_npis"))


def _registration(spark, sf):
    o = load(spark, sf, "observations")
    return X.registration_status(o, o.where("day IS NULL"), SEQUENCE_DAY)


@query(LINK_RECORDS + """, n AS (SELECT source, email, npi, list_distinct(list(code) FILTER (code IS NOT NULL)) AS sv FROM x GROUP BY ALL), p AS (SELECT a.source, a.email, a.npi, b.source AS other, list_has_any(a.sv, b.sv) AS ok FROM n a JOIN n b ON a.email = b.email AND a.npi = b.npi AND a.source <> b.source WHERE len(a.sv) > 0 AND len(b.sv) > 0)
SELECT source, email, npi, coalesce(string_agg(other, '|' ORDER BY other) FILTER (ok), '') AS agree, coalesce(string_agg(other, '|' ORDER BY other) FILTER (NOT ok), '') AS disagree FROM p GROUP BY ALL""")
def l23_states(spark, sf):
    return L.cross_source_values(materialise(_link_records(spark, sf)), "source_state_values").withColumn("agree", joined("agree")).withColumn("disagree", joined("disagree"))


@query(HISTORY + f""", p AS (SELECT a.source, a.email, a.npi, b.source AS other, a.fa, a.la, a.sa, b.fa AS fb, b.la AS lb, b.sa AS sb FROM usable a JOIN usable b ON a.email = b.email AND a.npi = b.npi AND a.source <> b.source),
q AS (SELECT source, email, npi, other, bool_or(NOT ({d_last("la", "lb")} = 'none' OR {d_first("sa", "fa", "sb", "fb")} = 'none')) AS ok FROM p GROUP BY ALL)
SELECT source, email, npi, coalesce(string_agg(other, '|' ORDER BY other) FILTER (ok), '') AS agree, coalesce(string_agg(other, '|' ORDER BY other) FILTER (NOT ok), '') AS disagree FROM q GROUP BY ALL""")
def l23_names(spark, sf):
    names = materialise(_name_values(spark, sf).withColumnRenamed("vals", "source_name_values"))
    return L.cross_source_values(names, "source_name_values", A.any_alike).withColumn("agree", joined("agree")).withColumn("disagree", joined("disagree"))


# --- location evidence ----------------------------------------------------------------------------------------------------------------

AS_OF, WINDOW = "2024-01-20", 7
#: A hash's uids by day, uids' geos by day, prefixes and their states.
MAPPING = f"SELECT {I.EMAIL} AS email, cast(cast(ts AS date) AS string) AS day, ' C:u' || cast(user_id AS string) || '|d: u' || cast(user_id + k % 3 AS string) || '|broken|:x|' AS uids FROM {I.EVENTS} WHERE event_type = 'view'"
GEO = f"SELECT cast(cast(ts AS date) AS string) AS day, 'u' || cast(user_id AS string) AS uid, CASE WHEN k < 5 THEN 'none' ELSE cast((user_id + CASE WHEN k > 60 THEN 1 ELSE 0 END) % 30 AS string) END AS geo FROM {I.EVENTS} WHERE event_type <> 'view' AND cast(ts AS date) <> DATE '2024-01-16'"
ZIPS = "SELECT lpad(cast(n_nationkey AS string), 3, '0') AS zip3, CASE n_nationkey % 6 WHEN 0 THEN 'NY' WHEN 1 THEN 'new york' WHEN 2 THEN 'CA' WHEN 3 THEN 'Nowhere' ELSE 'TX' END AS state FROM nation UNION ALL SELECT '004', 'WA' FROM nation WHERE n_nationkey < 2"


def _raw(spark, sf, text, table):
    return spark.sql(text.format(json=I.JSON["spark"]).replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf}/{table}.parquet"))


def _location_inputs(spark, sf):
    mapping = _raw(spark, sf, MAPPING, "events").withColumn("hash", F.upper(T.email_hash(F.col("email")))).drop("email")
    return mapping, _raw(spark, sf, GEO, "events"), _raw(spark, sf, ZIPS, "nation")


WIN = f"BETWEEN DATE '{AS_OF}' - {WINDOW} AND DATE '{AS_OF}' - 1"
LOCATION = with_inputs("observations") + f""", map0 AS ({MAPPING.format(json=I.JSON["duckdb"])}), geo0 AS ({GEO.format(json=I.JSON["duckdb"])}), zip0 AS ({ZIPS}),
tok AS (SELECT sha256(lower(trim(email))) AS h, cast(day AS date) AS d, string_split(trim(unnest(string_split(uids, '|'))), ':') AS p FROM map0 WHERE cast(day AS date) {WIN}),
asked AS (SELECT DISTINCT sha256(lower(trim(email))) AS h FROM observations),
br AS (SELECT h, d, trim(p[2]) AS uid, list_sort(list_distinct(list(lower(trim(p[1]))))) AS kinds FROM tok WHERE len(p) = 2 AND trim(p[1]) <> '' AND trim(p[2]) <> '' AND h IN (FROM asked) GROUP BY ALL),
zs AS (SELECT zip3, CASE WHEN count(DISTINCT code) = 1 AND count(*) FILTER (code IS NULL) = 0 THEN max(code) END AS state FROM (SELECT trim(zip3) AS zip3, {STATE_SQL} AS code FROM zip0) GROUP BY zip3),
us AS (SELECT DISTINCT cast(day AS date) AS d, uid, z.state FROM geo0 LEFT JOIN zs z ON regexp_full_match(trim(geo), '[0-9]{{1,3}}') AND lpad(trim(geo), 3, '0') = z.zip3 WHERE cast(day AS date) {WIN}),
sd AS (SELECT uid, state, count(*) AS n, list(d) AS days FROM us GROUP BY ALL), od AS (SELECT uid, list_distinct(list(d)) AS seen FROM us GROUP BY uid),
pr AS (SELECT uid, state, n, days, row_number() OVER (PARTITION BY uid ORDER BY n DESC, state) AS r, max(n) OVER (PARTITION BY uid) AS top, count(*) OVER (PARTITION BY uid) AS states FROM sd WHERE state IS NOT NULL),
ti AS (SELECT uid, count(*) FILTER (n = top) > 1 AS tied FROM pr GROUP BY uid),
pm AS (SELECT od.uid, seen, pr.state, pr.days, coalesce(tied, false) AS tied, coalesce(states > 1, false) AS multi FROM od LEFT JOIN pr ON pr.uid = od.uid AND r = 1 LEFT JOIN ti ON ti.uid = od.uid),
ud AS (SELECT br.*, pm.state, coalesce(pm.tied, false) AS tied, coalesce(multi, false) AS multi, coalesce(list_contains(seen, d), false) AS observed, coalesce(state IS NOT NULL AND list_contains(days, d), false) AS located FROM br LEFT JOIN pm ON pm.uid = br.uid),
ev AS (SELECT h AS email_hash, count(DISTINCT uid) AS uid_count, count(DISTINCT d) AS mapping_days, count(*) AS mapped_uid_days, count(*) FILTER (observed) AS observed_uid_days, count(*) FILTER (located) AS located_uid_days, count(*) FILTER (located AND NOT tied) AS eligible_uid_days,
 count(DISTINCT uid) FILTER (located) AS located_count, count(DISTINCT uid) FILTER (tied) AS tied_count, count(DISTINCT uid) FILTER (multi) AS multistate_count, count(DISTINCT d) FILTER (located AND NOT tied) AS eligible_days, min(d) FILTER (located AND NOT tied) AS location_first_day, max(d) FILTER (located AND NOT tied) AS location_last_day,
 list_sort(list_distinct(flatten(list(kinds)))) AS uid_types, coalesce(list_sort(list_distinct(list(state) FILTER (located AND NOT tied))), []::VARCHAR[]) AS state_values FROM ud GROUP BY h)"""


def _evidence(spark, sf):
    mapping, geo, zips = _location_inputs(spark, sf)
    dated = lambda f: W.in_window(f, AS_OF, WINDOW).withColumn("day", F.col("day").cast("date"))
    bridge = materialise(W.uid_bridge(dated(mapping), load(spark, sf, "observations")))
    return W.email_location(bridge, W.primary_states(W.mapped_states(dated(geo), zips).join(bridge.select("uid").distinct(), "uid", "left_semi")))


@query(LOCATION + " SELECT * REPLACE (array_to_string(uid_types, '|') AS uid_types, array_to_string(state_values, '|') AS state_values) FROM ev")
def l24_location_evidence(spark, sf):
    return _evidence(spark, sf).withColumn("uid_types", joined("uid_types")).withColumn("state_values", joined("state_values"))


@query(LOCATION + f""", e AS (SELECT cast(unnest(range(DATE '{AS_OF}' - {WINDOW}, DATE '{AS_OF}', INTERVAL 1 DAY)) AS date) AS d), m AS (SELECT DISTINCT cast(day AS date) AS d FROM map0 WHERE cast(day AS date) {WIN}), g AS (SELECT DISTINCT cast(day AS date) AS d FROM geo0 WHERE cast(day AS date) {WIN})
SELECT {WINDOW}::bigint AS window_days, (SELECT count(*) FROM m) AS mapping_available_days, (SELECT count(*) FROM g) AS location_available_days, coalesce((SELECT string_agg(cast(d AS string), '|' ORDER BY d) FROM e WHERE d NOT IN (FROM m)), '') AS mapping_missing_days,
coalesce((SELECT string_agg(cast(d AS string), '|' ORDER BY d) FROM e WHERE d NOT IN (FROM g)), '') AS location_missing_days, CASE WHEN (SELECT count(*) FROM m) = {WINDOW} AND (SELECT count(*) FROM g) = {WINDOW} THEN 'all_source_days_present' ELSE 'missing_source_days' END AS window_status""")
def l25_coverage(spark, sf):
    mapping, geo, _ = _location_inputs(spark, sf)
    return W.source_coverage(mapping, geo, AS_OF, WINDOW).withColumn("mapping_missing_days", joined("mapping_missing_days")).withColumn("location_missing_days", joined("location_missing_days"))


def d_compare(states):
    return f"CASE WHEN st <> 'observed' THEN 'unknown_cookie_location' WHEN len({states}) = 0 THEN 'unknown_reference_state' WHEN NOT list_has_any({states}, seen) THEN 'not_observed' WHEN len({states}) = 1 AND len(seen) = 1 THEN 'corroborated' ELSE 'mixed_state_evidence' END"


RECORDS = LOCATION.replace(with_inputs("observations"), VERDICTS, 1) + """, lr AS (SELECT v.source, v.email, v.npi, v.sv2, v.sl2, v.has_latest, v.ps, coalesce(uid_count, 0) AS uid_count, coalesce(eligible_uid_days, 0) AS el, coalesce(located_uid_days, 0) AS lo, coalesce(observed_uid_days, 0) AS ob, coalesce(state_values, []::VARCHAR[]) AS seen
 FROM ver2 v LEFT JOIN ev ON ev.email_hash = sha256(lower(trim(v.email)))),
ls AS (SELECT *, CASE WHEN uid_count = 0 THEN 'no_mapping' WHEN el > 0 THEN 'observed' WHEN lo > 0 THEN 'ambiguous_primary_state' WHEN ob > 0 THEN 'unknown_state' ELSE 'no_state_observation' END AS st FROM lr)"""


@query(RECORDS + f""" SELECT source, email, npi, uid_count, st AS location_status, len(seen) AS state_count, {d_compare("sv2")} AS vendor_state_comparison, CASE WHEN has_latest THEN {d_compare("sl2")} END AS vendor_state_comparison_latest,
{d_compare("CASE WHEN ps IS NULL THEN []::VARCHAR[] ELSE [ps] END")} AS facility_state_comparison FROM ls""")
def l26_location_records(spark, sf):
    return _location(spark, sf).select(*L.KEY, "uid_count", "location_status", "state_count", "vendor_state_comparison", "vendor_state_comparison_latest", "facility_state_comparison")


def _location(spark, sf):
    mapping, geo, _ = _location_inputs(spark, sf)
    return W.location_records(_facility_links(spark, sf), _evidence(spark, sf), W.source_coverage(mapping, geo, AS_OF, WINDOW))


@query(LOCATION + " SELECT cast(day AS date) AS day, uid, max(z.state) AS state FROM geo0 LEFT JOIN zs z ON regexp_full_match(trim(geo), '[0-9]{1,3}') AND lpad(trim(geo), 3, '0') = z.zip3 GROUP BY day, uid, z.state")
def d02_mapped_states(spark, sf):
    _, geo, zips = _location_inputs(spark, sf)
    return W.mapped_states(geo.withColumn("day", F.col("day").cast("date")), zips)
