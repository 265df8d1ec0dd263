"""Queries of the graph's inputs, of group quality and of flow metrics, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import activity as V
from tessel.operators import coverage as C
from tessel.operators import graph as G
from tessel.operators import location as W
from tessel.operators import relational as R
from tessel.plans import inputs as I
from tessel.plans.inputs import load, with_inputs
from tessel.plans.link_queries import AS_OF, LOCATION, WINDOW, _location_inputs, _raw
from tessel.plans.queries import FLOW, JOB2, OBS, PUBLISHED, _aligned, _claims, _edges, _flow, _job1, _stored_flow, joined, query
from tessel.session import materialise
from tessel.sources import catalog as K
from tessel.streaming.hourly import hourly_counts

AGENTS = [
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) Version/17.1 Mobile Safari/604.1", "Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/120.0 Safari/537.36", "Mozilla/5.0 (Windows NT 10.0; rv) Gecko Firefox/121.0",
    "Mozilla/5.0 (Linux; Android 14; Pixel) Chrome/119.0 Mobile Safari/537.36", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Version/17.0 Safari/605", "Mozilla/5.0 (iPad; CPU OS 16_2 like Mac OS X) Version/16.2 Safari/604",
    "Roku/DVP-9.10", "curl/8.0", None, "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Edg/120.0",
]
ADDRESSES = ["010.001.002.003", "10.1.2.3 ", "300.1.1.1", "2001:DB8::1", "none", None]
#: Raw activity: what a device says of itself, where it is, and the ids that an event carries.
RAW = f"""SELECT cast(ts AS date) AS day, hour(ts) AS hour, 'g' || cast(event_id AS string) AS guid, 'u' || cast(user_id AS string) AS uid, {I.pick('k % 10', AGENTS)} AS ua, {I.pick('k % 6', ADDRESSES)} AS ip,
 CASE WHEN k % 9 = 0 THEN ' ' ELSE 'US' END AS country, CASE WHEN k % 13 = 0 THEN NULL ELSE lpad(cast(user_id % 700 AS string), 5, '0') END AS postal,
 k % 4 AS visitor_status, CASE WHEN k % 8 = 3 THEN NULL WHEN k % 7 = 0 THEN '' ELSE 'visitor-00000' || cast(user_id AS string) END AS visitor,
 CASE WHEN k % 3 = 0 THEN '00000000-0000-0000-0000-000000000000' WHEN k % 3 = 1 THEN lpad(cast(user_id AS string), 36, 'd') ELSE 'short' END AS device,
 CASE WHEN k % 5 = 0 THEN NULL ELSE 'FP_' || lpad(cast(user_id AS string), 12, 'f') || '|XX_1|MA_' || lpad(cast({I.whole('user_id / 2.0')} AS string), 10, 'm') || '||0110_1-!*01_' END AS eids FROM {I.EVENTS}"""
PROVIDER = f"""SELECT CASE WHEN c_nationkey % 6 = 0 THEN 'u' ELSE 'cookie-0000' || cast(c_custkey AS string) END AS uid, CASE WHEN c_nationkey % 4 = 0 THEN 'XY' ELSE 'XZ' END || lpad(cast({I.whole('c_custkey / 3.0')} AS string), CASE WHEN c_nationkey = 5 THEN 9 ELSE 20 END, 'p') AS person,
 CASE WHEN c_nationkey = 9 THEN NULL ELSE 'h' || cast({I.whole('c_custkey / 4.0')} AS string) END AS household, {I.pick('c_nationkey % 6', [*V.PROVIDER_C_KINDS, 'OTHER'])} AS kind, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'p' || cast(c_custkey AS string) END AS pid,
 CASE WHEN c_nationkey % 10 = 0 THEN '' WHEN c_nationkey % 3 = 0 THEN NULL ELSE '10.0.0.' || cast(c_nationkey AS string) END AS ip FROM customer"""


def _sql(text):
    return text.format(json=I.JSON["duckdb"])


def _events(spark, sf):
    return _raw(spark, sf, RAW, "events")


def _provider(spark, sf):
    return _raw(spark, sf, PROVIDER, "customer")


def d_version(name):
    found = f"regexp_extract(ua, '{name}[ /]([0-9]+)', 1)"
    return f"'{name}' || CASE WHEN {found} = '' THEN '' ELSE ' ' || {found} END"


AGENT_SQL = f"""ua AS (SELECT DISTINCT ua, lower(ua) AS l FROM raw WHERE ua IS NOT NULL), dev AS (SELECT ua, CASE WHEN regexp_matches(l, 'smart-?tv|appletv|roku') THEN 'TV' WHEN regexp_matches(l, 'ipad|tablet') THEN 'Tablet' WHEN regexp_matches(l, 'iphone|mobile|android') THEN 'Phone'
 WHEN regexp_matches(l, 'windows nt|macintosh|x11') THEN 'Desktop' ELSE 'Unknown' END AS kind, CASE WHEN contains(l, 'iphone') THEN 'iPhone' WHEN contains(l, 'ipad') THEN 'iPad' WHEN contains(l, 'macintosh') THEN 'Mac' WHEN contains(l, 'windows nt') THEN 'PC' WHEN contains(l, 'android') THEN 'Android' ELSE 'Unknown' END AS name,
 CASE WHEN regexp_matches(l, 'iphone os|ipad') THEN {d_version('OS')} WHEN contains(l, 'windows nt') THEN {d_version('Windows NT')} WHEN contains(l, 'android') THEN {d_version('Android')} WHEN contains(l, 'mac os x') THEN {d_version('Mac OS X')} ELSE 'Unknown' END AS os,
 CASE WHEN contains(l, 'firefox') THEN {d_version('Firefox')} WHEN contains(l, 'edg/') THEN {d_version('Edg')} WHEN contains(l, 'chrome') THEN {d_version('Chrome')} WHEN contains(l, 'safari') THEN {d_version('Version')} ELSE 'Unknown' END AS browser FROM ua)"""


@query("WITH raw AS (" + _sql(RAW) + "), " + AGENT_SQL + """ SELECT a.ua, b.ua AS other, a.kind, a.name, a.os, a.browser, a.kind = b.kind AND a.name = b.name AND a.os = b.os AND a.browser = b.browser AS same,
a.kind = b.kind AND a.kind IN ('Phone', 'Desktop', 'Tablet') AND NOT (a.name = b.name AND a.os = b.os AND a.browser = b.browser) AS different FROM dev a JOIN dev b ON a.ua <= b.ua""")
def g02_user_agents(spark, sf):
    """Every pair of the distinct agents, a fixed small list."""
    one = materialise(V.user_agents(_events(spark, sf)))
    pairs = one.join(F.broadcast(one.select(F.col("ua").alias("other"), F.col("device").alias("d2"))), F.expr("ua <= other"))
    return pairs.select("ua", "other", "device.kind", "device.name", "device.os", "device.browser", V.same_device(F.col("device"), F.col("d2")).alias("same"), V.different_users(F.col("device"), F.col("d2")).alias("different"))


@query("WITH raw AS (" + _sql(RAW) + """) SELECT ip, CASE trim(ip) WHEN '010.001.002.003' THEN '10.1.2.3' WHEN '10.1.2.3' THEN '10.1.2.3' WHEN '2001:DB8::1' THEN '2001:db8::1' END AS plain, count(*) AS events FROM raw GROUP BY ALL""")
def x12_addresses(spark, sf):
    return _events(spark, sf).groupBy("ip").agg(F.count("*").alias("events")).select("ip", V.normalize_ip(F.col("ip")).alias("plain"), "events")


@query("WITH raw AS (" + _sql(RAW) + ") SELECT DISTINCT day, hour, uid, country, postal FROM raw WHERE trim(country) <> '' AND trim(postal) <> ''")
def g04_geo_observations(spark, sf):
    return V.geo_observations(_events(spark, sf)).withColumn("hour", F.col("hour").cast("long"))


FIRST = """, ids AS (SELECT day, hour, guid, visitor AS uid FROM raw WHERE visitor_status = 3 AND visitor <> '' UNION ALL SELECT day, hour, guid, device FROM raw WHERE length(device) = 36 AND device <> '00000000-0000-0000-0000-000000000000'
 UNION ALL SELECT day, hour, guid, e FROM (SELECT day, hour, guid, unnest(string_split(coalesce(eids, ''), '|')) AS e FROM raw) WHERE split_part(e, '_', 1) IN ('FP', 'MA', 'I5'))"""


@query("WITH raw AS (" + _sql(RAW) + ")" + FIRST + " SELECT * FROM ids")
def p07_first_party_ids(spark, sf):
    return V.first_party_ids(_events(spark, sf)).withColumn("hour", F.col("hour").cast("long"))


@query("WITH raw AS (" + _sql(RAW) + ")" + FIRST + " SELECT DISTINCT a.day, a.hour, a.uid AS uid1, b.uid AS uid2 FROM ids a JOIN ids b ON a.day = b.day AND a.hour = b.hour AND a.guid = b.guid AND a.uid < b.uid")
def g05_first_party_pairs(spark, sf):
    return V.first_party_pairs(V.first_party_ids(_events(spark, sf))).withColumn("hour", F.col("hour").cast("long"))


@query("WITH raw AS (" + _sql(RAW) + ")" + FIRST + """, p AS (SELECT DISTINCT a.day, a.hour, a.uid AS uid1, b.uid AS uid2 FROM ids a JOIN ids b ON a.day = b.day AND a.hour = b.hour AND a.guid = b.guid AND a.uid < b.uid)
SELECT uid1, uid2, count(*)::double AS weight FROM p WHERE day BETWEEN DATE '2023-12-31' AND DATE '2024-01-30' GROUP BY ALL""")
def g08_first_party_lookback(spark, sf):
    return G.lookback_count(V.first_party_pairs(V.first_party_ids(_events(spark, sf))), "2024-01-30")


@query("WITH raw AS (" + PROVIDER + """) SELECT uid, kind, coalesce(pid, ip, household) AS key FROM raw WHERE kind IN ('OWN', 'HARDWARE_IDFA', 'HARDWARE_ANDROID_AD_ID', 'HARDWARE_TV', 'COOKIE') AND coalesce(pid, ip, household) IS NOT NULL""")
def p08_provider_c(spark, sf):
    return V.provider_c_claims(_provider(spark, sf)).select("uid", "kind", "key")


PROVIDER_A = "WITH raw AS (" + PROVIDER + """), k AS (SELECT uid, person, household, starts_with(person, 'XY') AS stable FROM raw WHERE length(person) > 20 AND length(uid) BETWEEN 12 AND 39),
h AS (SELECT household FROM k WHERE household IS NOT NULL GROUP BY household HAVING count(DISTINCT person) > 1), a AS (SELECT uid, person, CASE WHEN household IN (FROM h) THEN household END AS household, stable FROM k)"""


@query(PROVIDER_A + " SELECT * FROM a")
def p09_provider_a(spark, sf):
    return V.provider_a_claims(_provider(spark, sf))


@query(PROVIDER_A + " SELECT uid, person FROM a UNION ALL SELECT DISTINCT 'A_' || person, person FROM a")
def p10_anchors(spark, sf):
    return V.with_anchors(V.provider_a_claims(_provider(spark, sf)).select("uid", "person"), "person", "A_")


@query("WITH raw AS (" + PROVIDER + "), k AS (SELECT DISTINCT household AS uid, person, starts_with(person, 'XY') AS stable FROM raw WHERE household IS NOT NULL) SELECT uid, person, stable FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY stable DESC, person) AS n FROM k) WHERE n = 1")
def w06_select_claim(spark, sf):
    rows = _provider(spark, sf).where("household IS NOT NULL").select(F.col("household").alias("uid"), "person", F.col("person").startswith("XY").alias("stable"))
    return V.select_claim(rows)


@query("WITH raw AS (" + _sql(RAW) + "), i AS (SELECT coalesce(visitor, device) AS uid FROM raw UNION ALL SELECT unnest(string_split(eids, '|')) FROM raw WHERE eids <> '') SELECT DISTINCT uid FROM i WHERE regexp_full_match(uid, '[A-Za-z0-9_!*-]{11,512}') AND NOT regexp_full_match(uid, '[-01_!*]*')")
def v01_active_uids(spark, sf):
    return V.active_uids(_events(spark, sf))


# --- quality --------------------------------------------------------------------------------------------------------------------------

EVIDENCE = LOCATION.replace(with_inputs("observations"), with_inputs("observations", "claims_a", "claims_b", "activity"), 1) + """, hn AS (SELECT DISTINCT sha256(lower(trim(email))) AS h, npi FROM observations), ug AS (SELECT DISTINCT uid, geo FROM geo0),
evid AS (SELECT DISTINCT m.group_id, m.uid, b.h AS email_hash, hn.npi, ug.geo FROM (SELECT DISTINCT group_id, uid FROM claims_b) m LEFT JOIN (SELECT DISTINCT h, uid FROM br) b ON b.uid = m.uid LEFT JOIN hn ON hn.h = b.h LEFT JOIN ug ON ug.uid = m.uid)"""


def _group_evidence(spark, sf):
    mapping, geo, _ = _location_inputs(spark, sf)
    observations = load(spark, sf, "observations")
    bridge = W.uid_bridge(W.in_window(mapping, AS_OF, WINDOW).withColumn("day", F.col("day").cast("date")), observations)
    return V.group_evidence(load(spark, sf, "claims_b"), bridge, geo, observations.select(T.email_hash(F.col("email")).alias("email_hash"), "npi"))


@query(EVIDENCE + " SELECT * FROM evid")
def v06_group_evidence(spark, sf):
    return _group_evidence(spark, sf)


@query(EVIDENCE + OBS + """, big AS (SELECT group_id FROM evid GROUP BY ALL HAVING count(DISTINCT uid) > 1), mem AS (SELECT DISTINCT group_id, uid FROM evid WHERE group_id IN (FROM big)), uni AS (SELECT DISTINCT uid FROM mem), e3 AS (SELECT uid1, uid2, weight FROM often WHERE weight >= 3),
nb AS (SELECT uid1 AS uid, uid2 AS other, weight FROM e3 UNION SELECT uid2, uid1, weight FROM e3), near AS (SELECT * FROM nb WHERE uid IN (FROM uni) AND other IN (FROM uni)),
k AS (SELECT group_id, count(DISTINCT uid) AS n_uids, count(DISTINCT geo) AS n_geo, count(DISTINCT npi) AS n_npi, count(DISTINCT email_hash) AS n_emails, count(DISTINCT uid) FILTER (email_hash IS NOT NULL) AS n_uids_email_link FROM evid WHERE group_id IN (FROM big) GROUP BY group_id),
c AS (SELECT m.group_id, count(DISTINCT n.other) AS n_neighbours, sum(weight) AS sum_weight, count(DISTINCT m.uid) AS n_uids_in_graph, count(DISTINCT m.uid) FILTER (p.uid IS NOT NULL) AS n_uids_with_peer FROM mem m JOIN near n ON n.uid = m.uid LEFT JOIN mem p ON p.group_id = m.group_id AND p.uid = n.other GROUP BY m.group_id)
SELECT k.*, coalesce(n_neighbours, 0) AS n_neighbours, coalesce(sum_weight, 0) AS sum_weight, coalesce(n_uids_in_graph, 0) AS n_uids_in_graph, coalesce(n_uids_with_peer, 0) AS n_uids_with_peer FROM k LEFT JOIN c ON c.group_id = k.group_id""")
def v07_group_metrics(spark, sf):
    return V.group_metrics(materialise(_group_evidence(spark, sf)), _edges(spark, sf))


@query(with_inputs("claims_a") + """, n AS (SELECT group_id, count(DISTINCT uid) AS v FROM claims_a GROUP BY ALL), s AS (SELECT * FROM n WHERE ('0x' || substr(sha256(cast(group_id AS string)), 1, 6))::bigint < 8388608), p AS (SELECT v, count(*)::double AS w FROM n GROUP BY v), q AS (SELECT v, count(*)::double AS w FROM s GROUP BY v),
b AS (SELECT coalesce(p.v, q.v) AS v, coalesce(p.w, 0) / (SELECT sum(w) FROM p) AS a, coalesce(q.w, 0) / (SELECT sum(w) FROM q) AS b FROM p FULL JOIN q ON p.v = q.v), r AS (SELECT *, sum(a) OVER (ORDER BY v) AS ra, sum(b) OVER (ORDER BY v) AS rb FROM b),
m AS (SELECT abs(sum(v * a) - sum(v * b)) AS mean_gap, sum(abs(a - b)) / 2 AS tv, max(abs(ra - rb)) AS gap FROM r)
SELECT 'mean_gap' AS measure, round(mean_gap, 6) AS value, mean_gap <= 0.5 AS within FROM m UNION ALL SELECT 'total_variation', round(tv, 6), tv <= 0.05 FROM m UNION ALL SELECT 'ecdf_gap', round(gap, 6), gap <= 0.2 FROM m""")
def v05_sample_against_population(spark, sf):
    a = load(spark, sf, "claims_a")
    sizes = lambda f: f.groupBy("group_id").agg(F.countDistinct("uid").alias("v")).withColumn("w", F.lit(1.0))
    return C.compare_distributions(sizes(a), sizes(C.star_sample(a, 0.5)), "v", "w", {"mean_gap": 0.5, "total_variation": 0.05, "ecdf_gap": 0.2}).withColumn("value", F.round("value", 6))


# --- flow metrics, audits -------------------------------------------------------------------------------------------------------------


@query(with_inputs("claims_a", "claims_b", "claims_c") + " " + " UNION ALL ".join(f"SELECT '{c}' AS source, count(DISTINCT group_id) AS group_ids, count(DISTINCT uid) AS uids, count(*) AS rows FROM claims_{c}" for c in "abc"))
def m01_source_counts(spark, sf):
    return C.source_counts(dict(zip("abc", _claims(spark, sf))))


STAGES_SQL = ", staged AS (SELECT 'aligned' AS stage, * FROM aligned UNION ALL SELECT 'spread1', * FROM spread1 UNION ALL SELECT 'spread2', * FROM spread2)"


def _staged(flow):
    aligned, _, _, one, two = flow
    return R.union_all([f.withColumn("stage", F.lit(n)) for f, n in ((aligned, "aligned"), (one, "spread1"), (two, "spread2"))])


def _staged_and_published(spark, sf):
    """The stages' rows and what is published of them, from one run of the flow; its parts are stored."""
    flow = _stored_flow(spark, sf)
    return _staged(flow), G.publish([flow[0], *flow[3:]])


@query(PUBLISHED + STAGES_SQL + """, n AS (SELECT DISTINCT uid, CASE WHEN stable THEN 'S_' ELSE '' END || cast(group_id AS string) AS group_id, stage FROM staged), f AS (SELECT DISTINCT uid, group_id FROM published)
SELECT stage, f.uid IS NOT NULL AS published, count(DISTINCT n.group_id) AS group_ids, count(*) AS assignments FROM n LEFT JOIN f ON f.uid = n.uid AND f.group_id = n.group_id GROUP BY ALL""")
def m07_stage_publication(spark, sf):
    return C.stage_publication(*_staged_and_published(spark, sf))


@query(PUBLISHED + STAGES_SQL + """, c AS (SELECT 1 AS p, 'sources' AS checkpoint, (SELECT count(DISTINCT group_id) FROM claims_a) + (SELECT count(DISTINCT group_id) FROM claims_b) + (SELECT count(DISTINCT group_id) FROM claims_c) AS group_ids, (SELECT count(*) FROM claims_a) + (SELECT count(*) FROM claims_b) + (SELECT count(*) FROM claims_c) AS rows
 UNION ALL SELECT 2, 'aligned', count(DISTINCT group_id), count(*) FROM aligned UNION ALL SELECT 3, 'spread', count(DISTINCT group_id), count(*) FROM staged UNION ALL SELECT 4, 'final', count(DISTINCT group_id), count(*) FROM published)
SELECT checkpoint, group_ids, rows, group_ids - lag(group_ids) OVER (ORDER BY p) AS change, round(group_ids::double / first(group_ids) OVER (ORDER BY p), 6) AS retained FROM c""")
def m10_flow_table(spark, sf):
    total = C.source_counts(dict(zip("abc", _claims(spark, sf)))).agg(F.sum("group_ids").alias("group_ids"), F.sum("rows").alias("rows")).withColumn("checkpoint", F.lit("sources"))
    staged, final = _staged_and_published(spark, sf)
    count = lambda f, name: f.agg(F.countDistinct("group_id").alias("group_ids"), F.count("*").alias("rows")).withColumn("checkpoint", F.lit(name))
    rows = R.union_all([total, count(staged.where("stage = 'aligned'"), "aligned"), count(staged, "spread"), count(final, "final")])
    return C.flow_table(rows, ["sources", "aligned", "spread", "final"]).withColumn("retained", F.round("retained", 6))


@query(PUBLISHED + STAGES_SQL + " SELECT uid, count(DISTINCT stage) AS stages, count(DISTINCT group_id) AS group_ids, count(DISTINCT reason) AS reasons, count(*) AS rows FROM staged GROUP BY uid")
def g21_multiplicity(spark, sf):
    return G.multiplicity(_staged(_flow(spark, sf)))


@query(JOB2 + """, g1 AS (SELECT group_id, string_agg(uid, '|' ORDER BY uid) AS members FROM (SELECT DISTINCT group_id, uid FROM job1) GROUP BY group_id), g2 AS (SELECT group_id, string_agg(uid, '|' ORDER BY uid) AS members FROM (SELECT DISTINCT group_id, uid FROM aligned) GROUP BY group_id),
sd AS (SELECT uid, members, sum(s)::bigint AS delta FROM (SELECT DISTINCT j.uid, members, 1 AS s FROM job1 j JOIN g1 ON g1.group_id = j.group_id UNION ALL SELECT DISTINCT a.uid, members, -1 FROM aligned a JOIN g2 ON g2.group_id = a.group_id) GROUP BY ALL HAVING sum(s) <> 0),
td AS (SELECT uid, group_id, sum(s)::bigint AS delta FROM (SELECT uid, group_id, 1 AS s FROM job1 UNION ALL SELECT uid, group_id, -1 FROM aligned) GROUP BY ALL HAVING sum(s) <> 0)
SELECT 'strict' AS kind, count(*) AS differing, coalesce(sum(delta) FILTER (delta > 0), 0)::bigint AS left_only, coalesce(-sum(delta) FILTER (delta < 0), 0)::bigint AS right_only FROM td UNION ALL SELECT 'structural', count(*), coalesce(sum(delta) FILTER (delta > 0), 0)::bigint, coalesce(-sum(delta) FILTER (delta < 0), 0)::bigint FROM sd""")
def g22_compare(spark, sf):
    return R.compare_clusterings(materialise(_job1(spark, sf)), materialise(_aligned(spark, sf)))


@query(with_inputs("activity") + " SELECT min(day) AS first_partition, max(day) AS last_partition, count(DISTINCT day) AS partitions, count(*)::bigint AS rows FROM activity")
def q33_inventory(spark, sf):
    return K.partition_inventory(load(spark, sf, "activity"))


@query(LOCATION + """, ms AS (SELECT DISTINCT cast(day AS date) AS day, uid, z.state FROM geo0 LEFT JOIN zs z ON regexp_full_match(trim(geo), '[0-9]{1,3}') AND lpad(trim(geo), 3, '0') = z.zip3)
SELECT day, count(*) AS source_rows, count(*) FILTER (NOT (day = DATE '2024-01-05' AND state IS NULL)) AS target_rows, count(*) FILTER (day = DATE '2024-01-05' AND state IS NULL) + count(*) FILTER (day = DATE '2024-01-09' AND state = 'NY') = 0 AS verified FROM ms GROUP BY day""")
def d05_audit(spark, sf):
    """A sound copy but for two days: rows missing on one, a state changed on the other."""
    _, geo, zips = _location_inputs(spark, sf)
    source = materialise(W.mapped_states(geo.withColumn("day", F.col("day").cast("date")), zips))
    target = source.where("NOT (day = date'2024-01-05' AND state IS NULL)").withColumn("state", F.when(F.expr("day = date'2024-01-09' AND state = 'NY'"), "ZZ").otherwise(F.col("state")))
    return C.audit_manifest(source, target)


@query(with_inputs("claims_a") + ", b AS (SELECT stable, ('0x' || substr(sha256(uid), 1, 1))::int AS bucket, count(*) AS rows FROM claims_a GROUP BY ALL) SELECT * FROM b")
def d03_bucket_rows(spark, sf):
    """Rows of each bucket; the fingerprints have no SQL and are tested."""
    a = load(spark, sf, "claims_a").withColumn("bucket", F.conv(T.sha_bucket(F.col("uid")), 16, 10).cast("int"))
    return R.fingerprint(a, ["stable", "bucket"]).drop("fingerprint")


@query(with_inputs("activity") + """, n AS (SELECT uid, count(*) AS n FROM activity GROUP BY uid) SELECT uid, n, rank() OVER (ORDER BY n DESC) AS r FROM n QUALIFY row_number() OVER (ORDER BY n DESC, uid) <= 50""")
def k01_top_uids(spark, sf):
    """A report of the first 50."""
    n = load(spark, sf, "activity").groupBy("uid").agg(F.count("*").alias("n"))
    return R.ranked_top(n, [F.desc_nulls_last("n"), F.asc("uid")], "n", 50)


@query(with_inputs("claims_a", "claims_b") + " SELECT uid FROM claims_a INTERSECT SELECT uid FROM claims_b")
def u04_in_both(spark, sf):
    return load(spark, sf, "claims_a").select("uid").intersect(load(spark, sf, "claims_b").select("uid"))


@query(FLOW + " SELECT CASE WHEN n >= 1000000 THEN round(n / 1e6, 1) || 'M' WHEN n >= 1000 THEN round(n / 1e3, 1) || 'K' ELSE cast(n AS string) END AS shown, reason FROM (SELECT reason, count(*) AS n FROM aligned GROUP BY reason)")
def f50_shown_counts(spark, sf):
    return _aligned(spark, sf).groupBy("reason").agg(F.count("*").alias("n")).select(T.shown_count(F.col("n")).alias("shown"), "reason")


@query(with_inputs("activity") + " SELECT uid, key, day, hour, 'C' || cast(hour % 7 AS string) AS country, CASE WHEN hour % 3 > 0 THEN 'I' || cast(hour % 5 AS string) END AS industry FROM activity WHERE hour % 7 < 6 AND (hour % 3 = 0 OR hour % 5 NOT IN (1, 3))")
def p06_kept_activity(spark, sf):
    hour = F.col("hour")
    rows = load(spark, sf, "activity").withColumns({"country": F.concat(F.lit("C"), (hour % 7).cast("string")), "industry": F.when(hour % 3 > 0, F.concat(F.lit("I"), (hour % 5).cast("string")))})
    return V.kept_activity(rows, [f"C{k}" for k in range(6)], ["I1", "I3"])


@query("SELECT event_id, ts FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-30 22:10:00' - INTERVAL 4 HOUR")
def st4_settled(spark, sf):
    return V.settled(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts"), "2024-01-30 22:10:00")


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS key, count(DISTINCT user_id) AS uids, count(*) AS rows FROM events GROUP BY ALL")
def st2_hourly(spark, sf):
    """The stream's rule as a batch: tumbling hours."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("ts", F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("uid"))
    out = hourly_counts(rows)
    return out.select(F.col("window.start").alias("hour"), "key", F.col("uids").cast("long").alias("uids"), "rows")


@query(with_inputs("claims_b") + """, r AS (SELECT uid, substr(sha256(uid), 1, 2) AS device_id, group_id, cast(floor(group_id / 3.0) AS bigint) AS household_id FROM claims_b), d AS (SELECT group_id, count(DISTINCT device_id) AS d, count(DISTINCT uid) AS u FROM r GROUP BY ALL), h AS (SELECT household_id, count(DISTINCT group_id) AS g FROM r GROUP BY ALL)
SELECT r.uid, r.device_id, CASE WHEN d = 1 AND u = 1 THEN 0 ELSE r.group_id END AS group_id, CASE WHEN g = 1 THEN 0 ELSE r.household_id END AS household_id FROM r JOIN d ON d.group_id = r.group_id JOIN h ON h.household_id = r.household_id""")
def g19_sentinels(spark, sf):
    rows = load(spark, sf, "claims_b").select("uid", F.substring(F.sha2("uid", 256), 1, 2).alias("device_id"), "group_id", F.floor(F.col("group_id") / 3.0).alias("household_id"))
    return G.sentinels(rows)


@query(with_inputs("claims_a", "claims_b") + ", c AS (SELECT DISTINCT substr(sha256(uid), 1, 2) AS uid_hash, group_id FROM claims_b), u AS (SELECT DISTINCT substr(sha256(uid), 1, 2) AS uid_hash, uid FROM claims_a) SELECT c.uid_hash, group_id, uid FROM c JOIN u ON u.uid_hash = c.uid_hash")
def j27_uids_of_hashes(spark, sf):
    """Hashes of eight bits, so that many uids share one."""
    short = F.substring(F.sha2("uid", 256), 1, 2).alias("uid_hash")
    return V.uids_of_hashes(load(spark, sf, "claims_b").select(short, "group_id"), load(spark, sf, "claims_a").select(short, "uid"))


@query(with_inputs("activity") + OBS + ", e AS (SELECT * FROM often WHERE weight >= 3), m AS (SELECT (SELECT count(DISTINCT uid) FROM (SELECT uid1 AS uid FROM e UNION ALL SELECT uid2 FROM e))::double AS uids, (SELECT count(*) FROM e)::double AS relationships) SELECT 'uids' AS measure, uids AS value FROM m UNION ALL SELECT 'relationships', relationships FROM m")
def j22_measures(spark, sf):
    return V.zipped(C.graph_size(_edges(spark, sf)), ["uids", "relationships"])


FUNNEL = {"all": "true", "more than one": "members > 1", "any active": "active >= 1", "few": "members < 6"}


@query(with_inputs("claims_b", "activity") + ", u AS (SELECT DISTINCT uid FROM activity), c AS (SELECT group_id, count(DISTINCT c.uid) AS members, count(DISTINCT u.uid) AS active FROM claims_b c LEFT JOIN u ON c.uid = u.uid GROUP BY ALL) " + " UNION ALL ".join(
    f"SELECT '{n}' AS step, count(*) AS groups, coalesce(sum(members), 0)::bigint AS members, coalesce(sum(active), 0)::bigint AS active FROM c WHERE {' AND '.join(list(FUNNEL.values())[: k + 1])}" for k, n in enumerate(FUNNEL)))
def a30_funnel(spark, sf):
    return V.funnel(C.group_coverage(load(spark, sf, "claims_b"), load(spark, sf, "activity")), FUNNEL)


PAYLOADS = f"""SELECT event_id, chr(123) || '"state": "' || {I.pick('k % 7', ['NY', 'new york', ' Texas ', 'Guam', 'Narnia', '', 'tx'])} || '", "country": "' || {I.pick('k % 4', ['US', 'usa', 'Canada', ' '])} || '"' || chr(125) AS payload,
 CASE WHEN k % 5 = 0 THEN 'S1_' || cast(1000000000 + user_id AS string) WHEN k % 5 = 1 THEN 'nothing' ELSE cast(user_id AS string) || '_x' END AS label FROM {I.EVENTS}"""


@query("WITH p AS (" + _sql(PAYLOADS) + """), q AS (SELECT *, trim(json_extract_string(payload, '$.state')) AS state, upper(trim(json_extract_string(payload, '$.country'))) AS country FROM p)
SELECT event_id, CASE WHEN country IN ('', 'US', 'USA') THEN CASE upper(state) WHEN 'NY' THEN 'NY' WHEN 'NEW YORK' THEN 'NY' WHEN 'TEXAS' THEN 'TX' WHEN 'TX' THEN 'TX' WHEN 'GUAM' THEN 'GU' ELSE '' END ELSE '' END AS states, nullif(regexp_extract(label, '([0-9]{10})$', 1), '') AS suffix, nullif(regexp_extract(label, '^([^_]+)_', 1), '') AS prefix FROM q""")
def f24_payloads(spark, sf):
    rows = _raw(spark, sf, PAYLOADS, "events")
    return rows.select("event_id", F.array_join(T.states_of_payload(F.col("payload"), "state", ("country",)), "|").alias("states"), T.id_suffix(F.col("label")).alias("suffix"), T.source_prefix(F.col("label")).alias("prefix"))


@query(with_inputs("names") + ", n AS (SELECT id, first_name, lower(trim(first_name)) AS x FROM names) SELECT id, first_name, coalesce(x IN ('', 'null', 'nan', chr(92) || 'n') OR x LIKE 'test%' OR x LIKE '%unknown%', true) AS junk FROM n")
def f45_junk_names(spark, sf):
    return load(spark, sf, "names").select("id", "first_name", T.junk_name(F.col("first_name")).alias("junk"))
