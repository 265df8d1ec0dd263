"""Queries of the engine's own operators, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import clustering as N
from tessel.operators import coverage as C
from tessel.operators import graph as G
from tessel.operators import links as L
from tessel.operators import lookups as K
from tessel.operators import relational as R
from tessel.operators import statistics as S
from tessel.plans.inputs import load, with_inputs
from tessel.session import materialise, shared_folder
from tessel.sources.bucketed import store_lookups
from tessel.sources.ledger import Run
from tessel.streaming.lookbacks import Lookback

DAY = "2024-01-30"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


#: Results of the steps that the query at work has run, while it shares them.
_SHARED: list[dict] = []


@contextmanager
def shared_steps():
    """For a query made of others: steps that they have in common run once within it, and their frames are stored."""
    _SHARED.append({})
    try:
        yield
    finally:
        _SHARED.pop()


def step(stored: bool = False):
    """A step (spark, sf) that several queries begin with; `stored`: it stores its frame by itself, or it is shared as it is."""

    def wrap(f):
        @wraps(f)
        def run(spark, sf):
            if not _SHARED:
                return f(spark, sf)
            if (f, sf) not in _SHARED[-1]:
                _SHARED[-1][f, sf] = f(spark, sf) if stored else materialise(f(spark, sf))
            return _SHARED[-1][f, sf]

        return run

    return wrap


def share(run, sf, frame) -> None:
    """Within shared_steps: the frame that a step gives from now on."""
    _SHARED[-1][run.__wrapped__, sf] = frame


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c)


# --- evidence graph -------------------------------------------------------------------------------------------------------------------

OBS = """,
seen AS (SELECT DISTINCT day, key, uid FROM activity),
sizes AS (SELECT day, key, count(*) AS n FROM seen GROUP BY day, key HAVING count(*) BETWEEN 2 AND 8),
obs AS (SELECT s.day, s.key, s.uid, n, 1.0::double / n AS weight FROM seen s JOIN sizes z ON s.day = z.day AND s.key = z.key),
pairs AS (SELECT a.day, a.uid AS uid1, b.uid AS uid2, sum(a.weight) AS weight FROM obs a JOIN obs b ON a.day = b.day AND a.key = b.key AND a.uid < b.uid GROUP BY ALL),
recent AS (SELECT uid1, uid2, sum(weight) AS weight FROM pairs WHERE day BETWEEN DATE '2024-01-16' AND DATE '2024-01-30' GROUP BY ALL HAVING count(*) >= 3),
often AS (SELECT uid1, uid2, count(*)::double AS weight FROM pairs WHERE day BETWEEN DATE '2023-12-31' AND DATE '2024-01-30' GROUP BY ALL),
merged AS (SELECT uid1, uid2, max(weight) AS weight FROM (SELECT * FROM recent UNION ALL SELECT * FROM often WHERE weight >= 3) GROUP BY ALL),
clean AS (SELECT uid1, uid2, weight FROM (SELECT *, row_number() OVER (PARTITION BY uid1 ORDER BY weight DESC, uid2 DESC) AS a, row_number() OVER (PARTITION BY uid2 ORDER BY weight DESC, uid1 DESC) AS b FROM merged) WHERE a <= 10 AND b <= 10)
"""


def _pairs(spark, sf):
    return G.pair_days(G.observations(load(spark, sf, "activity")))


def _edges(spark, sf):
    """Whole-number weights, so that sums do not depend on their order."""
    return G.lookback_count(_pairs(spark, sf), DAY).where("weight >= 3")


@query(with_inputs("activity") + OBS + "SELECT day, key, uid, n, round(weight, 6) AS weight FROM obs")
def g01_observations(spark, sf):
    return G.observations(load(spark, sf, "activity")).select("day", "key", "uid", "n", F.round("weight", 6).alias("weight"))


@query(with_inputs("activity") + OBS + "SELECT day, uid1, uid2, round(weight, 6) AS weight FROM pairs")
def g03_pair_days(spark, sf):
    return _pairs(spark, sf).withColumn("weight", F.round("weight", 6))


@query(with_inputs("activity") + OBS + "SELECT uid1, uid2, round(weight, 6) AS weight FROM recent")
def g07_lookback(spark, sf):
    return G.lookback(_pairs(spark, sf), DAY).withColumn("weight", F.round("weight", 6))


@query(with_inputs("activity") + OBS + "SELECT uid1, uid2, round(weight, 6) AS weight FROM recent")
def g07_moved_lookback(spark, sf):
    """The window of two days before, moved on by two days."""
    pairs = materialise(_pairs(spark, sf))
    window = Lookback(Run(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}", "lookback", {"tables": sf}), "days15", 15)
    window.start(pairs, "2024-01-28")
    for day in ("2024-01-29", DAY):
        window.add(day, pairs.where(F.col("day") == F.lit(day).cast("date")))
    return window.weights(DAY).withColumn("weight", F.round("weight", 6))


@query(with_inputs("activity") + OBS + "SELECT * FROM often")
def g08_lookback_count(spark, sf):
    return G.lookback_count(_pairs(spark, sf), DAY)


@query(with_inputs("activity") + OBS + "SELECT uid1, uid2, round(weight, 6) AS weight FROM clean")
def g09_merge_clean(spark, sf):
    pairs = materialise(_pairs(spark, sf))
    return G.merge_clean([G.lookback(pairs, DAY), G.lookback_count(pairs, DAY).where("weight >= 3")]).withColumn("weight", F.round("weight", 6))


@query(with_inputs("activity") + """, c AS (SELECT uid, key, count(*) AS n FROM activity GROUP BY ALL)
SELECT uid, key FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, key DESC) AS r FROM c) WHERE r = 1""")
def g10_mode_per_uid(spark, sf):
    return R.mode(load(spark, sf, "activity"), ["uid"], "key").select("uid", "key")


ALIGN = """,
cnt AS (SELECT a.group_id AS left_id, b.group_id AS right_id, count(*) AS cnt, max(b.household_id) AS household_id, max(b.stable) AS stable, max(b.reason) AS reason
        FROM {left} a JOIN {right} b ON a.uid = b.uid GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY left_id ORDER BY cnt DESC) AS r1, rank() OVER (PARTITION BY right_id ORDER BY cnt DESC) AS r2 FROM cnt),
best AS (SELECT *, count(*) OVER (PARTITION BY left_id) AS n1, count(*) OVER (PARTITION BY right_id) AS n2 FROM r WHERE r1 = 1 AND r2 = 1),
mapping AS (SELECT left_id, right_id, cnt, household_id, stable, reason FROM best WHERE n1 = 1 AND n2 = 1)"""
JOB1 = with_inputs("claims_a", "claims_b", "claims_c", "geo", "activity") + OBS + ALIGN.format(left="claims_b", right="claims_a") + """,
job1 AS (SELECT a.uid, a.group_id, a.household_id, a.stable, CASE WHEN m.right_id IS NULL THEN a.reason ELSE 'AB' END AS reason FROM claims_a a LEFT JOIN mapping m ON a.group_id = m.right_id
    UNION ALL SELECT b.uid, coalesce(m.right_id, b.group_id), CASE WHEN m.right_id IS NULL THEN b.household_id ELSE m.household_id END, coalesce(m.stable, true), CASE WHEN m.right_id IS NULL THEN b.reason ELSE 'AB' END
    FROM claims_b b LEFT JOIN mapping m ON b.group_id = m.left_id WHERE b.uid NOT IN (SELECT uid FROM claims_a))"""
ALIGN2 = ALIGN.format(left="claims_c", right="job1").replace("cnt AS (SELECT a", "cnt2 AS (SELECT a").replace("FROM cnt)", "FROM cnt2)").replace("\nr AS", "\nrr AS").replace("FROM r WHERE", "FROM rr WHERE").replace("best AS", "best2 AS").replace("FROM best ", "FROM best2 ").replace("mapping AS", "mapping2 AS")
JOB2 = JOB1 + ALIGN2 + """,
aligned AS (SELECT a.uid, a.group_id, a.household_id, a.stable, CASE WHEN m.right_id IS NULL THEN a.reason ELSE a.reason || 'C' END AS reason FROM job1 a LEFT JOIN mapping2 m ON a.group_id = m.right_id
    UNION ALL SELECT b.uid, coalesce(m.right_id, b.group_id), CASE WHEN m.right_id IS NULL THEN b.household_id ELSE m.household_id END, coalesce(m.stable, true), CASE WHEN m.right_id IS NULL THEN b.reason ELSE m.reason || 'C' END
    FROM claims_c b LEFT JOIN mapping2 m ON b.group_id = m.left_id WHERE b.uid NOT IN (SELECT uid FROM job1)),
edges AS (SELECT * FROM often WHERE weight >= 3),
two AS (SELECT uid1, uid2, weight FROM edges UNION ALL SELECT uid2, uid1, weight FROM edges),
start AS (SELECT uid, group_id, household_id, stable, 'SEED' AS reason FROM aligned WHERE uid IN (SELECT uid1 FROM two))"""


def spread(known: str, name: str) -> str:
    return f""",
{name}_w AS (SELECT t.uid1 AS uid, k.group_id, k.household_id, k.stable, sum(t.weight) * CASE WHEN k.stable THEN 2 ELSE 1 END AS w FROM two t JOIN {known} k ON t.uid2 = k.uid
    WHERE t.uid1 NOT IN (SELECT uid FROM {known}) GROUP BY t.uid1, k.group_id, k.household_id, k.stable),
{name}_1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY w DESC, group_id DESC) AS r FROM {name}_w) WHERE r = 1),
{name} AS (SELECT uid, group_id, household_id, stable, 'SP' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY w DESC, uid DESC) AS q FROM {name}_1) WHERE q <= 10)"""


FLOW = JOB2 + spread("start", "spread1") + """,
known2 AS (SELECT * FROM start UNION ALL SELECT * FROM spread1)""" + spread("known2", "spread2")


def _claims(spark, sf):
    return [load(spark, sf, f"claims_{c}") for c in "abc"]


def _job1(spark, sf):
    a, b, _ = _claims(spark, sf)
    return G.output_alignment(b, a, G.align(b, a), reason="AB")


def _aligned(spark, sf):
    job1, c = materialise(_job1(spark, sf)), load(spark, sf, "claims_c")
    return G.output_alignment(c, job1, G.align(c, job1), suffix="C")


def _flow(spark, sf):
    aligned, edges = materialise(_aligned(spark, sf)), materialise(_edges(spark, sf))
    seeds = G.seeds(aligned, edges)
    one = materialise(G.propagate(seeds, edges))
    two = G.propagate(seeds.unionByName(one), edges)
    return aligned, edges, seeds, one, two


def _stored_flow(spark, sf):
    *parts, two = _flow(spark, sf)
    return [*parts, materialise(two)]


@query(with_inputs("claims_a", "claims_b") + ALIGN.format(left="claims_b", right="claims_a") + " SELECT * FROM mapping")
def g11_align(spark, sf):
    a, b, _ = _claims(spark, sf)
    return G.align(b, a)


@query(JOB1 + " SELECT * FROM job1")
def g12_job1(spark, sf):
    return _job1(spark, sf)


@query(JOB2 + " SELECT * FROM aligned")
def g13_job2(spark, sf):
    return _aligned(spark, sf)


@query(JOB2 + " SELECT * FROM start")
def g14_seeds(spark, sf):
    return _flow(spark, sf)[2]


@query(FLOW + " SELECT 1 AS round, * FROM spread1 UNION ALL SELECT 2, * FROM spread2")
def g15_propagate(spark, sf):
    *_, one, two = _flow(spark, sf)
    return one.select(F.lit(1).alias("round"), "*").unionByName(two.select(F.lit(2).alias("round"), "*"))


@query(with_inputs("claims_b", "claims_c", "geo", "activity") + OBS + """, done AS (SELECT uid FROM claims_b UNION SELECT uid FROM claims_c), edges AS (SELECT * FROM often WHERE weight >= 3)
SELECT e.uid1, e.uid2, e.weight, g.geo FROM edges e JOIN geo g ON e.uid1 = g.uid JOIN geo h ON e.uid2 = h.uid AND h.geo = g.geo WHERE e.uid1 NOT IN (SELECT uid FROM done) AND e.uid2 NOT IN (SELECT uid FROM done)""")
def g16_remainder(spark, sf):
    _, b, c = _claims(spark, sf)
    return G.remainder(materialise(_edges(spark, sf)), b.unionByName(c), load(spark, sf, "geo"))


@query(with_inputs("activity") + OBS + """, e AS (SELECT 'd' || substr(sha256(uid1), 1, 2) AS a, 'd' || substr(sha256(uid2), 1, 2) AS b, weight, cast(weight AS int) % 5 = 0 AS c FROM often WHERE weight >= 3)
SELECT least(a, b) AS node1, greatest(a, b) AS node2, CASE WHEN a = b THEN 0.00001::double ELSE sum(weight) END AS weight, bool_or(c AND a <> b) AS conflict FROM e GROUP BY least(a, b), greatest(a, b), a = b""")
def g18_collapse(spark, sf):
    edges = materialise(_edges(spark, sf)).withColumn("conflict", F.pmod(F.col("weight").cast("int"), F.lit(5)) == 0)
    uids = edges.select(F.col("uid1").alias("uid")).union(edges.select("uid2")).distinct()
    return G.collapse(edges, uids.select("uid", F.concat(F.lit("d"), F.substring(F.sha2("uid", 256), 1, 2)).alias("node")))


@query(FLOW + """ SELECT uid, CASE WHEN stable THEN 'S_' ELSE '' END || cast(group_id AS string) AS group_id, CASE WHEN household_id = 0 THEN '' ELSE CASE WHEN stable THEN 'S_' ELSE '' END || cast(household_id AS string) END AS household_id, reason
FROM (SELECT * FROM aligned UNION ALL SELECT * FROM spread1 UNION ALL SELECT * FROM spread2) WHERE group_id <> 0 AND NOT (starts_with(uid, 'A_') AND reason = 'SP') AND NOT regexp_full_match(uid, '[01_!*-]*')""")
def g20_publish(spark, sf):
    aligned, _, _, one, two = _flow(spark, sf)
    return G.publish([aligned, one, two])


@query(None)
def g17_clusters(spark, sf):
    """No SQL: clustering is iterative. Uids go by their hashes; some pairs are of one device, some others of different users."""
    edges = G.remainder(materialise(_edges(spark, sf)), load(spark, sf, "claims_c"), load(spark, sf, "geo"))
    edges = edges.select("geo", T.id_hash(F.col("uid1")).alias("uid1"), T.id_hash(F.col("uid2")).alias("uid2"), "weight")
    same = F.pmod("uid1", F.lit(4)) == F.pmod("uid2", F.lit(4))
    return N.cluster_geos(edges.withColumn("same", same).withColumn("diff", ~same & (F.pmod(F.col("uid1").bitwiseXOR(F.col("uid2")), F.lit(5)) == 0)))


RULES = ["repeated uids", "devices over 5", "households over 100", "devices in two matches", "matches in two households", "foes in one match"]


@query(f"""WITH edges AS (SELECT o_orderpriority AS geo, o_custkey AS uid1, 1000000000 + cast(floor(o_orderkey / 7.0) AS bigint) AS uid2 FROM orders)
SELECT 'uids' AS rule, count(*) AS n FROM (SELECT geo, uid1 FROM edges UNION SELECT geo, uid2 FROM edges) UNION ALL SELECT * FROM (VALUES {', '.join(f"('{r}', 0)" for r in RULES)}) v""")
def g17_limits(spark, sf):
    """What must hold for clusters of components that no single task holds: every uid once, groups nested and within their limits, conflicts apart."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    uid2 = 1_000_000_000 + F.floor(F.col("o_orderkey") / 7)
    edges = orders.select(
        F.col("o_orderpriority").alias("geo"), F.col("o_custkey").alias("uid1"), uid2.alias("uid2"), (1 + F.pmod("o_orderkey", F.lit(9))).cast("double").alias("weight"),
        (F.pmod("o_orderkey", F.lit(3)) == 0).alias("same"), (F.pmod("o_orderkey", F.lit(5)) == 1).alias("diff"))
    found = materialise(N.cluster_geos(edges, 1_000))
    devices = found.groupBy("geo", "device_id").agg(F.count("*").alias("uids"), F.countDistinct("match_id", "household_id").alias("groups"), F.max("match_id").alias("match_id"), F.max("household_id").alias("household_id"))
    matches = devices.withColumn("match", F.when(F.col("match_id") == 0, -F.col("device_id")).otherwise(F.col("match_id"))).groupBy("geo", "match").agg(F.countDistinct("household_id").alias("houses"), F.max("household_id").alias("household_id"))
    houses = matches.where("household_id <> 0").groupBy("geo", "household_id").count()
    of = lambda k: found.select("geo", F.col("uid").alias(f"uid{k}"), F.col("device_id").alias(f"d{k}"), F.col("match_id").alias(f"m{k}"))
    foes = edges.where("diff").join(of(1), ["geo", "uid1"]).join(of(2), ["geo", "uid2"]).where("d1 <> d2 AND m1 = m2 AND m1 <> 0")
    breaks = [found.groupBy("geo", "uid").count().where("count > 1"), devices.where("uids > 5"), houses.where("count > 100"), devices.where("groups > 1"), matches.where("houses > 1"), foes]
    counts = [found.select("geo", "uid").distinct().agg(F.lit("uids").alias("rule"), F.count("*").alias("n")), *(b.agg(F.lit(r).alias("rule"), F.count("*").alias("n")) for r, b in zip(RULES, breaks))]
    return R.union_all(counts)


PUBLISHED = FLOW + """, published AS (SELECT uid, CASE WHEN stable THEN 'S_' ELSE '' END || cast(group_id AS string) AS group_id, CASE WHEN household_id = 0 THEN '' ELSE CASE WHEN stable THEN 'S_' ELSE '' END || cast(household_id AS string) END AS household_id, reason
FROM (SELECT * FROM aligned UNION ALL SELECT * FROM spread1 UNION ALL SELECT * FROM spread2) WHERE group_id <> 0 AND NOT (starts_with(uid, 'A_') AND reason = 'SP') AND NOT regexp_full_match(uid, '[01_!*-]*'))"""


@query(with_inputs("claims_a", "claims_c") + """, c AS (SELECT x.group_id AS left_id, a.group_id AS right_id, count(*) AS n FROM claims_c x JOIN claims_a a ON a.uid = x.uid GROUP BY ALL),
best AS (SELECT left_id, right_id FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY n DESC, right_id DESC) AS r FROM c) WHERE r = 1)
SELECT uid, group_id FROM claims_a UNION ALL SELECT x.uid, coalesce(right_id, x.group_id) FROM claims_c x LEFT JOIN best ON left_id = x.group_id WHERE x.uid NOT IN (SELECT uid FROM claims_a)""")
def g24_merge_residual(spark, sf):
    return K.merge_residual(load(spark, sf, "claims_a"), load(spark, sf, "claims_c"))


@query(with_inputs("claims_a") + "SELECT uid, group_id, household_id, reason, max(household_id) OVER w AS group_household_id, max(reason) OVER w AS group_reason FROM claims_a WINDOW w AS (PARTITION BY group_id)")
def g25_group_metadata(spark, sf):
    return K.group_metadata(load(spark, sf, "claims_a").select("uid", "group_id", "household_id", "reason"), ["household_id", "reason"])


@query(PUBLISHED + """ SELECT 'NS_' || group_id AS graphid, array_to_string(list_sort(list(DISTINCT uid)), '|') AS uids FROM published WHERE group_id <> '' GROUP BY group_id HAVING count(*) BETWEEN 2 AND 49
UNION ALL SELECT 'NSH_' || household_id, array_to_string(list_sort(list(DISTINCT uid)), '|') FROM published WHERE household_id <> '' GROUP BY household_id HAVING count(*) < 50""")
def g26_lookups(spark, sf):
    rows = materialise(g20_publish(spark, sf))
    return K.match_lookup(rows).unionAll(K.household_lookup(rows)).select("graphid", joined("uids"))


@query(PUBLISHED + """, m AS (SELECT 'NS_' || group_id AS graphid, count(DISTINCT uid) AS uids FROM published WHERE group_id <> '' GROUP BY group_id HAVING count(*) BETWEEN 2 AND 49
UNION ALL SELECT 'NSH_' || household_id, count(DISTINCT uid) FROM published WHERE household_id <> '' GROUP BY household_id HAVING count(*) < 50),
g AS (SELECT DISTINCT uid, 'NS_' || group_id AS graphid FROM published UNION SELECT uid, 'NSH_' || household_id FROM published) SELECT uid, graphid, uids FROM g JOIN m USING (graphid) WHERE length(graphid) > 7""")
def g26_stored_lookups(spark, sf):
    """Every uid with its graph ids and their sizes, from the bucketed tables."""
    name = uuid.uuid4().hex
    stored = store_lookups(materialise(g20_publish(spark, sf)), f"lookup_{name}", f"{shared_folder(spark)}/lookup-{name}", 7)
    sizes = stored.match.unionAll(stored.household).select("graphid", F.size("uids").cast("long").alias("uids"))
    return stored.uid.select("uid", F.explode("graphids").alias("graphid")).join(sizes, "graphid").select("uid", "graphid", "uids")


@query(PUBLISHED + " SELECT uid, group_id, household_id, reason FROM published")
def s08_run(spark, sf):
    """The published rows by a ledger of steps: a run that ended after its first step is opened again and goes on; nothing is written twice."""
    inputs = {"tables": sf}
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    Run(spark, path, "flow", inputs).table("published", g20_publish(spark, sf))
    run = Run(spark, path, "flow", inputs)
    bucket, values = F.pmod(F.xxhash64("uid"), F.lit(4)).cast("int"), list(range(4))
    run.load("buckets", run.read("published"), values, bucket)
    if run.load("buckets", run.read("published"), values, bucket)["loaded"]:
        raise ValueError("a committed bucket was loaded again")
    return run.loaded("buckets", values).select("uid", "group_id", "household_id", "reason")


@query(PUBLISHED + """, g AS (SELECT uid, 'NS_' || group_id AS graphid FROM published UNION ALL SELECT uid, 'NSH_' || household_id FROM published)
SELECT uid, array_to_string(list_sort(list(DISTINCT graphid)), '|') AS graphids FROM g WHERE length(graphid) > 7 GROUP BY uid""")
def g26_uid_lookup(spark, sf):
    return K.uid_lookup(g20_publish(spark, sf), 7).select("uid", joined("graphids"))


@query(PUBLISHED + """, m AS (SELECT group_id FROM published WHERE group_id <> '' GROUP BY group_id HAVING count(*) BETWEEN 2 AND 49)
SELECT DISTINCT NULL::VARCHAR AS userid, 'NPIIDN_' || key AS segment, 'NS_' || group_id AS graphid FROM activity JOIN published USING (uid) WHERE group_id IN (SELECT group_id FROM m) AND key IS NOT NULL""")
def g27_segments(spark, sf):
    segments = load(spark, sf, "activity").select("uid", F.concat(F.lit("NPIID_"), "key").alias("segment"))
    return K.attach_segments(segments, K.exploded(K.match_lookup(g20_publish(spark, sf))), "NPIID_", "NPIIDN_")


@query(with_inputs("claims_a", "claims_b") + """, c AS (SELECT b.group_id AS left_id, a.group_id AS right_id, count(*) AS cnt FROM claims_b b JOIN claims_a a ON a.uid = b.uid GROUP BY ALL)
SELECT left_id, right_id, cnt FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY cnt DESC, right_id DESC) AS r FROM c) WHERE r = 1""")
def g23_one_way_best(spark, sf):
    a, b, _ = _claims(spark, sf)
    return G.one_way_best(b, a)


@query(with_inputs("activity", "claims_c") + OBS + """, k AS (SELECT DISTINCT uid FROM claims_c)
SELECT uid1 AS uid, uid2 AS other FROM often WHERE weight >= 3 AND uid1 IN (FROM k) UNION SELECT uid2, uid1 FROM often WHERE weight >= 3 AND uid2 IN (FROM k)""")
def j10_neighbours(spark, sf):
    return R.neighbours(load(spark, sf, "claims_c"), _edges(spark, sf))


@query(with_inputs("claims_a", "claims_b") + """, x AS (SELECT uid, household_id FROM claims_a), y AS (SELECT uid, household_id FROM claims_b)
SELECT uid, household_id, sum(s)::bigint AS delta FROM (SELECT *, 1 AS s FROM x UNION ALL SELECT *, -1 FROM y) GROUP BY ALL HAVING sum(s) <> 0""")
def u05_multiset_difference(spark, sf):
    a, b, _ = _claims(spark, sf)
    return R.multiset_difference(a.select("uid", "household_id"), b.select("uid", "household_id"))


@query(with_inputs("claims_b") + """, g AS (SELECT group_id, string_agg(uid, '|' ORDER BY uid) AS members FROM (SELECT DISTINCT group_id, uid FROM claims_b) GROUP BY ALL)
SELECT DISTINCT c.uid, g.members FROM claims_b c JOIN g ON c.group_id = g.group_id""")
def a31_members_by_label(spark, sf):
    return R.members_by_label(load(spark, sf, "claims_b"), "group_id", "uid").distinct()


# --- link evidence --------------------------------------------------------------------------------------------------------------------

LINKS = with_inputs("observations", "npi_states") + """,
l AS (SELECT source, email, npi, list_sort(list_distinct(list(day) FILTER (day IS NOT NULL))) AS ds, min(day) AS first_seen_day, max(day) AS last_seen_day, count(*) AS observation_count,
      count(*) FILTER (day IS NULL) AS undated FROM observations GROUP BY ALL),
ld AS (SELECT DISTINCT source, email, npi, day AS d FROM observations WHERE day IS NOT NULL),
daily AS (SELECT source, email, d, string_agg(npi, '|' ORDER BY npi) AS npis, count(*) AS n FROM ld GROUP BY ALL),
conf AS (SELECT source, email, d FROM daily WHERE n > 1),
per AS (SELECT source, email, count(DISTINCT npis) > 1 AS changed FROM daily GROUP BY ALL),
mult AS (SELECT source, email, count(DISTINCT npi) AS email_npi_count, count(*) FILTER (undated > 0) AS undated_link_count FROM l GROUP BY ALL),
linkage AS (SELECT m.*, CASE WHEN coalesce(changed, false) THEN true WHEN email_npi_count = 1 THEN false WHEN undated_link_count > 0 THEN NULL ELSE false END AS has_been_reassigned
      FROM mult m LEFT JOIN per p ON m.source = p.source AND m.email = p.email),
lc AS (SELECT x.source, x.email, x.npi, x.d FROM ld x JOIN conf c ON x.source = c.source AND x.email = c.email AND x.d = c.d)
"""


@step(stored=True)
def _links(spark, sf):
    return materialise(L.links(load(spark, sf, "observations")))


@step(stored=True)
def _conflicts(spark, sf):
    linked = _links(spark, sf)
    return materialise(L.link_conflicts(linked, L.email_linkage(linked)))


@query(LINKS + """SELECT source, email, npi, coalesce(array_to_string(ds, '|'), '') AS observed_days, first_seen_day, last_seen_day, observation_count, undated AS undated_observation_count,
upper(sha256(source || chr(0) || email || chr(0) || npi)) AS link_id FROM l""")
def l03_links(spark, sf):
    return _links(spark, sf).withColumn("observed_days", joined("observed_days"))


@query(LINKS + "SELECT * FROM mult")
def l04_multiplicity(spark, sf):
    return L.email_multiplicity(_links(spark, sf))


@query(LINKS + "SELECT k.*, coalesce((SELECT string_agg(cast(d AS string), '|' ORDER BY d) FROM conf c WHERE c.source = k.source AND c.email = k.email), '') AS conflict_days FROM linkage k")
def l05_reassignment(spark, sf):
    return L.email_linkage(_links(spark, sf)).withColumn("conflict_days", joined("conflict_days"))


@query(LINKS + """, h AS (SELECT source, email, npi, count(*) AS n FROM lc GROUP BY ALL)
SELECT l.source, l.email, l.npi, coalesce(h.n, 0)::int AS conflict_day_count, CASE WHEN h.n > 0 THEN true WHEN email_npi_count = 1 THEN false WHEN undated > 0 THEN NULL ELSE false END AS has_conflict_linkage
FROM l JOIN linkage k ON l.source = k.source AND l.email = k.email LEFT JOIN h ON l.source = h.source AND l.email = h.email AND l.npi = h.npi""")
def l06_conflicts(spark, sf):
    return _conflicts(spark, sf).select("source", "email", "npi", F.size("conflict_days").alias("conflict_day_count"), "has_conflict_linkage")


@query(LINKS + """, v AS (SELECT npi, list(DISTINCT state) AS vals FROM npi_states GROUP BY npi),
p AS (SELECT DISTINCT a.source, a.email, a.npi, b.npi AS peer FROM lc a JOIN lc b ON a.source = b.source AND a.email = b.email AND a.d = b.d AND a.npi <> b.npi)
SELECT p.source, p.email, p.npi, count(*) AS peers, CASE WHEN count(*) FILTER (list_has_any(x.vals, y.vals)) > 0 THEN true WHEN count(*) FILTER (x.vals IS NULL OR y.vals IS NULL) > 0 THEN NULL ELSE false END AS shares
FROM p LEFT JOIN v x ON p.npi = x.npi LEFT JOIN v y ON p.peer = y.npi GROUP BY ALL""")
def l10_peer_states(spark, sf):
    linked = _conflicts(spark, sf)
    states = load(spark, sf, "npi_states").groupBy("npi").agg(F.collect_set("state").alias("vals"))
    return L.conflict_peers(linked, linked.select("source", "email", "npi").join(states, "npi")).select("source", "email", "npi", "peers", "shares")


@query(LINKS + """, s AS (SELECT source, max(last_seen_day) AS z FROM l GROUP BY source)
SELECT l.source, email, npi, z AS source_latest_day, CASE WHEN z <= DATE '2024-02-10' THEN date_diff('day', z, DATE '2024-02-10') END::int AS source_age_days,
CASE WHEN z <= DATE '2024-02-10' THEN date_diff('day', last_seen_day, z) END::int AS link_lag_days FROM l JOIN s ON l.source = s.source""")
def l16_freshness(spark, sf):
    return L.link_freshness(_links(spark, sf), "2024-02-10")


@query(LINKS + """, e AS (SELECT source, email, count(*) AS n FROM daily GROUP BY ALL), h AS (SELECT source, email, npi, count(*) AS n FROM lc GROUP BY ALL)
SELECT l.source, l.email, l.npi, coalesce(e.n, 0) AS email_day_count, coalesce(len(ds), 0)::int AS link_day_count, coalesce(h.n, 0)::int AS conflict_day_count,
round(CASE WHEN len(ds) > 0 THEN len(ds)::double / e.n END, 6) AS presence_share, round(CASE WHEN len(ds) > 0 THEN coalesce(h.n, 0)::double / len(ds) END, 6) AS overlap_share, m.undated_link_count > 0 AS has_undated
FROM l JOIN mult m ON l.source = m.source AND l.email = m.email LEFT JOIN e ON l.source = e.source AND l.email = e.email LEFT JOIN h ON l.source = h.source AND l.email = h.email AND l.npi = h.npi""")
def l17_stability(spark, sf):
    return L.link_stability(_conflicts(spark, sf)).withColumn("presence_share", F.round("presence_share", 6)).withColumn("overlap_share", F.round("overlap_share", 6))


@query(LINKS + """, n AS (SELECT source, email, d, list(npi ORDER BY npi) AS npis FROM ld WHERE d <= DATE '2024-01-25' GROUP BY ALL),
p AS (SELECT *, lag(npis) OVER w AS prev, coalesce(list_distinct(flatten(list(npis) OVER (PARTITION BY source, email ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), []) AS past FROM n WINDOW w AS (PARTITION BY source, email ORDER BY d)),
q AS (SELECT *, CASE WHEN prev IS NULL THEN [] ELSE list_filter(npis, lambda x: NOT list_contains(prev, x)) END AS added, coalesce(list_filter(prev, lambda x: NOT list_contains(npis, x)), []) AS removed FROM p)
SELECT source, email, count(*) AS n_days, count(*) AS versions, sum(len(list_filter(npis, lambda x: NOT list_contains(past, x))))::bigint AS npis_seen, count(*) FILTER (len(added) > 0 OR len(removed) > 0) AS changes,
count(*) FILTER (len(added) > 0 AND len(removed) > 0) AS swaps, count(*) FILTER (len(added) > 0 AND len(removed) > 0 AND list_has_any(added, past)) AS flipbacks FROM q GROUP BY ALL""")
def l20_sequence(spark, sf):
    return L.sequence_summary(L.sequence_history(_links(spark, sf), "2024-01-25"))


@query(LINKS + """, d AS (SELECT DISTINCT split_part(email, '@', 2) AS domain, email, npi FROM l), s AS (SELECT domain, state, count(*) AS n FROM (SELECT DISTINCT domain, npi FROM d) x JOIN npi_states t ON x.npi = t.npi GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, state DESC) AS r, sum(n) OVER (PARTITION BY domain) AS t FROM s)
SELECT d.domain, count(DISTINCT email) AS emails, count(DISTINCT npi) AS npis, any_value(b.state) AS top_state, round(any_value(b.n::double / b.t), 6) AS top_state_share FROM d LEFT JOIN b ON d.domain = b.domain AND b.r = 1 GROUP BY d.domain""")
def l22_domain(spark, sf):
    return L.domain_evidence(_links(spark, sf), load(spark, sf, "npi_states")).withColumn("top_state_share", F.round("top_state_share", 6))


@query(LINKS + """SELECT a.source, a.email, a.npi, coalesce((SELECT string_agg(DISTINCT b.source, '|' ORDER BY b.source) FROM l b WHERE b.email = a.email AND b.source <> a.source AND b.npi = a.npi), '') AS agree,
coalesce((SELECT string_agg(DISTINCT b.source, '|' ORDER BY b.source) FROM l b WHERE b.email = a.email AND b.source <> a.source AND NOT EXISTS (SELECT 1 FROM l c WHERE c.email = a.email AND c.source = b.source AND c.npi = a.npi)), '') AS disagree FROM l a""")
def l23_cross_source(spark, sf):
    return L.cross_source(_links(spark, sf)).withColumn("agree", joined("agree")).withColumn("disagree", joined("disagree"))


@query(with_inputs("observations") + f""", e AS (SELECT DISTINCT email FROM observations UNION ALL SELECT 'info@x.edu' UNION ALL SELECT 'bad@@x' UNION ALL SELECT 'n@gmail.com')
SELECT email, regexp_full_match(email, '[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{{2,}}') AS valid, coalesce(regexp_extract(email, '^([^@]+)@', 1) IN ({", ".join(f"'{x}'" for x in T.ROLE_ACCOUNTS)}), false) AS role,
CASE WHEN strpos(email, '@') = 0 THEN 'unknown' WHEN regexp_matches(lower(regexp_extract(email, '@(.*)$', 1)), '{T.INSTITUTION}') THEN 'institutional' WHEN regexp_matches(lower(regexp_extract(email, '@(.*)$', 1)), '{T.FREE}') THEN 'free' ELSE 'custom' END AS class,
lower(regexp_extract(email, '@(.*)$', 1)) AS domain, sha256(lower(trim(email))) AS hash FROM e""")
def f19_email(spark, sf):
    e = load(spark, sf, "observations").select("email").distinct().unionAll(spark.createDataFrame([("info@x.edu",), ("bad@@x",), ("n@gmail.com",)], "email string"))
    c = F.col("email")
    return e.select("email", T.email_format_valid(c).alias("valid"), T.email_role_account(c).alias("role"), T.email_domain_class(c).alias("class"), T.email_domain(c).alias("domain"), T.email_hash(c).alias("hash"))


@query(with_inputs("registry") + """, d AS (SELECT DISTINCT npi FROM registry), x AS (SELECT npi, unnest(range(10)) AS k FROM d), y AS (SELECT npi, k, cast(substr(npi, k + 1, 1) AS int) AS v FROM x),
z AS (SELECT npi, 24 + sum(CASE WHEN k % 2 = 0 THEN CASE WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END ELSE v END) AS t FROM y GROUP BY npi)
SELECT npi, t % 10 = 0 AS checksum, CASE WHEN NOT regexp_full_match(npi, '[1-4].*') THEN 'unsupported_prefix' WHEN t % 10 <> 0 THEN 'checksum_failure' ELSE 'valid' END AS structure FROM z""")
def f26_identity(spark, sf):
    c = F.col("npi")
    return load(spark, sf, "registry").select("npi").distinct().select("npi", T.npi_checksum_valid(c).alias("checksum"), T.npi_structure_reason(c).alias("structure"))


# --- quality, loader, metrics, statistics ---------------------------------------------------------------------------------------------


@query(with_inputs("claims_a", "activity") + """, u AS (SELECT DISTINCT uid FROM activity), c AS (SELECT group_id, count(DISTINCT c.uid) AS members, count(DISTINCT u.uid) AS active FROM claims_a c LEFT JOIN u ON c.uid = u.uid GROUP BY ALL)
SELECT members, active, count(*) AS groups FROM c GROUP BY ALL""")
def v02_coverage(spark, sf):
    return C.count_combinations(C.group_coverage(load(spark, sf, "claims_a"), load(spark, sf, "activity")))


@query(with_inputs("claims_b", "activity") + """, u AS (SELECT DISTINCT uid FROM activity), c AS (SELECT group_id, count(DISTINCT c.uid) AS members, count(DISTINCT u.uid) AS active FROM claims_b c LEFT JOIN u ON c.uid = u.uid GROUP BY ALL)
SELECT group_id, members, active FROM c WHERE (100.0 * active / members <= 90 * (1 - members / 12.0) OR (100.0 * active / members > 95 AND members < 12)) AND active >= 1 AND members < 10""")
def v03_eligible(spark, sf):
    return C.eligible(C.group_coverage(load(spark, sf, "claims_b"), load(spark, sf, "activity")), 90, 12, 10)


@query(with_inputs("claims_a") + "SELECT * FROM claims_a WHERE ('0x' || substr(sha256(cast(group_id AS string)), 1, 6))::bigint < 5033164")
def v04_star_sample(spark, sf):
    return C.star_sample(load(spark, sf, "claims_a"), 0.3)


@query("""WITH s AS (SELECT l_quantity AS value, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL)
SELECT value, round(sum(w) OVER (ORDER BY value) / (SELECT sum(w) FROM s), 6) AS ecdf FROM s""")
def a29_ecdf(spark, sf):
    v = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_quantity").alias("value"), "l_linenumber")
    return C.weighted_ecdf(v, "value", "l_linenumber").withColumn("ecdf", F.round("ecdf", 6))


@query(with_inputs("claims_a", "claims_b") + """, m AS (SELECT DISTINCT a.group_id, a.uid, b.group_id AS candidate FROM claims_a a JOIN claims_b b ON a.uid = b.uid), v AS (SELECT *, 1.0::double / count(*) OVER (PARTITION BY group_id, uid) AS x FROM m),
s AS (SELECT group_id, candidate, sum(x) AS support FROM v GROUP BY ALL)
SELECT group_id, round(max(support), 6) AS dominant, round(sum(support), 6) AS total, count(*) AS candidates, round(max(support) / sum(support), 6) AS purity FROM s GROUP BY ALL""")
def v09_purity(spark, sf):
    a, b, _ = _claims(spark, sf)
    out = C.purity(a.select("group_id", "uid").join(b.select("uid", F.col("group_id").alias("candidate")), "uid"))
    return out.select("group_id", "candidates", *[F.round(c, 6).alias(c) for c in ("dominant", "total", "purity")])


@query(with_inputs("observations") + """, n AS (SELECT email, count(DISTINCT npi) AS n FROM observations GROUP BY ALL) SELECT CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS fan_out, count(*) AS keys FROM n GROUP BY ALL""")
def v08_fan_out(spark, sf):
    return C.fan_out(load(spark, sf, "observations"), "email", "npi")


@query(with_inputs("npi_states") + """, c AS (SELECT npi, state, count(*) AS n FROM npi_states GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY n DESC, state DESC) AS r, sum(n) OVER (PARTITION BY npi) AS t FROM c)
SELECT npi, state, round(n::double / t, 6) AS share FROM r WHERE r = 1""")
def d01_majority_map(spark, sf):
    return C.majority_map(load(spark, sf, "npi_states"), "npi", "state").withColumn("share", F.round("share", 6))


@query(with_inputs("activity") + "SELECT * FROM activity WHERE day IN (SELECT DISTINCT day FROM activity ORDER BY day DESC LIMIT 7)")
def d06_newest_days(spark, sf):
    return C.newest_days(load(spark, sf, "activity"), "day")


@query(FLOW + """, t AS (SELECT 'aligned' AS stage, * FROM aligned UNION ALL SELECT 'spread1', * FROM spread1 UNION ALL SELECT 'spread2', * FROM spread2)
SELECT stage, reason, grouping(stage)::int AS all_stages, grouping(reason)::int AS all_reasons, count(DISTINCT group_id) AS group_ids, count(DISTINCT uid) AS uids, count(*) AS rows FROM t GROUP BY GROUPING SETS ((stage, reason), (stage), ())""")
def m03_stage_metrics(spark, sf):
    aligned, _, _, one, two = _flow(spark, sf)
    return C.stage_metrics(R.union_all([f.withColumn("stage", F.lit(n)) for f, n in ((aligned, "aligned"), (one, "spread1"), (two, "spread2"))]))


@query(JOB2 + """, k AS (SELECT c.uid, bool_or(EXISTS (SELECT 1 FROM aligned a WHERE a.uid = c.uid AND a.group_id = c.group_id)) AS same, bool_or(c.uid IN (SELECT uid FROM aligned)) AS any FROM claims_b c GROUP BY c.uid)
SELECT CASE WHEN same THEN 'same_id' WHEN "any" THEN 'reassigned_only' ELSE 'unrepresented' END AS representation, count(*) AS uids FROM k GROUP BY ALL""")
def m05_representation(spark, sf):
    return C.representation(load(spark, sf, "claims_b"), _aligned(spark, sf))


@query(with_inputs("activity") + OBS + ", e AS (SELECT * FROM often WHERE weight >= 3) SELECT count(DISTINCT uid) AS uids, (SELECT count(*) FROM e) AS relationships FROM (SELECT uid1 AS uid FROM e UNION ALL SELECT uid2 FROM e)")
def m06_graph_size(spark, sf):
    return C.graph_size(_edges(spark, sf))


@query(JOB2 + """, x AS (SELECT uid, 1 AS mask, NULL AS reason FROM claims_a UNION ALL SELECT uid, 2, NULL FROM claims_b UNION ALL SELECT uid, 4, NULL FROM claims_c UNION ALL SELECT uid, 0, reason FROM aligned),
y AS (SELECT uid, bit_or(mask) AS mask, CASE count(DISTINCT reason) WHEN 0 THEN 'unrepresented' WHEN 1 THEN max(reason) ELSE 'multiple_reasons' END AS reason FROM x GROUP BY uid) SELECT mask, reason, count(*) AS uids FROM y GROUP BY ALL""")
def m08_membership(spark, sf):
    a, b, c = _claims(spark, sf)
    return C.membership_atoms({"a": a, "b": b, "c": c}, _aligned(spark, sf))


@query(LINKS + """, c AS (SELECT source, observation_count AS v FROM l) SELECT source, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95 FROM c GROUP BY source""")
def a06_percentiles(spark, sf):
    return R.exact_percentiles(_links(spark, sf), ["source"], "observation_count", {"p50": 0.5, "p95": 0.95})


# --- statistics and invariants --------------------------------------------------------------------------------------------------------


def rounded(frame, *columns):
    return frame.withColumns({c: F.round(c, 6) for c in columns})


@query(LINKS + """, x AS (SELECT source, quantile_disc(observation_count, 0.5) AS p50, quantile_disc(observation_count, 0.95) AS p95 FROM l GROUP BY source)
SELECT l.source, count(*) AS links, sum(observation_count)::bigint AS observations, max(observation_count) AS most, any_value(p50) AS p50, any_value(p95) AS p95 FROM l JOIN x ON l.source = x.source GROUP BY l.source""")
def q01_observation_counts(spark, sf):
    return S.observation_counts(_links(spark, sf))


@query(LINKS + """, f AS (SELECT l.source, has_been_reassigned AS v FROM l JOIN linkage k ON l.source = k.source AND l.email = k.email)
SELECT source, count(*) AS rows, count(*) FILTER (v) AS has_been_reassigned_true, count(*) FILTER (NOT v) AS has_been_reassigned_false, count(*) FILTER (v IS NULL) AS has_been_reassigned_unknown,
round(100.0::double * count(*) FILTER (v) / count(*), 6) AS has_been_reassigned_true_pct FROM f GROUP BY source""")
def q05_flag_rates(spark, sf):
    return rounded(S.flag_rates(_conflicts(spark, sf), ["source"], ["has_been_reassigned"]), "has_been_reassigned_true_pct")


@query(LINKS + """, c AS (SELECT source, split_part(email, '@', 2) AS domain, count(*) AS rows FROM l GROUP BY ALL)
SELECT source, domain, rows, round(100.0::double * rows / sum(rows) OVER (PARTITION BY source), 6) AS pct FROM c""")
def q04_class_shares(spark, sf):
    return rounded(S.class_shares(_links(spark, sf).withColumn("domain", T.email_domain(F.col("email"))), ["source"], "domain"), "pct")


@query(LINKS + ", e AS (SELECT source, email, count(*) AS links FROM l GROUP BY ALL) SELECT source, least(links, 5) AS npis, count(*) AS emails, sum(links)::bigint AS links FROM e GROUP BY source, least(links, 5)")
def q08_multiplicity(spark, sf):
    return S.multiplicity_histogram(_links(spark, sf))


@query(LINKS + """, h AS (SELECT source, email, npi, count(*) AS n FROM lc GROUP BY ALL),
r AS (SELECT l.source, l.email, k.has_been_reassigned AS v, CASE WHEN h.n > 0 THEN true WHEN email_npi_count = 1 THEN false WHEN undated > 0 THEN NULL ELSE false END AS c
 FROM l JOIN linkage k ON l.source = k.source AND l.email = k.email LEFT JOIN h ON l.source = h.source AND l.email = h.email AND l.npi = h.npi),
e AS (SELECT source, email, count(*) AS links, bool_or(v) AS reassigned, CASE WHEN count(*) FILTER (c) > 0 THEN true WHEN count(*) FILTER (c IS NULL) = 0 THEN false END AS conflict FROM r GROUP BY ALL)
SELECT source, reassigned, conflict, count(*) AS emails, sum(links)::bigint AS links FROM e GROUP BY ALL""")
def q09_linkage_outcomes(spark, sf):
    return S.linkage_outcomes(_conflicts(spark, sf))


@query(LINKS + """, s AS (SELECT source, max(last_seen_day) AS z FROM l GROUP BY source), g AS (SELECT l.source, date_diff('day', last_seen_day, z) AS lag FROM l JOIN s ON l.source = s.source)
SELECT source, count(lag) AS dated, count(*) - count(lag) AS undated, max(lag)::int AS longest, quantile_disc(lag, 0.5)::int AS p50, quantile_disc(lag, 0.95)::int AS p95 FROM g GROUP BY source""")
def q20_lags(spark, sf):
    return S.lag_summary(L.link_freshness(_links(spark, sf), "2024-02-10"))


@query(LINKS + """, e AS (SELECT source, email, count(*) AS n FROM daily GROUP BY ALL), h AS (SELECT source, email, npi, count(*) AS n FROM lc GROUP BY ALL),
x AS (SELECT l.source, e.n AS days, CASE WHEN len(ds) > 0 THEN len(ds)::double / e.n END AS seen, CASE WHEN len(ds) > 0 THEN coalesce(h.n, 0)::double / len(ds) END AS shared, m.undated_link_count > 0 AS open
 FROM l JOIN mult m ON l.source = m.source AND l.email = m.email LEFT JOIN e ON l.source = e.source AND l.email = e.email LEFT JOIN h ON l.source = h.source AND l.email = h.email AND l.npi = h.npi)
SELECT source, count(*) AS links, count(seen) AS dated, count(*) FILTER (open) AS incomplete, count(*) FILTER (seen = 1) AS always, count(*) FILTER (shared = 0) AS apart, count(*) FILTER (shared > 0) AS overlapping,
count(*) FILTER (shared = 1) AS all_overlapping, round(avg(seen), 6) AS mean_presence, round(avg(shared), 6) AS mean_overlap, max(days) AS most_days FROM x GROUP BY source""")
def q21_stability(spark, sf):
    return rounded(S.stability_summary(L.link_stability(_conflicts(spark, sf))), "mean_presence", "mean_overlap")


@query(LINKS + """, o AS (SELECT DISTINCT a.source, a.email, a.npi, b.source AS other FROM l a JOIN l b ON a.email = b.email AND a.source <> b.source)
SELECT o.source, o.other, count(b.npi) AS agree, count(*) - count(b.npi) AS disagree FROM o LEFT JOIN l b ON b.source = o.other AND b.email = o.email AND b.npi = o.npi GROUP BY ALL""")
def q29_source_matrix(spark, sf):
    return S.source_matrix(L.cross_source(_links(spark, sf)))
