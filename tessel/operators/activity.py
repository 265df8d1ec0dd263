"""Inputs of the identity graph: devices from user agents, addresses, geos, first-party ids, provider claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.text import uid_valid

# First-party id kinds, device ids that are none, provider C's kinds of identifiers.
FIRST_PARTY = ["FP", "MA", "I5"]
NO_DEVICE = "00000000-0000-0000-0000-000000000000"
PROVIDER_C_KINDS = ["OWN", "HARDWARE_IDFA", "HARDWARE_ANDROID_AD_ID", "HARDWARE_TV", "COOKIE"]


def normalize_ip(v: Column) -> Column:
    """Dotted IPv4 without leading zeros, IPv6 in lower case; null for other texts. (Own rule: the reference names the function only.)"""
    text = F.lower(F.trim(v))
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("int"))
    four = text.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    return F.when(four, F.when(F.forall(parts, lambda p: p <= 255), F.concat_ws(".", F.transform(parts, lambda p: p.cast("string"))))).when(text.rlike(r"\A[0-9a-f:]*:[0-9a-f:]*\z"), text)


def parse_ua(ua: Column) -> Column:
    """Class, name, system and browser of a user agent, each with its first version number; Unknown where no rule fits."""
    has = lambda *words: F.coalesce(F.lower(ua).rlike("|".join(words)), F.lit(False))
    version = lambda name: F.concat_ws(" ", F.lit(name), F.nullif(F.regexp_extract(ua, rf"{name}[ /]([0-9]+)", 1), F.lit("")))
    kind = F.when(has("smart-?tv", "appletv", "roku"), "TV").when(has("ipad", "tablet"), "Tablet").when(has("iphone", "mobile", "android"), "Phone").when(has("windows nt", "macintosh", "x11"), "Desktop").otherwise("Unknown")
    name = F.when(has("iphone"), "iPhone").when(has("ipad"), "iPad").when(has("macintosh"), "Mac").when(has("windows nt"), "PC").when(has("android"), "Android").otherwise("Unknown")
    system = F.when(has("iphone os", "ipad"), version("OS")).when(has("windows nt"), version("Windows NT")).when(has("android"), version("Android")).when(has("mac os x"), version("Mac OS X")).otherwise("Unknown")
    browser = F.when(has("firefox"), version("Firefox")).when(has("edg/"), version("Edg")).when(has("chrome"), version("Chrome")).when(has("safari"), version("Version")).otherwise("Unknown")
    return F.when(ua.isNotNull(), F.struct(kind.alias("kind"), name.alias("name"), system.alias("os"), browser.alias("browser")))


def same_device(a: Column, b: Column) -> Column:
    """Equal class, name, system and browser; a null is false."""
    return F.coalesce(a == b, F.lit(False))


def different_users(a: Column, b: Column) -> Column:
    """Of one class of phones, desktops or tablets, but not the same device; a null is false."""
    return F.coalesce((a["kind"] == b["kind"]) & a["kind"].isin("Phone", "Desktop", "Tablet") & ~same_device(a, b), F.lit(False))


def user_agents(activity: DataFrame) -> DataFrame:
    """Distinct user agents with what they say; each is parsed once."""
    return activity.select("ua").where("ua IS NOT NULL").distinct().withColumn("device", parse_ua(F.col("ua")))


def kept_activity(activity: DataFrame, countries: list[str], excluded: list[str]) -> DataFrame:
    """Activity of some countries, without some industry codes; rows without a code stay."""
    return activity.where(F.col("country").isin(countries) & (F.col("industry").isNull() | ~F.col("industry").isin(excluded)))


def settled(activity: DataFrame, now: str, lag: str = "4 hours", ts: str = "ts") -> DataFrame:
    """ST4: rows of hours that ended at least `lag` before `now`; later ones are left to the next run, as the stream's watermark leaves them."""
    return activity.where(F.date_trunc("hour", ts) + F.expr("interval 1 hour") <= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {lag}"))


def geo_observations(activity: DataFrame) -> DataFrame:
    """Distinct (day, hour, uid, country, postal) without blanks."""
    return activity.where("trim(country) <> '' AND trim(postal) <> ''").select("day", "hour", "uid", "country", "postal").distinct()


def first_party_ids(events: DataFrame) -> DataFrame:
    """(day, hour, guid, uid): the visitor id of consented visitors, device ids of 36 characters that are not zero, and first-party ids of a list."""
    visitor = F.when((F.col("visitor_status") == 3) & (F.col("visitor") != ""), F.col("visitor"))
    device = F.when((F.length("device") == 36) & (F.col("device") != NO_DEVICE), F.col("device"))
    ids = F.filter(F.split(F.coalesce("eids", F.lit("")), r"\|"), lambda e: F.split_part(e, F.lit("_"), F.lit(1)).isin(FIRST_PARTY))
    every = F.filter(F.concat(F.array(visitor, device), ids), lambda x: x.isNotNull())
    return events.select("day", "hour", "guid", F.explode(every).alias("uid"))


def first_party_pairs(ids: DataFrame) -> DataFrame:
    """Distinct (day, hour, uid1, uid2) of ids in one event."""
    one = ids.distinct()
    a, b = (one.select("day", "hour", "guid", F.col("uid").alias(f"uid{k}")) for k in (1, 2))
    return a.join(b, ["day", "hour", "guid"]).where("uid1 < uid2").select("day", "hour", "uid1", "uid2").distinct()


def provider_c_claims(rows: DataFrame) -> DataFrame:
    """Accepted kinds with the first of person, address and household as key. An empty text is a value, as coalesce takes it."""
    return rows.where(F.col("kind").isin(PROVIDER_C_KINDS)).withColumn("key", F.coalesce("pid", "ip", "household")).where("key IS NOT NULL")


def provider_a_claims(rows: DataFrame, stable_prefix: str = "XY") -> DataFrame:
    """Claims whose provider id has more than 20 characters and whose uid 12 to 39, stable by prefix; a household of one person is none."""
    kept = rows.where((F.length("person") > 20) & F.length("uid").between(12, 39)).select("uid", "person", "household", F.col("person").startswith(stable_prefix).alias("stable"))
    shared = kept.groupBy("household").agg(F.countDistinct("person").alias("n")).where("household IS NOT NULL AND n > 1").select("household", F.lit(True).alias("_s"))
    return kept.join(shared, "household", "left").select("uid", "person", F.when(F.col("_s"), F.col("household")).alias("household"), "stable")


def with_anchors(claims: DataFrame, person: str, prefix: str) -> DataFrame:
    """P10: the claims, and a synthetic uid for each provider id, so that none is lost with its uids."""
    one = claims.drop("uid").dropDuplicates([person]).withColumn("uid", F.concat(F.lit(prefix), F.col(person)))
    return claims.unionByName(one.select(claims.columns))


def select_claim(claims: DataFrame, person: str = "person") -> DataFrame:
    """One claim a uid: a stable one first, then the smallest provider id."""
    distinct = claims.select("uid", person, "stable").distinct()
    return distinct.withColumn("_n", F.row_number().over(W.partitionBy("uid").orderBy(F.desc("stable"), F.asc(person)))).where("_n = 1").drop("_n")


def active_uids(events: DataFrame) -> DataFrame:
    """Distinct valid uids of events: the visitor or else the device, and all listed ids."""
    listed = F.when(F.coalesce("eids", F.lit("")) != "", F.split("eids", r"\|")).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.coalesce("visitor", "device")), listed)
    return events.select(F.explode(F.filter(every, lambda v: v.isNotNull() & uid_valid(v))).alias("uid")).distinct()


def group_evidence(claims: DataFrame, bridge: DataFrame, geo: DataFrame, links: DataFrame) -> DataFrame:
    """Group memberships with what is known of their uids: the e-mail hashes that name a uid, the npis of those e-mails, the uid's geos.

    claims (group_id, uid), bridge (email_hash, uid), geo (uid, geo), links (email_hash, npi). Left joins: a member without evidence has one row.
    """
    named = bridge.select("email_hash", "uid").distinct().join(links.select("email_hash", "npi").distinct(), "email_hash", "left")
    return claims.select("group_id", "uid").distinct().join(named, "uid", "left").join(geo.select("uid", "geo").distinct(), "uid", "left").select("group_id", "uid", "email_hash", "npi", "geo")


def group_metrics(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Eleven numbers of each group of two uids or more: its evidence, its members' neighbours among all members of such groups, and how many
    have a neighbour in the group. Rows meet by uid; no bucket of groups is read by itself."""
    members = evidence.where("uid IS NOT NULL").select("group_id", "uid").distinct()
    large = members.groupBy("group_id").agg(F.count("*").alias("n_uids")).where("n_uids > 1")
    members = members.join(large.select("group_id"), "group_id", "left_semi")
    known = evidence.join(large, "group_id").groupBy("group_id").agg(
        F.max("n_uids").alias("n_uids"), F.countDistinct("geo").alias("n_geo"), F.countDistinct("npi").alias("n_npi"), F.countDistinct("email_hash").alias("n_emails"),
        F.countDistinct(F.when(F.col("email_hash").isNotNull(), F.col("uid"))).alias("n_uids_email_link"))
    universe = members.select("uid").distinct()
    both = edges.select(F.inline(F.array(F.struct(F.col("uid1").alias("uid"), F.col("uid2").alias("other"), "weight"), F.struct(F.col("uid2").alias("uid"), F.col("uid1").alias("other"), "weight"))))
    near = both.distinct().join(universe, "uid", "left_semi").join(universe.withColumnRenamed("uid", "other"), "other", "left_semi")
    peer = members.select("group_id", F.col("uid").alias("other"), F.lit(True).alias("_p"))
    rows = members.join(near, "uid").join(peer, ["group_id", "other"], "left")
    met = rows.groupBy("group_id").agg(
        F.countDistinct("other").alias("n_neighbours"), F.sum("weight").alias("sum_weight"), F.countDistinct("uid").alias("n_uids_in_graph"),
        F.countDistinct(F.when(F.col("_p"), F.col("uid"))).alias("n_uids_with_peer"))
    return known.join(met, "group_id", "left").fillna(0, ["n_neighbours", "sum_weight", "n_uids_in_graph", "n_uids_with_peer"])


def uids_of_hashes(clusters: DataFrame, uids: DataFrame, hash_column: str = "uid_hash") -> DataFrame:
    """Clusters of hashed uids with the uids themselves. Distinct rows of either side meet by hash; where uids share a hash, each has a row."""
    return clusters.distinct().join(uids.select(hash_column, "uid").distinct(), hash_column)


def zipped(frame: DataFrame, measures: list[str]) -> DataFrame:
    """One row (measure, value) for each of several columns: two arrays, exploded side by side."""
    rest = [c for c in frame.columns if c not in measures]
    pairs = F.arrays_zip(F.array(*map(F.lit, measures)).alias("measure"), F.array(*[F.col(m).cast("double") for m in measures]).alias("value"))
    return frame.select(*rest, F.inline(pairs)).toDF(*rest, "measure", "value")


def funnel(coverage: DataFrame, steps: dict[str, str]) -> DataFrame:
    """Groups, members and active members left after each of several rules, all of them in one scan; each rule also asks those before it."""
    passed, sums = F.lit(True), []
    for name, rule in steps.items():
        passed = passed & F.coalesce(F.expr(rule), F.lit(False))
        sums.append(F.struct(F.lit(name).alias("step"), F.count_if(passed).alias("groups"), F.coalesce(F.sum(F.when(passed, F.col("members"))), F.lit(0)).alias("members"), F.coalesce(F.sum(F.when(passed, F.col("active"))), F.lit(0)).alias("active")))
    return coverage.agg(F.array(*sums).alias("s")).select(F.inline("s"))
