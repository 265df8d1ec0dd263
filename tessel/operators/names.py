"""Name evidence of links: sources' names against the e-mail and a registry's names, and how they agree over time. Unknown is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators.links import KEY

NO_TEXT = "array<string>"


def nickname_variants(nicknames: DataFrame) -> DataFrame:
    """(first_name, variants) from pairs (nickname, canonical, which may be several joined by |): one hop, both ways, sorted."""
    pairs = nicknames.select("nickname", F.explode(F.split("canonical", r"\|")).alias("canonical"))
    both = pairs.select(F.col("nickname").alias("first_name"), F.col("canonical").alias("variant")).union(pairs.select("canonical", "nickname"))
    return both.distinct().groupBy("first_name").agg(F.array_sort(F.collect_set("variant")).alias("variants"))


def with_first_set(names: DataFrame, variants: DataFrame, first: str = "first_name", out: str = "first_set") -> DataFrame:
    """Each name's first name with the variants of its first token. The vocabulary is a seed list, small whatever the data."""
    found = variants.select(F.col("first_name").alias("_token"), "variants")
    joined = names.withColumn("_token", T.first_token(F.col(first))).join(F.broadcast(found), "_token", "left")
    every = F.array_distinct(F.filter(F.concat(F.array(F.col(first)), F.coalesce("variants", F.array().cast(NO_TEXT))), lambda x: x.isNotNull()))
    return joined.withColumn(out, every).drop("_token", "variants")


def registry_names(raw: DataFrame, variants: DataFrame) -> DataFrame:
    """Distinct normalised names (npi, first_name, last_name, first_set) of a registry."""
    seen = raw.where("npi IS NOT NULL").select("npi", "first_name", "last_name").distinct()
    names = seen.select("npi", T.norm_name(F.col("first_name")).alias("first_name"), T.norm_name(F.col("last_name")).alias("last_name")).distinct()
    return with_first_set(names, variants)


def source_names(observations: DataFrame) -> DataFrame:
    """Distinct normalised names of each link; a link without any has one row of nulls. A name is normalised once, however often it was seen."""
    seen = observations.select(*KEY, "first_name", "last_name").distinct()
    names = seen.select(*KEY, F.struct(T.norm_name(F.col("first_name")).alias("first_name"), T.norm_name(F.col("last_name")).alias("last_name")).alias("n"))
    known = F.when(F.col("n.first_name").isNotNull() | F.col("n.last_name").isNotNull(), F.col("n"))
    return names.groupBy(*KEY).agg(F.collect_set(known).alias("n")).select(*KEY, F.explode_outer("n").alias("n")).select(*KEY, "n.first_name", "n.last_name")


def compared_names(names: DataFrame, registry: DataFrame, variants: DataFrame) -> DataFrame:
    """F10 to F16 for every pair of a link's name and a registry name of its npi; pairs are never mixed. A row where the registry has no name."""
    f, s, rf, rs = (F.col(c) for c in ("first_name", "last_name", "registry_first_name", "registry_last_name"))
    mine = with_first_set(names, variants).withColumn("local", T.local_letters(F.col("email")))
    mine = mine.withColumns({"source_usable": T.usable_name(f, s), "source_match": T.name_in_email_fuzzy(F.col("local"), F.col("first_set"), s)})  # before each meets several registry names
    theirs = registry.select("npi", F.col("first_name").alias("registry_first_name"), F.col("last_name").alias("registry_last_name"), F.col("first_set").alias("registry_first_set"), F.lit(True).alias("_here"))
    both = mine.join(theirs.withColumn("registry_usable", T.usable_name(rf, rs)), "npi", "left")
    both = both.withColumns({"registry_first_set": F.coalesce("registry_first_set", F.array().cast(NO_TEXT)), "registry_usable": F.coalesce("registry_usable", F.lit(False))})
    both = both.withColumns({"first_kind": T.first_kind(F.col("first_set"), f, F.col("registry_first_set"), rf), "last_kind": T.last_kind(s, rs)})
    usable = F.col("source_usable") & F.col("registry_usable")
    kind = T.registry_class(F.col("source_usable"), F.col("registry_usable"), F.col("first_kind"), F.col("last_kind"))
    return both.withColumn("match_class", kind).withColumns({
        "registry_match": T.name_in_email_fuzzy(F.col("local"), F.col("registry_first_set"), rs),
        "vendor_match": F.when(usable, F.col("match_class").isin("exact", "nickname", "token", "edit")), "registry_present": F.coalesce("_here", F.lit(False)),
        **{c: F.when(usable, F.col(c)).otherwise("unknown") for c in ("first_kind", "last_kind")},
    }).drop("_here")


def link_name_metrics(compared: DataFrame) -> DataFrame:
    """Per link three answers (true, false or unknown) over all its comparisons, their evidence and the classes that occur.

    Where a link has usable names, comparisons of unusable ones are no evidence. The evidence is sorted by its JSON text.
    """
    evidence = F.struct(
        F.when(F.col("source_usable"), F.col("first_name")).alias("source_first_name"), F.when(F.col("source_usable"), F.col("last_name")).alias("source_last_name"), "registry_first_name", "registry_last_name",
        F.col("first_kind").alias("first_name_match_kind"), F.col("last_kind").alias("last_name_match_kind"), "match_class", F.col("source_match").alias("email_matches_source_name"),
        F.col("registry_match").alias("email_matches_registry_name"), F.col("vendor_match").alias("vendor_name_matches_registry_name"))
    every = F.collect_set(F.struct(F.to_json(evidence, {"ignoreNullFields": "false"}).alias("j"), evidence.alias("e")))
    name = F.when(F.col("source_usable"), F.struct("first_name", "last_name", F.array_sort("first_set").alias("first_variants")))
    out = compared.groupBy(*KEY).agg(
        F.bool_or("source_match").alias("email_matches_source_name"), F.bool_or("registry_match").alias("email_matches_registry_name"), F.bool_or("vendor_match").alias("vendor_name_matches_registry_name"),
        F.bool_or("source_usable").alias("source_name_usable"), F.bool_or("registry_usable").alias("registry_name_usable"), F.bool_or("registry_present").alias("registry_npi_present"),
        F.array_sort(F.collect_set(name)).alias("source_name_values"), every.alias("_all"))
    kept = F.when(F.col("source_name_usable"), F.filter("_all", lambda x: x["e"]["source_first_name"].isNotNull())).otherwise(F.col("_all"))
    out = out.withColumn("name_match_evidence", F.transform(F.array_sort(kept, lambda a, b: F.when(a["j"] < b["j"], -1).when(a["j"] > b["j"], 1).otherwise(0)), lambda x: x["e"])).drop("_all")
    return out.withColumn("match_classes", F.array_sort(F.array_distinct(F.transform("name_match_evidence", lambda x: x["match_class"]))))


def name_values(names: DataFrame, variants: DataFrame) -> DataFrame:
    """(key, vals): usable names of each link (see source_names), sorted: source_name_values of link_name_metrics() without comparing any of them."""
    name = F.struct("first_name", "last_name", F.array_sort("first_set").alias("first_variants"))
    usable = F.when(T.usable_name(F.col("first_name"), F.col("last_name")), name)
    return with_first_set(names, variants).groupBy(*KEY).agg(F.array_sort(F.collect_set(usable)).alias("vals"))


def disagree(a: Column, b: Column) -> Column:
    """F17 for two structs of first_name, last_name and first_variants."""
    return T.names_disagree(T.first_kind(a["first_variants"], a["first_name"], b["first_variants"], b["first_name"]), T.last_kind(a["last_name"], b["last_name"]))


def any_alike(mine: Column, theirs: Column) -> Column:
    """Whether some pair of two lists of names agrees; null if a list is empty."""
    return F.when((F.size(mine) > 0) & (F.size(theirs) > 0), F.exists(mine, lambda a: F.exists(theirs, lambda b: ~disagree(a, b))))


def name_history(linked: DataFrame) -> DataFrame:
    """Distinct usable names of the e-mail (by source), and whether two names of the link disagree; null without a usable name.

    `linked` has source_name_values. Names are exploded and met by key, pair by pair within a link, never per e-mail.
    """
    names = linked.select(*KEY, F.explode("source_name_values").alias("n")).distinct()
    per_email = names.groupBy("source", "email").agg(F.countDistinct(F.struct("n.first_name", "n.last_name")).alias("email_name_count"))
    own = names.groupBy(*KEY).agg(F.collect_set("n").alias("own"))
    conflict = own.select(*KEY, F.exists("own", lambda a: F.exists("own", lambda b: disagree(a, b))).alias("email_npi_has_name_conflict"))
    return linked.select(*KEY).join(per_email, ["source", "email"], "left").join(conflict, KEY, "left").withColumn("email_name_count", F.coalesce("email_name_count", F.lit(0)))


def debug_rows(linked: DataFrame, compared: DataFrame) -> DataFrame:
    """Every comparison of a link with a key of its own: the hash of its JSON text."""
    columns = ["first_name", "last_name", "registry_first_name", "registry_last_name", "first_kind", "last_kind", "match_class", "source_match", "registry_match", "vendor_match"]
    text = F.to_json(F.struct("source", "link_id", "first_name", "last_name", "registry_first_name", "registry_last_name"), {"ignoreNullFields": "false"})
    return linked.select(*KEY, "link_id").join(compared, KEY, "left").withColumn("debug_id", F.upper(F.sha2(text, 256))).select(*KEY, "link_id", *columns, "debug_id")
