"""Histories of e-mails and names, case by case."""

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import links as L
from tessel.operators import names as A
from tessel.operators import records as R
from tessel.operators import references as X
from tessel.sources import catalog as K

D = "2026-01-0"
#: npis by day; whether the e-mail was reassigned; the links in conflict (one answer for all, or by npi).
CASES = {
    "stable": ([("1", 1), ("1", 2)], False, False), "changed": ([("1", 1), ("2", 2)], True, False), "conflict": ([("1", 1), ("2", 1)], False, True), "returns": ([("1", 1), ("2", 2), ("1", 3)], True, False),
    "conflict, then change": ([("1", 1), ("2", 1), ("3", 2)], True, {"1": True, "2": True, "3": False}), "undated": ([("1", None)], False, False), "two undated": ([("1", None), ("2", None)], None, None),
    "partly dated": ([("1", 1), ("2", None)], None, {"1": False, "2": None}), "conflict and undated": ([("1", 1), ("2", 1), ("3", None)], None, {"1": True, "2": True, "3": None}),
    "undated copy": ([("1", 1), ("1", None), ("2", 2)], True, {"1": None, "2": False}), "replaced by two": ([("1", 1), ("2", 2), ("3", 2)], True, {"1": False, "2": True, "3": True}),
    "stable conflict": ([("1", 1), ("2", 1), ("1", 2), ("2", 2)], False, True), "joined": ([("1", 1), ("1", 2), ("2", 2)], True, True), "left": ([("1", 1), ("2", 1), ("1", 2)], True, True),
}


def observed(spark, rows):
    frame = spark.createDataFrame([(s, e, n, f"{D}{d}" if d else None) for s, e, n, d in rows], "source string, email string, npi string, day string")
    return frame.withColumn("day", F.col("day").cast("date"))


def test_reassignment_and_conflict(spark):
    linked = L.links(observed(spark, [("s", case, n, d) for case, (rows, _, _) in CASES.items() for n, d in rows]))
    got = L.link_conflicts(linked, L.email_linkage(linked)).collect()
    for r in got:
        _, reassigned, conflict = CASES[r.email]
        assert (r.has_been_reassigned, r.has_conflict_linkage) == (reassigned, conflict[r.npi] if isinstance(conflict, dict) else conflict), (r.email, r.npi)
    undated = L.email_linkage(linked, ["s"])
    assert {r.email: r.has_been_reassigned for r in undated.collect()} == {c: False if len({n for n, _ in rows}) == 1 else None for c, (rows, _, _) in CASES.items()}
    assert all(r.has_conflict_linkage == (r.email_npi_count > 1) for r in L.link_conflicts(linked, undated, ["s"]).collect())


def sequence(spark, rows, day, versioned=()):
    return sorted(L.sequence_history(L.links(observed(spark, rows)), day, list(versioned)).collect(), key=lambda r: (r.email, r.day))


def test_sequence_of_swaps_and_returns(spark):
    rows = [("s", "e", "1", 1), ("s", "e", "1", 3), ("s", "e", "2", 2), ("s", "e", "2", 3), ("s", "e", "3", 2)]
    whole = sequence(spark, rows, f"{D}9")
    assert [(r.versions, r.npis_seen, r.changes, r.swaps, r.flipbacks) for r in whole] == [(1, 1, 0, 0, 0), (2, 3, 1, 1, 0), (3, 3, 2, 2, 1)] and whole[2].returned == ["1"] and whole[2].removed == ["3"]
    assert sequence(spark, rows, f"{D}2") == whole[:2]  # what comes later changes nothing
    both = sequence(spark, [("s", "e", "1", 1), ("s", "e", "1", 2), ("s", "e", "1", 4), ("s", "e", "2", 2), ("s", "e", "2", 3), ("s", "e", "2", 4)], f"{D}9")
    assert (both[-1].changes, both[-1].swaps, both[-1].flipbacks) == (3, 0, 0)


def test_sequence_of_content_versions(spark):
    rows = [("s", "e", "A", d) for d in (1, 2, 5)] + [("s", "e", "B", 4)] + [("s", "o", "Z", d) for d in (1, 2, 3, 4, 5)]
    got = [r for r in sequence(spark, rows, f"{D}9", ["s"]) if r.email == "e"]
    assert [r.versions for r in got] == [1, 1, 2, 3] and (got[-1].swaps, got[-1].flipbacks) == (2, 1) and str(got[2].prev_day) == f"{D}2"


def test_registrations(spark):
    rows = [("s", "e", "A", "g", 1), ("s", "e", "B", "g", 2), ("s", "e", "B", "g", 3), ("s", "e", "A", "h", 3), ("s", "e", "C", None, 1), ("s", "f", "A", "g", 1), ("s", "f", "B", "g", 1), ("s", "u", "A", "g", None)]
    days = spark.createDataFrame([(s, e, n, g, f"{D}{d}" if d else None) for s, e, n, g, d in rows], "source string, email string, npi string, guid string, day string").withColumn("day", F.col("day").cast("date"))
    got = {(r.email, r.npi): r for r in X.registration_status(days, days.where("day IS NULL"), f"{D}9").collect()}
    assert {k: r.registration_link_status for k, r in got.items()} == {("e", "A"): "latest_observed", ("e", "B"): "latest_observed", ("e", "C"): "unknown", ("f", "A"): "ambiguous_latest", ("f", "B"): "ambiguous_latest", ("u", "A"): "unknown"}
    early = {(r.email, r.npi): r for r in X.registration_status(days.where("guid = 'g'"), days.limit(0), f"{D}9").collect()}
    gone = early["e", "A"]
    assert (gone.registration_link_status, str(gone.registration_superseded_since_day), gone.registration_superseded_by_npis) == ("superseded", f"{D}2", ["B"])


@pytest.mark.parametrize(
    "local, first, last, strict, fuzzy",
    [
        ("jonsmith", "JON", "SMITH", True, True), ("jsmith", "JON", "SMITH", True, True), ("jqsmith", "JON", "SMITH", True, True), ("smithj", "JON", "SMITH", True, True), ("smith", "JON", "SMITH", False, False),
        ("jonsmyth", "JON", "SMITH", False, True), ("jsmth", "JON", "SMITH", False, False), ("ann", "JON", "SMITH", False, False), ("jsmith", None, "SMITH", None, None), ("jsmith", "JON", "S", None, None), ("xjyz", "J", "YZ", False, False), ("", "JON", "SMITH", False, False),
    ],
)
def test_names_in_emails(spark, local, first, last, strict, fuzzy):
    row = spark.createDataFrame([(local, first, last)], "l string, f string, s string").select(
        T.name_in_email(F.col("l"), F.lower("f"), F.lower("s")).alias("strict"), T.name_in_email_fuzzy(F.col("l"), F.filter(F.array("f"), lambda x: x.isNotNull()), F.col("s")).alias("fuzzy")).first()
    assert (row.strict, row.fuzzy) == (strict, fuzzy)


def test_kinds_of_names(spark):
    rows = [("SMITH - JONES", "BROWN - LEE", "none"), ("SMITH-JONES", "JONES", "token"), ("O'NEIL", "ONEIL", "exact"), ("KOWALCZYK", "KOVALCZIK", "edit"), ("LEE", "LEA", "none")]
    got = spark.createDataFrame(rows, "a string, b string, want string").select(T.last_kind(F.col("a"), F.col("b")).alias("k"), "want").collect()
    assert all(r.k == r.want for r in got)
    firsts = [("JON PAUL", "JONATHAN", [], "token"), ("BOB", "ROBERT", ["ROBERT"], "nickname"), ("ANN MARIE", "MARIE", [], "token"), ("STEPHEN", "STEPHAN", [], "edit"), ("JO", "JON", [], "none")]
    got = spark.createDataFrame(firsts, "a string, b string, v array<string>, want string").select(T.first_kind(F.concat(F.array("a"), "v"), F.col("a"), F.array("b"), F.col("b")).alias("k"), "want").collect()
    assert all(r.k == r.want for r in got)
    names = spark.createDataFrame([(" Šimková ", "SIMKOVA"), ("null", None), ("Zoë \tAnn", "ZOE ANN"), ("\\N", None), ("123", None)], "n string, want string").select(T.norm_name(F.col("n")).alias("k"), "want").collect()
    assert all(r.k == r.want for r in names)


def test_small_functions(spark):
    row = spark.createDataFrame([(1,)], "x int").select(
        T.state_code(F.lit("u.s.  virgin islands")).alias("vi"), T.states_of_payload(F.lit('{"state": "ny", "country": "Canada"}'), "state", ("country",)).alias("abroad"),
        T.states_of_payload(F.lit('{"region": " new york ", "country": "usa"}'), "region", ("country_code", "country")).alias("home"), T.vendor_label(F.lit(" n/a ")).alias("none"), T.vendor_labels(F.array(F.lit("b  c"), F.lit("B C"), F.lit(None).cast("string"))).alias("labels"),
        T.id_hash(F.lit("")).alias("empty"), T.zip3(F.lit(" 7")).alias("zip"), T.zip3(F.lit("1234")).alias("no_zip"), T.id_suffix(F.lit("S1_1234567893")).alias("suffix"), T.source_prefix(F.lit("S1_1234567893")).alias("prefix"), T.junk_name(F.lit("Test user")).alias("junk"),
        T.parse_day(F.lit("2020-1-1")).alias("bad_day"), T.parse_day(F.lit("2020-02-29")).alias("day"), T.crc_bucket(F.lit(None).cast("string"), 8).alias("bucket"), T.delimited(F.lit("a| |b ")).alias("parts"), T.clean_email(F.lit(" A@B.c ")).alias("email"),
        T.identity_payload("x").alias("payload"), T.uid_valid(F.lit("0101_-!*01_")).alias("blank"), T.shown_count(F.lit(1_250_000)).alias("shown"), T.match_class(F.lit("token"), F.lit("edit")).alias("cls")).first()
    assert (row.vi, row.abroad, row.home, row.none, row.labels) == ("VI", [], ["NY"], None, ["B C"]) and (row.empty, row.zip, row.no_zip) == (-(1 << 63), "007", None)
    assert (row.suffix, row.prefix, row.junk, row.bad_day, str(row.day), row.bucket) == ("1234567893", "S1", True, None, "2020-02-29", 0) and (row.parts, row.email, row.payload) == (["a", "b"], "a@b.c", '{"x":1}')
    assert (row.blank, row.shown, row.cls) == (False, "1.3M", "edit")


def test_records_keep_every_row_and_name_their_latest_version(spark):
    raw = spark.createDataFrame([("S", "a@x.test", "1", f"{D}1", "JON", "x"), ("S", "a@x.test", "1", f"{D}2", "JON", "y"), ("S", "a@x.test", "1", f"{D}2", "BOB", None), ("S", "a@x.test", None, "soon", "JON", "x")], "source string, email string, npi string, day string, first_name string, note string")
    staged = R.stage(raw)
    spec = R.SourceSpec("S", ("source", "email", "npi", "first_name"), volatile=("note",))
    out = spark.createDataFrame([("1",), (None,)], "npi_clean string")
    v = {r.first_name + str(r.npi): r for r in R.record_versions(staged, spec).collect()}
    assert len(v) == 3 and v["JON1"].note_values == ["x", "y"] and v["JON1"].observation_count == 2 and v["JONNone"].invalid_day_observation_count == 1 and len({r.record_id for r in v.values()}) == 3
    assert [r.npi for r in R.record_versions(staged, spec, out).collect()] == [None]  # records without an npi stay
    assert K.day_as_text(staged.select(F.col("vendor_day").alias("day"))).dtypes == [("day", "string")]
    versions = R.record_versions(staged.where("npi IS NOT NULL"), spec).withColumn("emails", F.concat("email", F.lit("|"), F.lit("b@x.test"))).drop("email").withColumns(
        {"source_tables": F.array(F.lit("t")), "last_name": F.lit("SMITH"), "state_values": F.array(F.lit("NY")), "guid": F.lit("g"), "specialty_values": F.array().cast("array<string>")})
    got = {r.email: r for r in R.link_records(R.emails_of_list(versions, "emails")).collect()}
    assert set(got) == {"a@x.test", "b@x.test"} and got["b@x.test"].email_origins == ["email_token_2"] and got["a@x.test"].latest_record_id is None  # two versions share the last day
    assert got["a@x.test"].record_count == 2 and len(got["a@x.test"].attribute_versions) == 2 and got["a@x.test"].source_state_values_latest == []


def test_nicknames_are_one_hop_both_ways(spark):
    v = {r.first_name: r.variants for r in A.nickname_variants(spark.createDataFrame([("LIZ", "ELIZABETH|BETH"), ("BETTY", "ELIZABETH")], "nickname string, canonical string")).collect()}
    assert v == {"LIZ": ["BETH", "ELIZABETH"], "BETTY": ["ELIZABETH"], "ELIZABETH": ["BETTY", "LIZ"], "BETH": ["LIZ"]}
