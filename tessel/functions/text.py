"""Scalar functions on text, dates, identifiers and states: Column in, Column out. Unknown is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that stand for no name; upper-case letters with accents and their plain forms.
NO_NAME = ["", "null", "nan", "\\n"]
ACCENTED = "ÁÀÂÄÃÅĀÇĆČÉÈÊËĒĖĘÍÌÎÏĪÑŃÓÒÔÖÕØŌŚŠÚÙÛÜŪÝŸŽŹŻ"
PLAIN = "AAAAAAACCCEEEEEEEIIIIINNOOOOOOOSSUUUUUYYZZZ"
# Local parts of role accounts.
ROLE_ACCOUNTS = ["admin", "info", "office", "contact", "frontdesk", "billing", "reception", "appointments", "scheduling", "support", "noreply"]
# Domain texts of institutions and of free mail providers.
INSTITUTION = r"(\.(edu|gov|mil)$)|(\.(edu|ac)\.[a-z]{2}$)|(hospital|health|clinic|medical|medicine|physician|pharm|dental|surgery|univ|ortho|cardio|derm|urgent|rehab|oncolog|pediatric)"
FREE = r"^(gmail|googlemail|yahoo|ymail|hotmail|outlook|live|msn|aol|icloud|me|mac|comcast|verizon|att|sbcglobal|bellsouth|cox|charter|earthlink|protonmail|proton|mail|gmx|optonline|juno|netzero|roadrunner|frontier|windstream|centurylink|aim|rocketmail)\."
EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}$"


def clean_text(v: Column) -> Column:
    """Trimmed text, null if empty."""
    return F.nullif(F.trim(v.cast("string")), F.lit(""))


def clean_email(v: Column) -> Column:
    """P02"""
    return F.lower(clean_text(v))


def parse_day(v: Column) -> Column:
    """A date only from YYYY-MM-DD; Spark's cast alone would take partial dates."""
    text = v.cast("string")
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))


def no_text(v: Column) -> Column:
    """F01"""
    return F.when(~F.lower(F.trim(v)).isin(NO_NAME), v)


def squash_space(v: Column) -> Column:
    """tabs, line ends and no-break spaces count as blanks; runs become one."""
    return F.trim(F.regexp_replace(F.translate(v, "\t\n\r ", "    "), " +", " "))


def strip_accents(v: Column) -> Column:
    """F03"""
    return F.translate(v, ACCENTED, PLAIN)


def norm_name(v: Column) -> Column:
    """F04"""
    kept = F.regexp_replace(strip_accents(F.upper(squash_space(no_text(v)))), r"[^A-Z' \-]", "")
    return F.nullif(squash_space(kept), F.lit(""))


def full_name_first(v: Column) -> Column:
    """first token of a name of two tokens or more."""
    parts = F.split(squash_space(v), " ")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0)))


def full_name_last(v: Column) -> Column:
    parts = F.split(squash_space(v), " ")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-1)))


def letters(v: Column) -> Column:
    """F07"""
    return F.regexp_replace(v, "[^A-Z]", "")


def edit_close(a: Column, b: Column) -> Column:
    """F08"""
    short, d = F.least(F.length(a), F.length(b)), F.levenshtein(a, b)
    return ((short >= 5) & (d <= 1)) | ((short >= 8) & (d <= 2))


def prefix_close(a: Column, b: Column) -> Column:
    """F09"""
    return (F.least(F.length(a), F.length(b)) >= 3) & (a.startswith(b) | b.startswith(a))


def last_kind(a: Column, b: Column) -> Column:
    """exact, token, edit or none. Blanks and hyphens, alone or together, separate tokens."""
    x, y = letters(a), letters(b)
    parts = lambda v: F.split(F.regexp_replace(v, "[- ]+", " "), " ")
    return F.when(x == y, "exact").when(F.arrays_overlap(parts(a), parts(b)), "token").when(edit_close(x, y), "edit").otherwise("none")


def first_token(v: Column) -> Column:
    return F.split_part(v, F.lit(" "), F.lit(1))


def first_kind(set_a: Column, a: Column, set_b: Column, b: Column) -> Column:
    """exact, token, nickname, edit or none: whole names, then their tokens, sets of a name and its nicknames, first tokens."""
    x, y = first_token(a), first_token(b)
    return (
        F.when(a == b, "exact").when((x == y) | F.arrays_overlap(F.split(a, " "), F.split(b, " ")) | prefix_close(x, y), "token")
        .when(F.arrays_overlap(set_a, set_b), "nickname").when(edit_close(letters(x), letters(y)), "edit").otherwise("none")
    )


def match_class(first: Column, last: Column) -> Column:
    """the weaker of two kinds; married if only the last names differ."""
    return (
        F.when(first.isNull() | last.isNull(), F.lit(None)).when((last == "none") & (first != "none"), "married").when((last == "none") | (first == "none"), "none")
        .when((last == "edit") | (first == "edit"), "edit").when(first == "nickname", "nickname").when((last == "token") | (first == "token"), "token").otherwise("exact")
    )


def registry_class(source_usable: Column, registry_usable: Column, first: Column, last: Column) -> Column:
    """a source's name against a registry's: unknown if either is unusable; first_only or last_only if just one of the names is alike."""
    alike = lambda c: c != "none"
    return F.when(~source_usable | ~registry_usable, "unknown").when((last == "none") & alike(first), "first_only").when((first == "none") & alike(last), "last_only").otherwise(match_class(first, last))


def names_disagree(first: Column, last: Column) -> Column:
    """F17"""
    return (last == "none") | (first == "none")


def usable_name(first: Column, last: Column) -> Column:
    """F16"""
    return F.coalesce((F.length(letters(first)) >= 1) & (F.length(letters(last)) >= 2), F.lit(False))


def local_letters(email: Column) -> Column:
    """F18"""
    return F.regexp_replace(F.lower(F.regexp_extract(email, "^([^@]*)@", 1)), "[^a-z]", "")


def name_in_email(local: Column, first: Column, last: Column) -> Column:
    """whether the local part's letters hold both names (of two letters or more), or begin with the first name's initial and end with the
    surname, or begin with the surname and end with the initial. Null if there is no first name or the surname has less than two letters.
    The names are given in lower-case letters."""
    f, s, initial = F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")), F.substring(first, 1, 1)
    both = (F.length(f) >= 2) & (F.instr(local, f) > 0) & (F.instr(local, s) > 0)
    around = (F.length(local) > F.length(s)) & ((local.startswith(initial) & local.endswith(s)) | (local.startswith(s) & local.endswith(initial)))
    return F.when((f == "") | (F.length(s) < 2), F.lit(None)).otherwise(F.coalesce(both | around, F.lit(False)))


def name_in_email_fuzzy(local: Column, variants: Column, last: Column) -> Column:
    """F14 for any variant of the first name, or a local part of six letters or more within one edit of both names or of an initial and
    the surname, either way round. Null without a usable name."""
    s = F.lower(letters(F.coalesce(last, F.lit(""))))
    low = lambda v: F.lower(letters(v))
    near = lambda x: F.levenshtein(local, x) <= 1
    close = lambda f: near(F.concat(f, s)) | near(F.concat(s, f))
    usable = (F.size(variants) > 0) & (F.length(s) >= 2) & F.coalesce(F.exists(variants, lambda v: F.length(letters(v)) >= 1), F.lit(False))
    strict = F.coalesce(F.exists(variants, lambda v: name_in_email(local, low(v), s)), F.lit(False))
    fuzzy = (F.length(local) >= 6) & F.coalesce(F.exists(variants, lambda v: close(low(v)) | close(F.substring(low(v), 1, 1))), F.lit(False))
    return F.when(usable, strict | fuzzy)


def email_format_valid(e: Column) -> Column:
    """F19"""
    return e.rlike(EMAIL)


def email_role_account(e: Column) -> Column:
    """F20"""
    return F.coalesce(F.regexp_extract(e, "^([^@]+)@", 1).isin(ROLE_ACCOUNTS), F.lit(False))


def email_domain_class(e: Column) -> Column:
    """F21"""
    domain = F.lower(F.regexp_extract(e, "@(.*)$", 1))
    return F.when(e.isNull() | (F.instr(e, "@") == 0), "unknown").when(domain.rlike(INSTITUTION), "institutional").when(domain.rlike(FREE), "free").otherwise("custom")


def email_domain(e: Column) -> Column:
    """F22"""
    return F.nullif(F.lower(F.regexp_extract(e, "@(.*)$", 1)), F.lit(""))


def npi_checksum_valid(v: Column) -> Column:
    """Luhn sum over ten digits with the constant 24; null for other texts."""
    digits = [F.substring(v, k + 1, 1).cast("int") for k in range(10)]
    total = F.lit(24)
    for k, d in enumerate(digits):
        total = total + (F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if k % 2 == 0 else d)
    return F.when(v.rlike("^[0-9]{10}$") & (F.length(v) == 10), total % 10 == 0)


def npi_structure_reason(v: Column) -> Column:
    """Missing, malformed, unsupported_prefix, checksum_failure or valid."""
    return (
        F.when(clean_text(v).isNull(), "missing").when(~(v.rlike("^[0-9]{10}$") & (F.length(v) == 10)), "malformed")
        .when(~v.rlike("^[1-4]"), "unsupported_prefix").when(~npi_checksum_valid(v), "checksum_failure").otherwise("valid")
    )


def joined_hash(*parts: Column) -> Column:
    """upper hex SHA-256 of the parts with NUL between; null if a part is."""
    out = []
    for p in parts:
        out += [F.lit("\0"), p]
    return F.upper(F.sha2(F.concat(*out[1:]), 256))


def email_hash(e: Column) -> Column:
    """F29"""
    return F.sha2(F.lower(F.trim(e)), 256)


def crc_bucket(v: Column, n: int) -> Column:
    """F30"""
    return F.pmod(F.crc32(F.coalesce(v, F.lit("")).cast("binary")), F.lit(n))


def sha_bucket(v: Column) -> Column:
    """one of 16."""
    return F.substring(F.sha2(v, 256), 1, 1)


def sample_bucket(v: Column, digits: int = 6) -> Column:
    """F32: a number below 16**digits, the same for a value in every run; a sample is what lies below a bound, so samples nest."""
    return F.conv(F.substring(F.sha2(v.cast("string"), 256), 1, digits), 16, 10).cast("long")


def window_days(day: Column, back: int) -> Column:
    """the days from `back` days before to the day itself."""
    return F.sequence(F.date_sub(day, back), day, F.expr("interval 1 day"))


# Texts that stand for no label.
NO_LABEL = [
    "", "NULL", "NONE", "UNKNOWN", "N/A", "NA", "\\N", "-", "OTHER", "UNSPECIFIED", "NOT SPECIFIED", "NOT AVAILABLE", "OTHER SPECIALTY", "PROFESSION",
    "SPECIALTY", "PRIMARY_SPECIALTY", "SECONDARY_SPECIALTY", "TERTIARY_SPECIALTY",
]
# States, the federal district and territories.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME",
    "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR",
    "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA",
    "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "AMERICAN SAMOA": "AS", "GUAM": "GU", "NORTHERN MARIANA ISLANDS": "MP", "PUERTO RICO": "PR",
    "US VIRGIN ISLANDS": "VI", "U.S. VIRGIN ISLANDS": "VI", "VIRGIN ISLANDS": "VI",
}
# Countries whose states are read.
HOME = [
    "US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA", "PR", "PUERTO RICO", "GU", "GUAM", "AS", "AMERICAN SAMOA", "MP", "NORTHERN MARIANA ISLANDS", "VI", "US VIRGIN ISLANDS",
    "U.S. VIRGIN ISLANDS", "VIRGIN ISLANDS",
]


def plain_upper(v: Column) -> Column:
    """White space collapsed, upper case."""
    return F.upper(F.regexp_replace(F.trim(v.cast("string")), r"\s+", " "))


def vendor_label(v: Column) -> Column:
    """a label, or null for one of the texts that stand for none."""
    text = plain_upper(v)
    return F.when(~text.isin(NO_LABEL), text)


def vendor_labels(values: Column) -> Column:
    """sorted distinct labels of an array."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, vendor_label), lambda x: x.isNotNull())))


def state_code(v: Column) -> Column:
    """a jurisdiction's code from its code or full name."""
    codes = {c: c for c in STATES.values()} | STATES
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), plain_upper(v))


def states_of_payload(payload: Column, field: str = "state", countries: tuple[str, ...] = ()) -> Column:
    """the state that a JSON payload names, as an array of one or none; none where one of the country fields names another country."""
    value = lambda name: F.get_json_object(payload, f"$.{name}")
    state = F.filter(F.array(state_code(value(field))), lambda x: x.isNotNull())
    at_home = F.lit(True)
    for name in countries:
        country = F.upper(F.trim(value(name)))
        at_home = at_home & F.coalesce((country == "") | country.isin(HOME), F.lit(True))
    return F.when(at_home, state).otherwise(F.array().cast("array<string>"))


def id_hash(v: Column) -> Column:
    """64-bit id of a text, by XXH64; the empty text has the least number, and whatever hashes to that has the greatest."""
    least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    h = F.xxhash64(v)
    return F.when(v == "", least).when(h == least, most).otherwise(h)


def identity_payload(*columns: str) -> Column:
    """JSON text of a record's identity fields; dates, times and decimals as text, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def zip3(v: Column) -> Column:
    """a ZIP prefix of three digits from one to three; null for other texts."""
    text = F.trim(v)
    return F.when(text.rlike(r"\A[0-9]{1,3}\z"), F.lpad(text, 3, "0"))


def id_suffix(v: Column) -> Column:
    """the ten digits that a text ends with."""
    return F.nullif(F.regexp_extract(v, r"([0-9]{10})\z", 1), F.lit(""))


def source_prefix(v: Column) -> Column:
    """what stands before the first underscore."""
    return F.nullif(F.regexp_extract(v, "^([^_]+)_", 1), F.lit(""))


def junk_name(v: Column) -> Column:
    """names that are placeholders or test entries."""
    text = F.lower(F.trim(v))
    return F.coalesce(text.isin(NO_NAME) | text.like("test%") | text.like("%unknown%"), F.lit(True))


def delimited(v: Column, mark: str = "|") -> Column:
    """cleaned parts of a delimited list, empty ones left out."""
    return F.filter(F.transform(F.split(v, "\\" + mark), lambda x: F.nullif(F.trim(x), F.lit(""))), lambda x: x.isNotNull())


def uid_valid(v: Column) -> Column:
    """P05"""
    return v.rlike(r"^[A-Za-z0-9_!*-]{11,512}$") & ~v.rlike(r"^[-01_!*]*$")


def shown_count(n: Column) -> Column:
    """a count for display: thousands and millions with one decimal."""
    return F.when(n >= 1_000_000, F.concat(F.round(n / 1e6, 1).cast("string"), F.lit("M"))).when(n >= 1_000, F.concat(F.round(n / 1e3, 1).cast("string"), F.lit("K"))).otherwise(n.cast("string"))
