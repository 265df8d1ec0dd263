"""Logical inputs over the driver's tables, which are read whole; claims and registry names know a share of the customers only. One text for each input, in SQL that Spark and DuckDB both read; {json} is the one
difference. Keys grow with the tables: users meet within blocks of 25, groups hold about 15 customers, an e-mail has up to six npis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JSON = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}


def pick(expr: str, values: list[str | None]) -> str:
    """SQL: one of the values by a number from 0."""
    texts = ["NULL" if v is None else f"'{v}'" for v in values]
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END"


def whole(expr: str) -> str:
    return f"cast(floor({expr}) AS bigint)"


#: Invented names; several are nicknames, have accents, hyphens or blanks, or stand for no name.
FIRST = ["JON", "Jonathan", "Ann", "ANNA MARIA", "Robert", "Bob", " liz ", "Elizabeth", "Zoë", "null", None, "José"]
LAST = ["Smith", "SMITH-JONES", "Jones", "Šimková", "ONeil", "Van Dyke", "Brown - Lee", "smyth", "nan", "Kowalczyk"]
LOCAL = ["jon.smith", "jsmith", "smithj", "annajones", "rsimkova", "elizabeth", "info", "bobbrown", "zoe_kowalczyk", "jose.oneil"]
NICKNAMES = [("JON", "JONATHAN"), ("BOB", "ROBERT"), ("LIZ", "ELIZABETH"), ("ANN", "ANNA"), ("ANN", "HANNAH")]
STATES = ["NY", "new york", "CA", "Texas", "tx", "Guam", "Narnia", None]
LABELS = ["Cardiology", " cardiology ", "Oncology", "UNKNOWN", "Family  Medicine", None, "n/a"]
USER = f"CASE user_id % 50 WHEN 49 THEN 'A_' || cast(user_id AS string) WHEN 48 THEN '0' || bin(user_id) ELSE 'u' || cast(user_id AS string) END"
EMAIL = f"""{pick('user_id % 10', LOCAL)} || cast(user_id AS string) || '@' || CASE user_id % 5 WHEN 0 THEN 'gmail.example' WHEN 1 THEN 'clinic.example'
        WHEN 2 THEN 'state.edu' WHEN 3 THEN 'gmail.com' ELSE 'own' || cast({whole('user_id / 20.0')} AS string) || '.example' END"""
#: An e-mail names one npi, or one of two or six of its block of ten users.
NPI = f"'1' || lpad(cast({whole('user_id / 10.0')} * 6 + CASE user_id % 3 WHEN 0 THEN user_id % 6 WHEN 1 THEN k % 2 ELSE k % 6 END AS string), 9, '0')"
EVENTS = "(SELECT *, cast({json} AS int) AS k FROM events)"

INPUTS = {
    "activity": ("events", f"""SELECT {USER} AS uid, cast({whole('user_id / 25.0')} AS string) || '-' || cast(CASE WHEN k < 10 THEN 0 ELSE k END AS string) AS key,
        cast(ts AS date) AS day, hour(ts) AS hour FROM {EVENTS}"""),
    "claims_a": ("customer", f"""SELECT 'u' || cast(c_custkey AS string) AS uid, 200000000 + {whole('c_custkey / 15.0')} AS group_id,
        CASE {whole('c_custkey / 15.0')} % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE {whole('c_custkey / 45.0')} + 1 END AS household_id, {whole('c_custkey / 15.0')} % 2 = 0 AS stable, 'A' AS reason
        FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')
        UNION ALL SELECT DISTINCT 'A_' || cast(200000000 + {whole('c_custkey / 15.0')} AS string), 200000000 + {whole('c_custkey / 15.0')}, cast(0 AS bigint), true, 'A'
        FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')"""),
    "claims_b": ("customer", f"""SELECT 'u' || cast(c_custkey AS string) AS uid, 100000000 + {whole('(c_custkey + 4) / 15.0')} AS group_id, cast(0 AS bigint) AS household_id,
        true AS stable, 'B' AS reason FROM customer WHERE c_nationkey < 9
        UNION ALL SELECT 'u' || cast(c_custkey AS string), 100000000 + {whole('c_custkey / 105.0')} * 7 + c_custkey % 7, cast(0 AS bigint), true, 'B' FROM customer WHERE c_acctbal < 0"""),
    "claims_c": ("customer", f"""SELECT 'u' || cast(c_custkey AS string) AS uid, CASE WHEN c_nationkey = 24 THEN 0 ELSE 300000000 + {whole('(c_custkey + 8) / 18.0')} END AS group_id,
        cast(0 AS bigint) AS household_id, false AS stable, 'C' AS reason FROM customer WHERE c_acctbal > 7000"""),
    "geo": ("customer", "SELECT 'u' || cast(c_custkey AS string) AS uid, 'G' || cast(c_nationkey % 5 AS string) AS geo FROM customer"),
    "observations": ("events", f"""SELECT event_type AS source, {EMAIL} AS email, {NPI} AS npi, CASE WHEN event_id % 50 = 0 THEN NULL ELSE cast(ts AS date) END AS day,
        {pick('(user_id + CASE WHEN k < 30 THEN k % 3 ELSE 0 END) % 12', FIRST)} AS first_name, {pick('(user_id + CASE WHEN k < 15 THEN 1 ELSE 0 END) % 10', LAST)} AS last_name,
        {pick('(user_id + k) % 8', STATES)} AS state, {pick('k % 7', LABELS)} AS specialty, {pick('(user_id + k) % 7', LABELS)} AS profession,
        CASE WHEN k % 11 = 0 THEN NULL ELSE 'r' || cast({whole('user_id / 2.0')} AS string) END AS guid, event_id FROM {EVENTS}"""),
    "npi_states": ("customer", f"SELECT '1' || lpad(cast({whole('c_custkey / 10.0')} * 6 + c_custkey % 6 AS string), 9, '0') AS npi, 'S' || cast(c_nationkey AS string) AS state FROM customer"),
    "registry_names": ("customer", f"""SELECT '1' || lpad(cast({whole('c_custkey / 10.0')} * 6 + c_custkey % 6 AS string), 9, '0') AS npi, {pick('c_custkey % 12', FIRST)} AS first_name,
        {pick('(c_custkey + c_nationkey % 2) % 10', LAST)} AS last_name FROM customer WHERE c_nationkey <> 3"""),
    "names": ("part", f"""SELECT p_partkey AS id, p_name AS name, {pick('p_partkey % 12', FIRST)} AS first_name, {pick('(p_partkey + p_size) % 10', LAST)} AS last_name,
        {pick('p_size % 12', FIRST)} AS other_first, {pick('(p_size + p_partkey % 3) % 10', LAST)} AS other_last, {pick('(p_partkey + p_size % 4) % 10', LOCAL)} || cast(p_partkey AS string) || '@x.example' AS email FROM part"""),
    "registry": ("orders", """SELECT lpad(cast(1000000000 + o_orderkey AS string), 10, '1') AS npi, CASE WHEN o_orderkey % 3 = 0 THEN cast(cast(o_orderdate AS date) AS string) WHEN o_orderkey % 41 = 0 THEN 'soon' END AS deactivated,
        CASE WHEN o_orderkey % 6 = 0 THEN '1996-01-01' END AS reactivated, CASE WHEN o_orderkey % 7 = 0 THEN '1234567893' WHEN o_orderkey % 31 = 0 THEN 'x' WHEN o_orderkey % 37 = 0 THEN '0000000000' END AS replacement,
        CASE WHEN o_orderkey % 13 = 0 THEN 'D' END AS reason, CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN '2' WHEN 'P' THEN ' ' END AS entity FROM orders
        UNION ALL SELECT lpad(cast(1000000000 + o_orderkey AS string), 10, '1'), '1995-05-05', NULL, NULL, NULL, '3' FROM orders WHERE o_totalprice < 5000"""),
    "facilities": ("customer", f"""SELECT '1' || lpad(cast({whole('c_custkey / 10.0')} * 6 + c_custkey % 6 AS string), 9, '0') AS npi, c_nationkey % 3 + 1 AS rank,
        CASE c_nationkey % 4 WHEN 0 THEN '0000000000' WHEN 1 THEN 'bad' ELSE '2' || lpad(cast({whole('c_custkey / 40.0')} AS string), 9, '0') END || '|3' || lpad(cast(c_nationkey AS string), 9, '0') AS facility_npis,
        CASE WHEN c_acctbal > 0 THEN {whole('c_acctbal / 50')} END AS claims, CASE c_nationkey % 5 WHEN 0 THEN 'Claims, Web' WHEN 1 THEN ' Web' WHEN 2 THEN '' ELSE 'Claims' END AS sources,
        {pick('c_nationkey % 8', STATES)} AS state, CASE WHEN c_nationkey = 7 THEN ' ' ELSE 'loc' || cast(c_nationkey AS string) END AS location FROM customer"""),
    "nicknames": ("part", f"""SELECT upper(split_part(p_name, ' ', 2)) || cast({whole('p_partkey / 10.0')} AS string) AS nickname,
        upper(split_part(p_name, ' ', 1)) || '|' || p_type || cast(p_size % 5 AS string) AS canonical FROM part"""),
    "taxonomy": ("part", "SELECT DISTINCT upper(replace(p_brand, '#', '')) || '00X' AS code FROM part WHERE length(p_brand) = 8"),
    "provider_codes": ("customer", f"""SELECT '1' || lpad(cast({whole('c_custkey / 10.0')} * 6 + c_custkey % 6 AS string), 9, '0') AS npi, 'Brand' || cast(10 + c_nationkey AS string) || '00x' AS code_1,
        CASE WHEN c_acctbal < 0 THEN 'BRAND' || cast(11 + c_custkey % 9 AS string) || '00X' END AS code_2, 'none' AS code_3 FROM customer"""),
}


def text(name: str, dialect: str = "duckdb") -> str:
    return INPUTS[name][1].format(json=JSON[dialect])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, query = INPUTS[name][0], text(name, "spark")
    return spark.sql(query.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_inputs(*names: str) -> str:
    """The beginning of an oracle: WITH ... of these inputs."""
    return "WITH " + ",\n".join(f"{n} AS ({text(n)})" for n in names)
