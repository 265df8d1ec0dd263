"""Lookups of one e-mail in a table laid out for them."""

import pytest
from pyspark.sql import functions as F

from tessel.operators.links import lookup
from tessel.sources.keyed import read_keyed, write_keyed

COLUMNS = ["source", "email", "npi", "link_id", "last_seen_day"]


@pytest.fixture(scope="module")
def published(spark):
    """20,000 links of 5,000 e-mails, one of which has a quarter of all, and some null."""
    n = F.col("id")
    email = F.when(n % 4 == 0, " Hot@x.example").when(n % 101 == 0, None).otherwise(F.concat(F.lit("P"), (n % 5000).cast("string"), F.lit("@x.example ")))
    return spark.range(20_000).select(
        F.concat(F.lit("s"), (n % 3).cast("string")).alias("source"), email.alias("email"), F.concat(F.lit("1"), n.cast("string")).alias("npi"),
        F.sha2(n.cast("string"), 256).alias("link_id"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 50).cast("int")).alias("last_seen_day"))


@pytest.fixture(scope="module")
def keyed(published, tmp_path_factory):
    return write_keyed(published, str(tmp_path_factory.mktemp("keyed") / "links"), group_bytes=64 << 10)


def scanned(frame):
    """(pushed filters, rows that the scan put out) of a frame without a shuffle."""
    frame.collect()
    scan = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metadata().get("PushedFilters").get(), scan.metrics().get("numOutputRows").get().value()


def test_same_rows_as_the_plain_table(published, keyed):
    for email in ("P7@x.example", "  p4999@X.example", "hot@x.example", "nobody@x.example", ""):
        assert lookup(keyed, email, COLUMNS).collect() == lookup(published, email, COLUMNS).collect()
    assert lookup(keyed, "HOT@x.example", COLUMNS).count() == 5000 and keyed.count() == 20_000


def test_a_lookup_reads_few_rows(keyed):
    hits = lambda email: keyed.where(F.col("email_key") == F.lower(F.trim(F.lit(email)))).select("npi")
    pushed, rows = scanned(hits(" P4999@x.example "))
    assert "EqualTo(email_key,p4999@x.example)" in pushed and 0 < rows <= 5000
    # a name between others that no row has: only the Bloom filter can tell
    _, rows = scanned(hits("p4999a@x.example"))
    assert rows == 0


def test_empty_table(spark, published, tmp_path):
    path = str(tmp_path / "none")
    write_keyed(published.limit(0), path)
    assert lookup(read_keyed(spark, path), "a@x.example", COLUMNS).collect() == []
