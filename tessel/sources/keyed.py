"""Published links laid out for lookups of one e-mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.links import KEY, LOOKUP_KEY, normalised_email

#: Bytes of a row group, the least that a lookup reads of a column.
GROUP_BYTES = 16 << 20


def write_keyed(published: DataFrame, path: str, rows_per_file: int = 2_000_000, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Links with their normalised e-mail as a column of its own, sorted by it over all files, and with a Bloom filter of it.

    Files hold ranges of e-mails, so that footers name the few that may hold one, and row groups within a file likewise. The range goes
    on by source and npi: an e-mail of very many links is spread over tasks. Null e-mails come first and are never looked up. An
    empty table gives an empty one."""
    keyed = published.withColumn(LOOKUP_KEY, normalised_email(F.col("email")))
    order = [LOOKUP_KEY, *[c for c in KEY if c != "email"]]
    out = keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", group_bytes)
    out.option(f"parquet.bloom.filter.enabled#{LOOKUP_KEY}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
    return read_keyed(published.sparkSession, path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
