"""Tables bucketed and sorted by a key: joins on the key without an exchange, lookups that read one bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import graph as G
from tessel.operators import lookups as K

#: Buckets of the published lookups.
LOOKUP_BUCKETS = 32
TARGET_BYTES = 256 << 20


def buckets_for(n_bytes: int, target: int = TARGET_BYTES) -> int:
    """Buckets of about `target` bytes, a power of two, so that tables of several sizes still join bucket by bucket (the finer one is read coarser)."""
    return 1 << (max(1, -(-n_bytes // target)) - 1).bit_length()


def write_bucketed(frame: DataFrame, table: str, by: list[str], buckets: int = LOOKUP_BUCKETS, path: str | None = None, rows_per_file: int = 5_000_000) -> DataFrame:
    """Store a frame as table `table` in `buckets` buckets by `by`, sorted by it within files; the stored frame.

    Rows are shuffled by the buckets' own hash once, so that a bucket is written by one task and not by all. A key of very many rows is one
    bucket's: bucket by keys that are near unique (uids, graph ids), and take `buckets_for` where the table grows. Null keys share a bucket. An
    existing table is refused; `path` keeps the files outside the warehouse."""
    out = frame.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("maxRecordsPerFile", rows_per_file)
    (out.option("path", path) if path else out).saveAsTable(table)
    return frame.sparkSession.table(table)


@dataclass(frozen=True)
class Lookups:
    """The stored lookups by graph id and by uid."""

    match: DataFrame
    household: DataFrame
    uid: DataFrame

    def members(self, graphid: str) -> DataFrame:
        """Uids of one graph id, in order; one bucket of one table is read."""
        table = self.household if graphid.startswith(K.HOUSEHOLD_PREFIX) else self.match
        return table.where(F.col("graphid") == graphid).select(F.explode("uids").alias("uid"))

    def graphids(self, uid: str) -> DataFrame:
        """Graph ids of one uid, in order; one bucket is read."""
        return self.uid.where(F.col("uid") == uid).select(F.explode("graphids").alias("graphid"))


def _names(prefix: str) -> dict[str, str]:
    return {"match": f"{prefix}_match", "household": f"{prefix}_household", "uid": f"{prefix}_uid"}


def store_lookups(published: DataFrame, prefix: str, path: str | None = None, longer_than: int = 10, buckets: int = LOOKUP_BUCKETS) -> Lookups:
    """The three lookups of published rows as bucketed tables `<prefix>_match`, `_household` and `_uid`. The rows are read three times:
    give a stored frame. Empty rows give empty tables."""
    made = {"match": (K.match_lookup(published), "graphid"), "household": (K.household_lookup(published), "graphid"), "uid": (K.uid_lookup(published, longer_than), "uid")}
    return Lookups(**{k: write_bucketed(f, _names(prefix)[k], [by], buckets, path and f"{path}/{k}") for k, (f, by) in made.items()})


def open_lookups(spark: SparkSession, prefix: str) -> Lookups:
    return Lookups(**{k: spark.table(name) for k, name in _names(prefix).items()})


def stage_claims(claims: DataFrame, table: str, buckets: int = LOOKUP_BUCKETS, path: str | None = None) -> DataFrame:
    """Claims or memberships by uid: align, output_alignment, seeds and the anti joins of propagate and remainder need no exchange of them."""
    return write_bucketed(claims, table, ["uid"], buckets, path)


def stage_edges(edges: DataFrame, table: str, buckets: int = LOOKUP_BUCKETS, path: str | None = None) -> DataFrame:
    """Both directions of each edge by uid2, the end that propagate joins to the members (`both_ways=True`)."""
    return write_bucketed(G.doubled(edges), table, ["uid2"], buckets, path)
