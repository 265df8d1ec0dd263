"""Near-duplicate removal: SimHash finds most groups at low cost, an exact search over shingle prefixes finds the pairs that are left, and
exact shingle similarity decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, drop_path, raw_texts, slices, store, words
from tessel.llm.simhash import SEED, linked, shingle_hashes, simhash
from tessel.llm.superminhash import dealt_out, item_sets, led, work_items

WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints of pairs of words differ less than those of five words when a text is edited. How many pairs lie within 7 bits of 64
#: depends on length and edit; those beyond are left to the search over prefixes.
PROBE_WIDTH, RADIUS = 2, 7
#: Members of a shared shingle that one work item compares at once; more are dealt out as pairs of such chunks.
BLOCK = 256
#: Texts in the sample that tells common shingles, where they are at most 1 / LEAST_PART of all; otherwise one text in LEAST_PART.
SAMPLE, LEAST_PART = 8192, 64
#: Common shingles and hashes of texts that are broadcast, at most. More shingles count as rare, more texts go through a shuffle: neither
#: changes the result.
COMMON, BROADCAST = 1 << 18, 200_000


def _joined(texts: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """Texts by a stored table of hashes: where it is small it goes to the texts, so that these are not shuffled."""
    return texts.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, "h", how)


def _once(batches, seen: set[int]):
    """Slices of (h, ..., text) rows in which a task meets each text once. So copies cost a look, however many there are; a text that
    several tasks hold comes from each of them, and whoever gathers the rows drops what repeats."""
    for batch in slices(batches):
        keep = []
        for k, h in enumerate(batch.column(0).to_pylist()):
            if h not in seen:
                seen.add(h)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64())) if len(keep) < batch.num_rows else batch


def _gathered(texts: DataFrame) -> DataFrame:
    """Rows (h, ..., text) by text: all tasks' copies of one meet in one task."""
    return texts.mapInArrow(lambda batches: _once(batches, set()), texts.schema).repartition("h")


def _probe(texts: DataFrame, probe: int) -> DataFrame:
    """(h, fp, n) for each text: its hash, fingerprint and number of words."""

    def run(batches):
        for batch in _once(batches, set()):
            texts_ = raw_texts(batch.column(1))
            found = np.array([simhash(t, probe) for t in texts_], np.uint64)
            sizes = pa.array([len(words(t or b"")) for t in texts_], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), sizes], names=["h", "fp", "n"])

    return texts.mapInArrow(run, "h long, fp long, n long").distinct()


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(h, shingles): the distinct shingle hashes of each text, in order (none without words)."""

    def run(batches):
        for batch in _once(batches, set()):
            found = [np.unique(shingle_hashes(words(t or b""), width)) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["h", "shingles"])

    return texts.mapInArrow(run, "h long, shingles array<long>")


def parities(found: np.ndarray) -> np.ndarray:
    """Words of 64 bits, one or two bits an element in all: whether an odd number of elements falls on each bit. Two sets differ by as many elements, at
    least, as their bits do; the upper half of the words XOR the lower one are the words of half the size."""
    bits = max(64, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sets of these parities() differ by at least."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _parities(texts: DataFrame, width: int) -> DataFrame:
    """(h, m, bits): number of shingles of each text and their parities()."""

    def run(batches):
        for batch in _once(batches, set()):
            found = [np.unique(shingle_hashes(words(t or b""), width)) for t in raw_texts(batch.column(1))]
            columns = [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([parities(f).tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "m", "bits"])

    return texts.mapInArrow(run, "h long, m long, bits binary").dropDuplicates(["h"])


def _near_enough(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Of `pairs` (a, b) those that may be as similar as asked by the parities (h, m, bits) of both."""

    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            apart = [least_difference(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(*(batch.column(k).to_pylist() for k in (4, 5)))]
            near = (sizes - np.array(apart, np.int64)) * (1 + similarity) + 1e-6 >= 2 * similarity * sizes
            yield batch.select(["a", "b"]).filter(pa.array(near))

    of = lambda end, m, bits: marks.select(F.col("h").alias(end), F.col("m").alias(m), F.col("bits").alias(bits))
    joined = pairs.join(of("a", "m", "x"), "a").join(of("b", "m2", "y"), "b").select("a", "b", "m", "m2", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def _led(docs: DataFrame, text_col: str, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """(h): texts of a group that are near an earlier one of their work item, which stays there."""

    def run(batches):
        for nodes, _, sets in item_sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)[led(sets, 100 * similarity)])], names=["h"])

    return work_items(docs, text_col, members).mapInArrow(run, "h long").distinct()


def _common(texts: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts share, in order, and in how many of a sample they are. Only the cost of the search depends on it."""

    def run(batches):
        for batch in slices(batches):
            found = [np.unique(shingle_hashes(words(t or b""), width)) for t in raw_texts(batch.column(1))]
            keys, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], names=["key", "n"])

    part = max(1, min(LEAST_PART, n // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64(F.lit(SEED), "h"), F.lit(part)) == 0)
    counts, path = store(sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 2"), "common")
    least, room = 3, COMMON
    for r in sorted(counts.groupBy("n").count().collect(), key=lambda r: -r.n):
        room -= r["count"]
        if room < 0:
            least = r.n + 1
            break
    found = counts.where(F.col("n") >= least).toPandas()
    drop_path(texts.sparkSession, path)
    keys, times = found.key.to_numpy(np.int64).view(np.uint64), found.n.to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], times[order]


def similar_pairs(texts: DataFrame, gone: DataFrame, n: int, width: int, similarity: float) -> tuple[DataFrame, str]:
    """(a, b) as a stored table, and its path: hashes of all pairs of texts (h, text; copies do not matter), without those gone, that are as similar as asked.

    Each text's shingles are put in one order of all shingles, common ones last. A set of m shingles shares at least s * m with a set of
    similarity s, so that the two have a shingle in common among their first m - s * m + 1. At the first such shingle the rest of both
    sets must still suffice; a pair that is similar passes there. This finds every pair. Most that it proposes meet by chance, and their number grows
    with the square of the texts: they go by the parities of both sets, which are some fiftieth of these, before whole sets are shuffled. No
    similar pair goes; what is left is compared shingle by shingle.
    """
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(_common(texts, n, width))
    slack = 1e-6

    def prefixes(batches):
        late, times = common.value
        for batch in _once(batches, set()):
            keys, hs, ats, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for h, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                found = np.unique(shingle_hashes(words(t or b""), width))
                m = len(found)
                if not m:
                    found = np.zeros(1, np.uint64)  # texts without words meet in one bucket
                elif len(late):
                    at = np.minimum(np.searchsorted(late, found), len(late) - 1)
                    found = found[np.argsort(np.where(late[at] == found, times[at], 0), kind="stable")]
                found = found[: m - math.ceil(similarity * m - slack) + 1]
                keys.append(found)
                hs.append(np.full(len(found), h))
                ats.append(np.arange(len(found), dtype=np.int32))
                sizes.append(np.full(len(found), m, np.int32))
            columns = [np.concatenate(keys).view(np.int64), *map(np.concatenate, (hs, ats, sizes))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "h", "at", "m"])

    def blocks(batches):
        """The members of each shared key as pairs of chunks; `own`: both are the same chunk."""
        rest = None
        for batch in batches:
            part = [np.asarray(batch.column(i)) for i in range(4)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            once = np.r_[True, (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])]
            part = [x[once] for x in part]
            change = np.flatnonzero(part[0][1:] != part[0][:-1]) + 1
            end = int(change[-1]) if len(change) else 0
            rest = [x[end:] for x in part]
            if end:
                yield from dealt([x[:end] for x in part], np.r_[0, change])
        if rest is not None and len(rest[0]):
            yield from dealt(rest, np.array([0, len(rest[0])]))

    def dealt(part, edges):
        rows = []
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if y - x < 2:
                continue
            chunks = [[c[k : min(k + BLOCK, y)] for c in part[1:]] for k in range(x, y, BLOCK)]
            for i, left in enumerate(chunks):
                for right in chunks[i:]:
                    rows.append((right is left, *left, *right))
                    if len(rows) >= 512:
                        yield block_batch(rows)
                        rows = []
        if rows:
            yield block_batch(rows)

    def block_batch(rows):
        kinds = [pa.bool_(), *[pa.list_(k) for k in (pa.int64(), pa.int32(), pa.int32())] * 2]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["own", "h", "at", "m", "h2", "at2", "m2"])

    def pairs(batches):
        for batch in slices(batches, BLOCK):
            columns = [[np.asarray(v.values) for v in batch.column(i)] for i in range(1, 7)]
            found = [np.zeros((0, 2), np.int64)]
            for own, h, at, m, h2, at2, m2 in zip(batch.column(0).to_pylist(), *columns):
                most = np.minimum(np.minimum((m - at)[:, None], (m2 - at2)[None, :]), np.minimum(m[:, None], m2[None, :]))
                ok = most * (1 + similarity) >= similarity * (m[:, None].astype(np.int64) + m2[None, :]) - slack
                ok &= h[:, None] != h2[None, :]
                if own:
                    ok = np.triu(ok, 1)
                i, j = np.nonzero(ok)
                if len(i):
                    found.append(np.stack([np.minimum(h[i], h2[j]), np.maximum(h[i], h2[j])], 1))
            found = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    left = _joined(texts, gone.select("h").distinct(), "left_anti").select("h", "text")
    keyed = left.mapInArrow(prefixes, "key long, h long, at int, m int").repartition("key").sortWithinPartitions("key", "h")
    dealt_out = keyed.mapInArrow(blocks, "own boolean, h array<long>, at array<int>, m array<int>, h2 array<long>, at2 array<int>, m2 array<int>")
    items, items_path = store(dealt_out, "items")
    proposed, proposed_path = store(items.repartition(F.xxhash64("h", "h2")).mapInArrow(pairs, "a long, b long").distinct(), "proposed")
    drop_path(spark, items_path)
    ends_of = lambda found: found.select(F.col("a").alias("h")).unionAll(found.select(F.col("b").alias("h"))).distinct()
    marked, marked_path = store(ends_of(proposed), "ends")
    read = texts.join(F.broadcast(marked), "h", "left_semi") if marked.count() <= BROADCAST else texts  # of all texts, the marks take less than a shuffle of texts
    marks, marks_path = store(_parities(read.select("h", "text"), width), "marks")
    likely, likely_path = store(_near_enough(proposed, marks, similarity), "likely")
    for done in (proposed_path, marked_path, marks_path):
        drop_path(spark, done)
    members = _joined(texts, ends_of(likely), "left_semi")
    sets, sets_path = store(_sets(_gathered(members.select("h", "text")), width), "sets")
    judged = likely.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y") - shared
    out, path = store(judged.where((total == 0) | (shared >= F.lit(similarity) * total)).select("a", "b"), "similar")
    for done in (likely_path, sets_path):
        drop_path(spark, done)
    return out, path


def _surplus(pairs: DataFrame) -> list[str]:
    """Paths of tables (h): all ends of `pairs` but a maximal set of which no two are a pair, so that each has a partner that stays.

    In each round the ends below all their partners stay and their partners go; the h are hashes, so that few rounds are needed.
    """
    spark = pairs.sparkSession
    edges, path = store(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    out = []
    while not edges.isEmpty():
        stay = edges.groupBy("u").agg(F.min("v").alias("m")).where("u < m").select("u")
        gone, gone_path = store(edges.join(stay, "u", "left_semi").select(F.col("v").alias("h")).distinct(), "gone")
        out.append(gone_path)
        before = path
        edges, path = store(edges.join(gone, edges.u == gone.h, "left_anti").join(gone, edges.v == gone.h, "left_anti"), "edges")
        drop_path(spark, before)
    drop_path(spark, path)
    return out


def near_duplicate_texts(docs: DataFrame, text_col: str, width: int, similarity: float, probe: int, radius: int) -> DataFrame:
    """(h): hashes of texts that go because a near duplicate of them stays, or went for another that stays.

    First, texts whose fingerprints a chain of links connects make a group, which may hold many texts that are not alike. A group is
    dealt out to work items, in each of which every text is compared, shingle by shingle, with those before it that stay; what is as similar as
    asked goes. Texts of a large group in different items, and texts of different groups, may still be alike. So
    similar_pairs() finds all pairs among what is left, whatever their fingerprints, and of these texts all but a maximal set without
    a similar pair go.
    """
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    fps = cut(_probe(texts, probe))
    distinct = fps.select("fp").distinct()
    roots = linked(distinct, radius)
    named = fps.join(roots, fps.fp == roots.node, "left").select("h", "n", F.coalesce("root", "fp").alias("root"))
    sizes = named.groupBy("root").count().where("count > 1").select("root")
    members = named.join(sizes, "root", "left_semi").select("h", "root", "n", *(F.col("h").alias(c) for c in ("t", "node", "label")))
    items, items_path = store(dealt_out(cut(members), False), "dealt")
    _, led_path = store(_led(docs, text_col, items, width, similarity), "gone")
    drop_path(spark, items_path)
    pairs, pairs_path = similar_pairs(texts, spark.read.schema("h long").parquet(led_path), fps.count(), width, similarity)
    out = [led_path, *_surplus(pairs)]
    drop_path(spark, pairs_path)
    return spark.read.schema("h long").parquet(*out)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, probe: int = PROBE_WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, all columns, without near duplicates: of equal texts the row with the smallest id stays, and of texts
    that a chain of near duplicates connects at least one: a text goes only for one that it was compared with, shingle by shingle.
    No two texts that stay are as similar as asked.

    Texts without words (null, empty, white space) are near duplicates of each other. Rows that agree in id and text are one
    document. Null ids stand after all others. Equal texts are told by 128 bits of hash; near duplicates by 64 bits: of 10^10 different
    texts, about three pairs share these, and one of a pair goes wrongly if the other has a near duplicate.
    """
    gone = near_duplicate_texts(docs, text_col, width, similarity, probe, radius)
    other = F.xxhash64(F.lit(1), text_col)
    keys = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), other.alias("_o"))
    first = keys.groupBy("_h", "_o").agg(F.min("_id").alias("_id")).join(gone.select(F.col("h").alias("_h")), "_h", "left_anti")
    kept = docs.withColumn("_hash", F.xxhash64(text_col)).withColumn("_other", other)
    kept = kept.join(first, (F.col("_hash") == F.col("_h")) & (F.col("_other") == F.col("_o")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["_hash", "_other"]).drop("_hash", "_other")
