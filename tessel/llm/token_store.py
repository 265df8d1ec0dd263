"""Token ids in raw shards with a minimal perfect hash index."""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import cut, new_path, raw_texts, slices

MAGIC = b"TSLIDS01"
HEAD = "<8sBxxxIQ"  # magic, bytes per id, shard, zero: 24 bytes
HEAD_BYTES = 24
#: Words whose ids a worker remembers; the store is emptied beyond it, which only costs time. Words of more bytes are not remembered.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if uri.startswith("file:") else uri if "://" in uri else f"file://{uri}")


class Encoder:
    """Ids of whole texts, as the tokenizer's encode(text, add_special_tokens=False) gives them.

    A tokenizer whose pre-tokens never span white space encodes each white-space-separated piece by itself, so
    each distinct piece is encoded once. A piece of Latin letters and closing punctuation is cut between the two, as the
    pre-tokenizer does, and its letters go straight to the tokenizer's BPE model. Other tokenizers get whole texts.
    """

    _LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_piece = (
            spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>" and steps == ["NFC", "Replace", "Lowercase"]
            and first.get("behavior") == "Removed" and first.get("pattern", {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        )
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level letters: printable bytes stay, others follow 255
        others = iter(range(256, 512))
        self.letters = {b: chr(b) if b in set(kept) else chr(next(others)) for b in range(256)}
        self.pieces: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def packed(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def core(self, word: str) -> bytes:
        out = self.cores.get(word)
        if out is None:
            if len(self.cores) > REMEMBERED:
                self.cores.clear()
            letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            out = self.packed([t.id for t in self.model.tokenize(letters)])
            if len(letters) <= REMEMBERED_BYTES:
                self.cores[word] = out
        return out

    def piece(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        found = self._LATIN.fullmatch(text)
        if not found:
            return self.whole(text)
        tail = found[2]
        closing = self.cores.get(tail) if tail else b""
        if closing is None:
            closing = self.whole(tail)
            if len(tail) <= REMEMBERED_BYTES:
                self.cores[tail] = closing
        return self.core(found[1].lower()) + closing  # core() may empty the store, so the tail's ids are in hand before

    def encode(self, raw: bytes) -> bytes:
        if not self.by_piece:
            return self.whole(raw.decode("utf-8", "replace"))
        known, out = self.pieces, []
        if len(known) > REMEMBERED:
            known.clear()
        for p in raw.split():
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= REMEMBERED_BYTES:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker, whose memory serves all its tasks."""
    return Encoder(path)


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """Splitmix64 finaliser; one-to-one for each salt."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_of(ids: list, occurrence: np.ndarray) -> np.ndarray:
    """Key of a document: its id, or the hash of an id that is a text; of a later row with the same id, or a null id, a hash of both."""
    null = np.array([i is None for i in ids], bool)
    base = np.array([0 if i is None else i & 0xFFFFFFFFFFFFFFFF if isinstance(i, int) else xxhash.xxh64_intdigest(i.encode(), 42) for i in ids], np.uint64)
    other = mix64(mix64(base, 90) + occurrence.astype(np.uint64), 91) ^ np.where(null, np.uint64(0x5DEECE66D), np.uint64(0))
    return np.where((occurrence == 0) & ~null, base, other)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit tables of falling size. A key owns the bit that it alone hashes
    to; keys that share one go to the next table. A key's slot is the number of owned bits before its own."""

    GAMMA, TABLES = 2, 40

    def __init__(self, tables: list[np.ndarray]):
        self.tables, self.ranks, n = tables, [], 0
        for t in tables:
            ones = np.bitwise_count(t).astype(np.int64)
            self.ranks.append(n + np.concatenate(([0], np.cumsum(ones)[:-1])) if len(t) else ones)
            n += int(ones.sum())
        self.size = n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        tables = []
        while len(keys):
            if len(tables) == cls.TABLES:
                raise ValueError("repeated keys")
            size = max(64, -(-len(keys) * cls.GAMMA // 64) * 64)
            at = mix64(keys, len(tables)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            tables.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(tables)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for most keys that are none (others are told by the stored fingerprints)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (table, rank) in enumerate(zip(self.tables, self.ranks)):
            at = mix64(keys[open_], level) % np.uint64(len(table) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = table[word]
            hit = (here >> bit & np.uint64(1)).astype(bool)
            before = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = rank[word[hit]] + before[hit]
            open_ = open_[~hit]
        return out


class ShardIndex:
    """Key -> (offset, length) within a shard, in ids."""

    def __init__(self, table: PerfectHash, marks: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        self.table, self.marks, self.offsets, self.lengths = table, marks, offsets, lengths

    @staticmethod
    def mark(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys, 77) >> np.uint64(32)).astype("<u4")

    @classmethod
    def build(cls, keys, offsets, lengths) -> ShardIndex:
        table = PerfectHash.build(keys)
        slot = table.slots(keys)
        order = np.empty(len(keys), np.int64)
        order[slot] = np.arange(len(keys))
        return cls(table, cls.mark(keys)[order], offsets.astype("<u8")[order], lengths.astype("<u8")[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found, offset, length"""
        slot = self.table.slots(keys)
        found = slot >= 0
        found[found] = self.marks[slot[found]] == self.mark(keys[found])
        safe = np.where(found, slot, 0)
        if not len(self.marks):
            return found, safe, safe
        return found, self.offsets[safe].astype(np.int64), self.lengths[safe].astype(np.int64)

    def dump(self) -> bytes:
        t = self.table.tables
        return b"".join([struct.pack("<8sIQ", b"TSLIDX01", len(t), len(self.marks)), np.array([len(x) for x in t], "<u8").tobytes(), *[x.astype("<u8").tobytes() for x in t], self.marks.tobytes(), self.offsets.tobytes(), self.lengths.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        magic, levels, n = struct.unpack_from("<8sIQ", data)
        if magic != b"TSLIDX01":
            raise ValueError("not an index")
        at = 20

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        tables = [take("<u8", int(k)) for k in take("<u8", levels)]
        return cls(PerfectHash(tables), take("<u4", n), take("<u8", n), take("<u8", n))


def id_kind(docs: DataFrame, id_col: str) -> str:
    return "long" if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents, in ascending id order, into shards under `path`, and a manifest.

    shard-N.ids: a header of 24 bytes, then raw little-endian ids, 2 bytes each where the vocabulary allows, of document
    after document, each closed by `end_id`. shard-N.idx: the minimal perfect hash index. manifest.json: shards in
    order with the number of ids before each. Returns (shard, id, occurrence), stored, in the shards' order.

    Null texts are empty, so a document has one id at least. Null ids come first; rows that repeat an id follow each other,
    ordered by their text's hash, as occurrences 0, 1, ... An id that is no whole number is kept as text. A file is written under its
    attempt's name and then moved, so a task that runs again leaves the same files. An empty table gives a manifest without shards.
    """
    spark = docs.sparkSession
    kind = id_kind(docs, id_col)

    def run(batches):
        coder, out, offset, number = encoder(tokenizer), None, 0, TaskContext.get().partitionId()
        last, count, end = None, 0, coder.packed([end_id])
        ids, seen, lengths = [], [], []
        home, base = open_fs(path)
        name, attempt = f"{base}/shard-{number:06d}", TaskContext.get().taskAttemptId()
        try:
            for batch in slices(batches):
                mine = batch.column(0).to_pylist()
                if mine and out is None:
                    home.create_dir(base, recursive=True)
                    out = home.open_output_stream(f"{name}.ids.{attempt}")
                    out.write(struct.pack(HEAD, MAGIC, coder.dtype.itemsize, number, 0))
                parts = []
                for i, raw in zip(mine, raw_texts(batch.column(1))):
                    count = count + 1 if ids and i == last else 0
                    last = i
                    parts += (coder.encode(raw) if raw else b"", end)
                    lengths.append((len(parts[-2]) + len(end)) // coder.dtype.itemsize)
                    ids.append(i)
                    seen.append(count)
                if parts:
                    out.write(b"".join(parts))
                    at = len(lengths) - len(mine)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(mine), pa.int32()), batch.column(0), pa.array(seen[at:], pa.int64()), pa.array(lengths[at:], pa.int64())], names=["shard", "id", "occurrence", "n"])
        finally:
            if out is not None:
                out.close()
        if out is not None:
            n = np.array(lengths, np.int64)
            index = ShardIndex.build(key_of(ids, np.array(seen, np.int64)), np.cumsum(n) - n, n)
            with home.open_output_stream(f"{name}.idx.{attempt}") as f:
                f.write(index.dump())
            for suffix in ("ids", "idx"):
                home.move(f"{name}.{suffix}.{attempt}", f"{name}.{suffix}")

    ordered = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h").select("id", "text")
    written = cut(ordered.mapInArrow(run, f"shard int, id {kind}, occurrence long, n long"))
    totals = written.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("documents"), F.min("id").alias("first"), F.max("id").alias("last")).orderBy("shard").collect()
    start, shards = 0, []
    for r in totals:
        shards.append({"shard": r.shard, "start": start, "ids": r.ids, "documents": r.documents, "first": r["first"], "last": r["last"]})
        start += r.ids
    manifest = {"tokenizer": tokenizer.rsplit("/", 1)[-1], "end_id": end_id, "bytes_per_id": encoder(tokenizer).dtype.itemsize, "shards": shards}
    home, base = open_fs(path)
    home.create_dir(base, recursive=True)
    with home.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return written.select("shard", F.col("id").alias(id_col), "occurrence")


def read_manifest(path: str) -> dict:
    home, base = open_fs(path)
    with home.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """An open shard: the index in memory, ids read on demand."""

    def __init__(self, path: str, number: int):
        home, base = open_fs(path)
        with home.open_input_stream(f"{base}/shard-{number:06d}.idx") as f:
            self.index = ShardIndex.load(f.read())
        self.file = home.open_input_file(f"{base}/shard-{number:06d}.ids")
        magic, size, mine, _ = struct.unpack(HEAD, self.file.read(HEAD_BYTES))
        if magic != MAGIC or mine != number:
            raise ValueError("not this shard's ids")
        self.dtype = np.dtype(f"<u{size}")

    def ids(self, offset: int, n: int) -> np.ndarray:
        data = self.file.read_at(n * self.dtype.itemsize, HEAD_BYTES + offset * self.dtype.itemsize)
        return np.frombuffer(data, self.dtype).astype("<u4")


def lookup(path: str, doc_id: int | str, occurrence: int = 0) -> np.ndarray | None:
    """Ids of one document, or None: one probe of the index and one read for each shard whose range holds the id."""
    for s in read_manifest(path)["shards"]:
        if s["first"] is not None and s["first"] <= doc_id <= s["last"]:
            shard = Shard(path, s["shard"])
            found, offset, n = shard.index.find(key_of([doc_id], np.array([occurrence])))
            if found[0]:
                return shard.ids(int(offset[0]), int(n[0]))
    return None


def read_token_digests(rows: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """For each (shard, id, occurrence): start, n_tokens and ids_crc32, read from the files by way of the index."""
    starts = {s["shard"]: s["start"] for s in read_manifest(path)["shards"]}

    def run(batches):
        number, shard = None, None
        for batch in batches:
            of = np.asarray(batch.column(0))
            ids = batch.column(1)
            keys = key_of(ids.to_pylist(), np.asarray(batch.column(2)))
            start, n, crc = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
            for k in np.unique(of).tolist():
                if k != number:
                    number, shard = k, Shard(path, k)
                mine = np.flatnonzero(of == k)
                found, offset, length = shard.index.find(keys[mine])
                if not found.all():
                    raise ValueError(f"shard {k} lacks a document")
                start[mine], n[mine] = starts[k] + offset, length
                crc[mine] = [zlib.crc32(shard.ids(o, m)) for o, m in zip(offset.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(n), pa.array(crc)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return rows.select("shard", id_col, "occurrence").mapInArrow(run, f"{id_col} {id_kind(rows, id_col)}, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the documents' ids (see write_token_shards) and digest what the files hold: one row per input row."""
    spark: SparkSession = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    return read_token_digests(write_token_shards(docs, path, tokenizer, end_id, id_col, text_col), path, id_col)
