"""Ranked lexical search: an index of term impacts in two levels, bytes for bounds and whole numbers for scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tessel.llm.common import drop_path, raw_texts, slices, store

#: What a byte of a text counts as: letters and digits in lower case and all bytes beyond ASCII are parts of terms, others stand between them.
PARTS = bytes(b + 32 * (0x41 <= b <= 0x5A) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Impact of a term: w * (SCALE * tf div (1000 * tf + 8 * m)); the quotient is below CEILING.
SCALE, CEILING = 1_000_000_000, 1_000_000
#: Items, and bytes of their texts, that one search takes together; what is broadcast and what a task adds up in is bounded by these.
ITEMS, ITEM_BYTES = 256, 4 << 20
#: Documents whose bounds a task adds up at once.
SLICE_DOCS = 2048


def terms(raw: bytes | None) -> list[bytes]:
    return raw.translate(PARTS).split() if raw else []


class Wanted:
    """The terms of a block of items, numbered, and where they stand: items_of[t] has the items of term t."""

    def __init__(self, texts: list[bytes | None]):
        self.number: dict[bytes, int] = {}
        self.of_item = [np.array(sorted({self.number.setdefault(t, len(self.number)) for t in terms(text)}), np.int32) for text in texts]
        held = np.concatenate([np.zeros(0, np.int32), *self.of_item])
        items = np.repeat(np.arange(len(texts)), [len(x) for x in self.of_item])
        order = np.argsort(held, kind="stable")
        self.items_of = np.split(items[order], np.cumsum(np.bincount(held, minlength=len(self.number)))[:-1]) if len(held) else []


def _postings(docs: DataFrame, id_col: str, text_col: str, wanted) -> DataFrame:
    """(id, n, terms, tf) for each document with a term: its wanted terms, in order, and how often they occur."""
    from collections import Counter

    def run(batches):
        number = wanted.value.number
        for batch in slices(batches):
            at, sizes, ids, times = [], [], [], []
            for k, raw in enumerate(raw_texts(batch.column(1))):
                found = terms(raw)
                if not found:
                    continue
                held = sorted((number[t], n) for t, n in Counter(found).items() if t in number)
                at.append(k)
                sizes.append(len(found))
                ids.append([x[0] for x in held])
                times.append([x[1] for x in held])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["id", "n", "terms", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<long>")


def _document_counts(postings: DataFrame, size: int) -> np.ndarray:
    """In how many documents each wanted term is. Every task sends one number a term."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["t", "n"])

    out = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r.t] = r.n
    return out


class Weights:
    """What an impact is made of: w of each wanted term, document counts and lengths, and the step of a term's byte impacts."""

    def __init__(self, documents: int, length: int, held: np.ndarray):
        self.documents, self.length = documents, length
        self.w = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * held + 1))).astype(np.int64)
        self.step = np.maximum(1, -(-self.w * CEILING // 255))

    def impacts(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Of postings (term, tf), `sizes` of them for each document of length n."""
        m = np.array([10 + 90 * int(x) * self.documents // self.length for x in n], np.int64)
        return self.w[term] * (SCALE * tf // (1000 * tf + 8 * np.repeat(m, sizes)))


def _columns(batch, first: int = 0):
    """Lengths and values of a batch's list columns from `first` on."""
    lists = [batch.column(k) for k in range(first, batch.num_columns)]
    return np.asarray(lists[0].value_lengths()).astype(np.int64), *(np.asarray(x.flatten()) for x in lists)


def _index(postings: DataFrame, weights) -> DataFrame:
    """Postings with the upper level: for each, its impact in steps of the term, rounded up, in one byte."""

    def run(batches):
        own = weights.value
        for batch in slices(batches, SLICE_DOCS):
            sizes, term, tf = _columns(batch, 2)
            steps = -(-own.impacts(np.asarray(batch.column(1)), sizes, term, tf) // own.step[term])
            edges, raw = np.cumsum(sizes), steps.astype(np.uint8).tobytes()
            bytes_ = pa.array([raw[e - s : e] for s, e in zip(sizes.tolist(), edges.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, bytes_], names=["id", "n", "terms", "tf", "impacts"])

    kind = postings.schema["id"].dataType.simpleString()
    return postings.mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<long>, impacts binary")


def _bounds(sizes, term, steps, wanted: Wanted, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores, items by documents."""
    lower, upper = (np.zeros((len(wanted.of_item), len(sizes)), np.int64) for _ in range(2))
    order = np.argsort(term, kind="stable")
    doc, term, steps = np.repeat(np.arange(len(sizes)), sizes)[order], term[order], steps[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else []
    for s, e in zip(starts, np.r_[starts[1:], len(term)] if len(term) else []):
        where = np.ix_(wanted.items_of[term[s]], doc[s:e])
        upper[where] += steps[s:e] * step[term[s]]
        lower[where] += np.maximum(steps[s:e] - 1, 0) * step[term[s]]
    return lower, upper


def _raw_steps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _floors(index: DataFrame, wanted, weights, items: int, k: int) -> list[int]:
    """For each item the k-th largest lower bound of all documents; 0 where fewer have one."""

    def run(batches):
        best = np.zeros((items, k), np.int64)
        for batch in slices(batches, SLICE_DOCS):
            sizes, term = _columns(batch.select(["terms"]))
            if len(term):
                lower, _ = _bounds(sizes, term, _raw_steps(batch.column(1)), wanted.value, weights.value.step)
                best = np.partition(np.concatenate([best, lower], 1), lower.shape[1], axis=1)[:, -k:]
        at, _ = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best[best > 0])], names=["item", "bound"])

    found = index.select("terms", "impacts").mapInArrow(run, "item int, bound long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"))))
    out = [0] * items
    for r in ranked.where(f"rank <= {k}").where(f"rank = {k}").collect():
        out[r.item] = r.bound
    return out


def _scores(index: DataFrame, wanted, weights, floors: list[int]) -> DataFrame:
    """(item, id, score): exact scores of all documents whose upper bound reaches the item's floor."""
    least = np.maximum(np.array(floors, np.int64), 1)[:, None]

    def run(batches):
        want, own = wanted.value, weights.value
        for batch in slices(batches, SLICE_DOCS):
            sizes, term, tf = _columns(batch.select(["terms", "tf"]))
            if not len(term):
                continue
            _, upper = _bounds(sizes, term, _raw_steps(batch.column(4)), want, own.step)
            item, doc = np.nonzero(upper >= least)
            ends, n = np.cumsum(sizes), np.asarray(batch.column(1))
            score = np.zeros(len(doc), np.int64)
            for d in np.unique(doc).tolist():
                s, e = ends[d] - sizes[d], ends[d]
                impact = own.impacts(n[d : d + 1], sizes[d : d + 1], term[s:e], tf[s:e])
                for at in np.flatnonzero(doc == d).tolist():
                    score[at] = impact[np.isin(term[s:e], want.of_item[item[at]], assume_unique=True)].sum()
            keep = score > 0
            yield pa.RecordBatch.from_arrays([pa.array(item[keep].astype(np.int32)), batch.column(0).take(pa.array(doc[keep])), pa.array(score[keep])], names=["item", "id", "score"])

    kind = index.schema["id"].dataType.simpleString()
    return index.mapInArrow(run, f"item int, id {kind}, score long")


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of items (id, text), of bounded number and size; an item beyond that size is alone."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        raw = r.text.encode() if r.text else b""
        if block and (len(block) == ITEMS or size + len(raw) > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((r.id, raw))
        size += len(raw)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents for each item by the whole-number score of op11's contract: the item's id, rank, the document's id, score.

    The postings of all documents for the items' terms are stored as an index of two levels: a byte for each posting, its
    impact rounded up to steps of the term, and counts. The bytes bound every score from both sides. Documents whose
    upper bound reaches the k-th largest lower bound are scored exactly, so no document that belongs among the first k is missed.

    Null texts have no terms; they count neither in N nor anywhere. An item without terms, or whose terms no document has, gives no rows; one
    with fewer than k documents above 0 gives these. Every row of both tables stands for itself: repeated rows, and rows
    with equal or null ids, are documents and items of their own. Equal scores go by ascending id, null ids last. Empty
    tables give no rows. Other columns are not read. Items come to the driver in blocks of bounded size, each of which reads the documents once.
    """
    spark = docs.sparkSession
    kinds = f"{item_col} {items.schema[item_col].dataType.simpleString()}, rank int, {id_col} {docs.schema[id_col].dataType.simpleString()}, score long"
    paths = []
    for block in _blocks(items, item_col, item_text_col):
        own = Wanted([text for _, text in block])
        wanted = spark.sparkContext.broadcast(own)
        postings, postings_path = store(_postings(docs, id_col, text_col, wanted), "postings")
        facts = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if facts.documents and own.number:
            weights = spark.sparkContext.broadcast(Weights(facts.documents, facts.length, _document_counts(postings, len(own.number))))
            index, index_path = store(_index(postings, weights), "index")
            floors = _floors(index, wanted, weights, len(block), k)
            scores = _scores(index, wanted, weights, floors)
            ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
            names = spark.createDataFrame([Row(item=j, name=x) for j, (x, _) in enumerate(block)], f"item int, name {items.schema[item_col].dataType.simpleString()}")
            found = ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
            paths.append(store(found, "ranked")[1])
            drop_path(spark, index_path)
            weights.destroy()
        drop_path(spark, postings_path)
        wanted.destroy()
    return spark.read.schema(kinds).parquet(*paths) if paths else spark.createDataFrame([], kinds)
