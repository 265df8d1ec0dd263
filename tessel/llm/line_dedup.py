"""Line deduplication by a log-template tree."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import raw_texts, slices

#: Leading tokens that, with the token count, make the path to a leaf.
DEPTH = 3
#: Least share of equal tokens at which a line joins a template.
SIMILARITY = 0.8
#: Shorter lines recur by chance, and so must stand in more texts.
MIN_TOKENS, SHORT_TEXTS = 5, 5
REMEMBERED = 500_000
WILD = b"<*>"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line; those with a digit are variable from the start."""
    tokens = line.split()
    return [WILD if b"0" in t.translate(_DIGITS) else t for t in tokens] if b"0" in line.translate(_DIGITS) else tokens


def parsed(line: bytes, min_tokens: int = MIN_TOKENS) -> list[bytes]:
    """The masked line; a short one with no fixed token as it stands, else all short lines of numbers would be one."""
    tokens = masked(line)
    return line.split() if len(tokens) < min_tokens and all(t == WILD for t in tokens) else tokens


def signed64(data: bytes) -> int:
    x = xxhash.xxh64_intdigest(data, 42)
    return x - (1 << 64) if x >> 63 else x


def paths(tokens: list[bytes]) -> tuple[int, int]:
    """Leaf (token count and leading tokens) and signature (all tokens) of a masked line, as hashes."""
    return signed64(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH])), signed64(b" ".join(tokens))


class Leaf:
    """Templates of the lines of one leaf, all of one length, that come one by one. A line joins the most similar template if at least
    `similarity` of its tokens equal it (a variable field equals a variable field only), and what differs becomes variable; else it begins
    a new one.

    The first `depth` tokens of all lines are the same. Of the others a line may differ from its template in `width - need`, so that of one
    segment more at least one is equal. Only templates that share a segment with the line are compared with it: no other can be similar enough.
    """

    def __init__(self, width: int, similarity: float = SIMILARITY, depth: int = DEPTH):
        self.need, self.codes, self.names = int(np.ceil(similarity * width - 1e-9)), {WILD: 0}, [WILD]
        edges = np.linspace(min(depth, width), width, width - self.need + 2).astype(int)
        self.segments = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.held: list[dict[bytes, list[int]]] = [{} for _ in self.segments]
        self.rows, self.used = np.empty((16, width), np.int32), 0

    def add(self, line: list[bytes]) -> int:
        """The number of the line's template."""
        codes = self.codes
        for t in line:
            if t not in codes:
                codes[t] = len(codes)
                self.names.append(t)
        row = np.array([codes[t] for t in line], np.int32)
        keys = [row[x:y].tobytes() for x, y in self.segments]
        near = sorted(set().union(*(held.get(key, ()) for held, key in zip(self.held, keys))))
        if near:
            same = (self.rows[near] == row).sum(1)
            best = int(same.argmax())
            if same[best] >= self.need:
                number = near[best]
                own = self.rows[number]
                differs = own != row
                if differs.any():
                    own[differs] = 0
                    for held, (x, y) in zip(self.held, self.segments):
                        if differs[x:y].any():
                            held.setdefault(own[x:y].tobytes(), []).append(number)
                return number
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.used] = row
        for held, key in zip(self.held, keys):
            held.setdefault(key, []).append(self.used)
        self.used += 1
        return self.used - 1

    def template(self, number: int) -> list[bytes]:
        return [self.names[c] for c in self.rows[number].tolist()]


def recurring_lines(docs: DataFrame, text_col: str = "text", min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, short_texts: int = SHORT_TEXTS) -> DataFrame:
    """(sig, template): signatures of lines whose template occurs in at least two different texts, or `short_texts` if it has fewer than
    `min_tokens` tokens.

    Each task sends a line on with at most so many of the texts that hold it, so a line that very many documents share
    stays small. A leaf is read as a sorted stream in one task, which keeps its templates, and of each distinct line its signature and its
    template's number: twelve bytes a line that is like another. Lines and texts are told apart by 64-bit hashes: of 10^10 different
    ones, about three pairs would be taken for equal.
    """

    def needed(tokens):
        return 2 if len(tokens) >= min_tokens else short_texts

    def send(batches):
        seen: dict[int, tuple[int, ...]] = {}  # signature -> the texts sent so far
        for batch in slices(batches):
            out = []
            for raw in raw_texts(batch.column(0)):
                if not raw:
                    continue
                text = signed64(raw)
                for line in raw.split(b"\n"):
                    tokens = parsed(line, min_tokens)
                    if not tokens:
                        continue
                    leaf, sig = paths(tokens)
                    before = seen.get(sig, ())
                    if len(before) >= needed(tokens) or text in before:
                        continue
                    seen[sig] = (*before, text)
                    out.append((leaf, sig, text, b" ".join(tokens)))
            if len(seen) > REMEMBERED:
                seen.clear()
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["leaf", "sig", "doc", "line"])

    def grow(batches):
        leaf, own, need, sigs, numbers, texts, last, found = None, None, 0, [], [], [], None, []

        def settle():
            """The line read last, with its texts, goes to its template."""
            nonlocal own
            sig, line, of = last
            if own is None:
                tokens = line.split(b" ")
                own = Leaf(len(tokens), similarity)
            number = own.add(line.split(b" "))
            if number == len(texts):
                texts.append(set())
            if len(texts[number]) < need:
                texts[number].update(of)
            sigs.append(sig)
            numbers.append(number)

        def close():
            if own is None:  # one line alone is its own template
                if len(last[2]) >= need:
                    found.append((last[0], last[1].decode("utf-8", "replace")))
                return
            settle()
            found.extend((sig, b" ".join(own.template(k)).decode("utf-8", "replace")) for sig, k in zip(sigs, numbers) if len(texts[k]) >= need)

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found])], names=["sig", "template"])

        for batch in batches:
            for x, sig, doc, line in zip(*(c.to_pylist() for c in batch.columns)):
                if x != leaf:
                    if last:
                        close()
                    leaf, own, need, last = x, None, needed(line.split(b" ")), (sig, line, [doc])
                    sigs, numbers, texts = array("q"), array("i"), []
                elif last[0] != sig:
                    settle()
                    last = sig, line, [doc]
                elif len(last[2]) < need and last[2][-1] != doc:  # sorted by text
                    last[2].append(doc)
                if len(found) >= 10_000:
                    yield batch_of()
                    found = []
        if last:
            close()
        if found:
            yield batch_of()

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(send, "leaf long, sig long, doc long, line binary")
    return sent.repartition("leaf").sortWithinPartitions("leaf", "sig", "doc").mapInArrow(grow, "sig long, template string")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, short_texts: int = SHORT_TEXTS) -> DataFrame:
    """Documents without the lines whose template recurs: id, text, n_lines, n_dropped, dropped (line numbers from 0).

    A template recurs if its lines stand in two different texts or more; every such line goes. Copies of one whole text count
    once: they are for document deduplication. A line of fewer than `min_tokens` tokens must stand in `short_texts` different texts, as it
    may recur by chance; blank lines stay. Every row gives one row; a
    null text stays null with no lines, an empty text has one empty line. Other columns are not read.
    """

    def number(batches):
        for batch in slices(batches):
            text, at, sigs = [], [], []
            for n, raw in enumerate(raw_texts(batch.column(2))):
                for k, line in enumerate((raw or b"").split(b"\n")):
                    tokens = parsed(line, min_tokens)
                    if tokens:
                        text.append(n)
                        at.append(k)
                        sigs.append(paths(tokens)[1])
            of = pa.array(text, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(at, pa.int32()), pa.array(sigs, pa.int64())], names=["h", "h2", "at", "sig"])

    recurring = recurring_lines(docs, text_col, min_tokens, similarity, short_texts).select("sig")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("h2"))
    lines = rows.select("h", "h2", "text").mapInArrow(number, "h long, h2 long, at int, sig long").distinct()
    hit = lines.join(recurring, "sig", "left_semi").groupBy("h", "h2").agg(F.array_sort(F.collect_set("at")).alias("dropped"))
    out = rows.join(hit, ["h", "h2"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    all_lines = F.split("text", "\n", -1)
    kept = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.filter(F.transform(all_lines, lambda x, i: F.when(~F.array_contains("dropped", i), x)), lambda x: x.isNotNull()), "\n"))
    return out.select(F.col("id").alias(id_col), kept.alias("text"), F.coalesce(F.size(all_lines), F.lit(0)).alias("n_lines"), F.size("dropped").alias("n_dropped"), "dropped").withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
