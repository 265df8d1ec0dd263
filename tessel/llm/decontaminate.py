"""Benchmark decontamination: SimHash fingerprints of windows of an item's size, a multi-index of Hamming blocks that loses no similar window,
and exact shingle similarity, which decides."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import raw_texts, slices, words

WIDTH, SIMILARITY = 5, 0.8
#: Bytes of benchmark text that one pass over the documents compares; a larger benchmark is compared in several passes.
BLOCK_BYTES = 16 << 20
REMEMBERED = 400_000
#: Places of a text whose windows' fingerprints are taken at once; a longer text is read in parts.
WINDOWS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_codes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code of every run of `width` words, from the words' hashes; one of the whole sequence if it is shorter."""
    n = len(word_hashes)
    width = min(width, n)
    if not n:
        return word_hashes
    code = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        code = (code ^ word_hashes[k : n - width + 1 + k]) * _BASE
        code ^= code >> np.uint64(29)
    return code


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in tokens], np.uint64)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in tokens:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w, 42)
            return np.array([known[w] for w in tokens], np.uint64)


class Votes:
    """Bits of shingle codes as votes of -1 and 1, summed over windows of a text."""

    def __init__(self, codes: np.ndarray):
        bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))

    def of(self, starts: np.ndarray, span: int) -> np.ndarray:
        return 2 * (self.sums[starts + span] - self.sums[starts]) - span


class MultiIndex:
    """Items of one size by their fingerprints, a bit per majority of votes.

    A window as similar as asked differs from an item in at most `moved` shingles, out and in together, each of which moves a vote sum by one.
    So a bit of the item whose sum lies farther than that from the turn is the same in every such window; the others are the radius within
    which the window's fingerprint must lie. The 64 bits are cut into 8 blocks. For each block and each of its 256 values a bitset
    names the items whose firm bits agree; the items named by all blocks are the candidates. None that is similar is missing.
    """

    def __init__(self, votes: np.ndarray, moved: int):
        n = len(votes)
        bits, firm = votes > 0, (votes > moved) | (votes <= -moved)
        pack = lambda x: np.packbits(x, axis=1, bitorder="little")
        value, mask = pack(bits), pack(firm)
        self.size, self.radius = n, int((~firm).sum(1).max())
        agree = ((np.arange(256, dtype=np.uint8)[None, None, :] ^ value[:, :, None]) & mask[:, :, None]) == 0  # item, block, value
        padded = np.zeros((8, 256, -(-n // 64) * 64), np.uint8)
        padded[:, :, :n] = agree.transpose(1, 2, 0)
        self.blocks = np.packbits(padded, axis=2, bitorder="little").view(np.uint64)

    def candidates(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        prints = np.packbits(votes > 0, axis=1, bitorder="little")
        held = self.blocks[0][prints[:, 0]]
        for k in range(1, 8):
            held = held & self.blocks[k][prints[:, k]]
        return np.nonzero(np.unpackbits(held.view(np.uint8), axis=1, bitorder="little")[:, : self.size])


class Benchmark:
    """Items prepared for comparison. Items without words match nothing."""

    def __init__(self, items: list[tuple[object, bytes]], width: int, similarity: float):
        self.width, self.similarity = width, similarity
        hashes = WordHashes()
        self.ids, self.sizes, self.counts = [], [], []
        by_size, codes_of, known = defaultdict(list), [], defaultdict(set)
        for item, text in items:
            tokens = words(text)
            if not tokens:
                continue
            codes = shingle_codes(hashes.of(tokens), width)
            by_size[min(width, len(tokens)), len(codes)].append(len(self.ids))
            known[min(width, len(tokens))].update(codes.tolist())
            codes_of.append(codes)
            self.ids.append(item)
            self.sizes.append(len(tokens))
            self.counts.append(Counter(codes.tolist()))
        self.codes = {w: np.array(sorted(codes), np.uint64) for w, codes in known.items()}
        self.filters = {}
        for w, codes in self.codes.items():
            self.filters[w] = bits = np.zeros(1 << 20, bool)
            bits[codes >> np.uint64(44)] = True
        self.groups = defaultdict(list)  # shingle width -> (shingles of an item, its items, their index)
        for (w, m), mine in sorted(by_size.items()):
            votes = np.concatenate([Votes(codes_of[k]).of(np.zeros(1, np.int64), m) for k in mine])
            self.groups[w].append((m, np.array(mine), MultiIndex(votes, int(2 * m * (1 - similarity) / (1 + similarity) + 1e-9))))

    def search(self, word_hashes: np.ndarray) -> dict[int, tuple[float, int]]:
        """Item -> (similarity, first word) of the most similar window of the item's size, if at least the threshold.

        Window and item of m shingles reach the threshold t only if 2 t m / (1 + t) of the window's shingles are shared, so windows with fewer
        shingles of any item have no fingerprint taken. A text shorter than an item has one window, all of it.
        """
        best: dict[int, tuple[float, int]] = {}
        n = len(word_hashes)
        for width, groups in self.groups.items():
            if n < width:
                continue
            codes = shingle_codes(word_hashes, width)
            maybe = np.flatnonzero(self.filters[width][codes >> np.uint64(44)])
            own = self.codes[width]
            at = np.minimum(np.searchsorted(own, codes[maybe]), len(own) - 1)
            flags = np.zeros(len(codes) + 1, np.int64)
            flags[maybe[own[at] == codes[maybe]] + 1] = 1
            total = np.cumsum(flags)
            if not total[-1]:
                continue
            for m, mine, index in groups:
                span = min(m, len(codes))
                least = int(np.ceil(self.similarity * (m + span) / (1 + self.similarity) - 1e-9))
                if span < least:
                    continue
                starts = np.flatnonzero(total[span:] - total[: len(total) - span] >= least)
                for some in np.split(starts, np.flatnonzero(np.diff(starts // WINDOWS)) + 1):
                    if len(some):
                        self._judge(codes, some, span, m, mine, index, best)
        return best

    def _judge(self, codes, starts, span, m, mine, index, best) -> None:
        first = starts[0]
        votes = Votes(codes[first : starts[-1] + span]).of(starts - first, span)
        for w, k in zip(*index.candidates(votes)):
            start, item = int(starts[w]), int(mine[k])
            own, window = self.counts[item], Counter(codes[start : start + span].tolist())
            shared = sum(min(v, own[c]) for c, v in window.items() if c in own)
            score = shared / (m + span - shared)
            if score >= self.similarity and score > best.get(item, (0.0, 0))[0]:
                best[item] = (score, start)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark's items in lists of bounded size, one at a time."""
    held, size = [], 0
    for r in benchmark.select(item_col, F.col(text_col).cast("binary")).toLocalIterator():
        if r[1]:
            held.append((r[0], bytes(r[1])))
            size += len(r[1])
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _prepared(docs, block, width, similarity):
    return docs.sparkSession.sparkContext.broadcast(Benchmark(block, width, similarity))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = WIDTH, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item, similarity, start_word, n_words): documents with a passage like a benchmark item, one row for each such pair.

    Words are separated by ASCII white space, A-Z lower-cased. Windows of an item's length are found by their SimHash fingerprints (see
    MultiIndex, which loses none) and judged by the exact similarity of five-word shingles with repeats, at least `similarity`. Items of fewer words
    are one shingle. Null and empty texts and items match nothing; rows that repeat an id give their own rows; an empty
    benchmark gives none. Extra columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, similarity double, start_word long, n_words long"
    narrow, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for block in item_blocks(benchmark, item_col, item_text, block_bytes):
        shared = _prepared(docs, block, width, similarity)

        def run(batches, shared=shared):
            bench, hashes = shared.value, WordHashes()
            for batch in slices(batches):
                rows = []
                for i, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                    if raw:
                        found = bench.search(hashes.of(words(raw)))
                        rows += [(i, bench.ids[k], s, at, bench.sizes[k]) for k, (s, at) in sorted(found.items())]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *map(pa.array, cols[1:])], names=["id", "item", "similarity", "start_word", "n_words"])

        part = narrow.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, without those that find_leaks would name. Nothing is shuffled."""
    for block in item_blocks(benchmark, item_col, item_text, block_bytes):
        shared = _prepared(docs, block, width, similarity)

        def run(batches, shared=shared):
            bench, hashes = shared.value, WordHashes()
            for batch in slices(batches):
                texts = raw_texts(batch.column(batch.schema.get_field_index(text_col)))
                yield batch.filter(pa.array([not (raw and bench.search(hashes.of(words(raw)))) for raw in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
