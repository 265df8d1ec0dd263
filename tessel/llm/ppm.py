"""Byte-context language model by partial matching, and a word unigram baseline."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, raw_texts, slices

ORDER = 5
#: Closes a text and fills the context before it: a byte that UTF-8 never uses.
END = 0xFF
#: Runs (a context and its symbol) of the highest order that are broadcast, at most: those of the most frequent contexts. The others are looked
#: up in a distributed table by a shuffled join, so that the model holds every context of the corpus, whatever its size; where a run is looked
#: up does not change its probability. The broadcast takes 24 MB at the bound, and a worker about 70 MB for it.
HEAD_RUNS = 1 << 21
#: Words with at least this share of all training tokens are looked up where the text is, at most 1 / share of them; others by a shuffled join.
HEAD_SHARE = 2.0**-20
SLICE = 4 << 20
#: Runs of bytes that a task holds before it passes them on.
HELD_RUNS = 2_000_000
REMEMBERED = 400_000


class Trie:
    """Adaptive byte-context trie, method D: after a context with n symbols of t kinds, a kind seen c times has (2c - 1) / 2n, the escape
    t / 2n. An escape excludes the context's kinds from all shorter ones. Below order 0 all bytes are alike."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, defaultdict(Counter)

    def probability(self, context: bytes, symbol: int) -> float:
        p, excluded = 1.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            c = context[len(context) - k :]
            node = self.nodes.get(c)
            if not node:
                continue
            n = sum(v for s, v in node.items() if s not in excluded)
            t = sum(s not in excluded for s in node)
            if not t:
                continue
            if symbol in node:
                return p * (2 * node[symbol] - 1) / (2 * n)
            p *= t / (2 * n)
            excluded |= node.keys()
        return p / (256 - len(excluded))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.nodes[context[len(context) - k :]][symbol] += 1

    def score(self, text: bytes, adapt: bool = False) -> float:
        """log10 probability of the text and its end; `adapt` learns each byte after coding it."""
        data, out = bytes([END] * self.order) + text + bytes([END]), 0.0
        for i in range(self.order, len(data)):
            out += math.log10(self.probability(data[i - self.order : i], data[i]))
            if adapt:
                self.learn(data[i - self.order : i], data[i])
        return out


class Index:
    """Values of 64-bit keys by open addressing, in arrays: a lookup costs about one probe, whatever the number of keys."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.FREE), np.zeros(1 << self.bits, np.float32)
        keys, at = keys.astype(np.uint64), self.slots(keys.astype(np.uint64))
        while len(keys):
            free = np.flatnonzero(self.keys[at] == self.FREE)
            slots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], at[rest] + 1 & (1 << self.bits) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, and where there is none (positions, ascending)."""
        at = self.slots(keys)
        found, out = self.keys[at], self.values[at]
        open_ = np.flatnonzero(found != keys)
        gone = [open_[found[open_] == self.FREE]]
        open_ = open_[found[open_] != self.FREE]
        step = 0
        while len(open_):
            step += 1
            probe = at[open_] + step & (1 << self.bits) - 1
            found = self.keys[probe]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[probe[hit]]
            gone.append(open_[found == self.FREE])
            open_ = open_[~hit & (found != self.FREE)]
        return out, np.sort(np.concatenate(gone))


def at_keys(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in a sorted array, and which are there."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


class Head:
    """The runs of the most frequent contexts of each order, all runs of a context together, and what escapes cost.

    A run that follows its context directly has (2n - 1) / 2N: its count and the context's count. An escape from a context costs T / 2N, T being the
    number of its symbols, and leaves the suffix context with the counts of the symbols not seen here, in all D / 2: there a run has
    (2n - 1) / D, a further escape t / D. `whole`: every context of the corpus is here.
    """

    def __init__(self, order: int, grams: list[tuple[np.ndarray, np.ndarray]], whole: bool):
        self.order, self.whole, self.index, self.levels = order, whole, None, []
        below = None
        for k, (keys, n) in enumerate(grams):
            sorting = np.argsort(keys)
            keys, n = keys[sorting].astype(np.uint64), n[sorting].astype(np.float64)
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
            level = {"keys": keys, "log": np.log10(2 * n - 1), "contexts": contexts, "direct": np.log10(2 * total), "escape": np.log10(kinds / (2 * total)) if len(kinds) else kinds, "total": total, "kinds": kinds, "n": n}
            if k and len(keys):
                own, _ = at_keys(below["keys"], keys & np.uint64((1 << 8 * k) - 1))
                seen = np.add.reduceat(below["n"][own], first)
                up, _ = at_keys(below["contexts"], contexts & np.uint64((1 << 8 * (k - 1)) - 1))
                more = below["kinds"][up] - kinds
                rest = 2 * (below["total"][up] - seen)
                level["rest"] = np.log10(np.maximum(rest, 1e-300))
                level["further"] = np.where(more > 0, np.log10(np.maximum(more, 1) / np.maximum(rest, 1e-300)), 0.0)
            self.levels.append(level)
            below = level
        self.last = -math.log10(max(1, 256 - len(grams[0][0])))
        for level in self.levels:
            for c in ("total", "kinds", "n"):
                level.pop(c)

    def runs(self) -> Index:
        """Probabilities of runs of the highest order after their contexts; made where it is used."""
        if self.index is None:
            top = self.levels[self.order]
            of, _ = at_keys(top["contexts"], top["keys"] >> np.uint64(8))
            self.index = Index(top["keys"], (top["log"] - top["direct"][of]).astype(np.float32) if len(of) else np.zeros(0, np.float32))
        return self.index

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def by_escape(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of runs that the index lacks, and which of them the head cannot tell: their context may be in the distributed table."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        before, level_of = np.full(len(keys), -1), None
        top, known = at_keys(self.levels[self.order]["contexts"], keys >> np.uint64(8))
        far = np.zeros(len(keys), bool) if self.whole else ~known
        open_ = open_[~far]
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            key = keys[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, hit = at_keys(level["keys"], key)
            context, known = at_keys(level["contexts"], key >> np.uint64(8))
            come = before[open_] >= 0
            if len(level["keys"]):
                out[open_[hit]] += level["log"][at[hit]] - np.where(come[hit], level_of["rest"][before[open_[hit]]] if level_of is not None and "rest" in level_of else 0.0, level["direct"][context[hit]])
                miss = ~hit & known
                out[open_[miss]] += np.where(come[miss], level_of["further"][before[open_[miss]]] if level_of is not None and "further" in level_of else 0.0, level["escape"][context[miss]])
            keep = ~hit
            before[open_[keep]] = np.where(known[keep], context[keep], -1)
            open_, level_of = open_[keep], level
        out[open_] += self.last
        return out, far

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """log10 probability of each text with its end, in slices of bounded size, and for each the runs (keys, times) left to the table."""
        out, far, held, size, owner = np.zeros(len(texts)), [[] for _ in texts], [], 0, []
        for k, text in enumerate(texts):
            data = bytes([END]) * self.order + text + bytes([END])
            for at in range(0, len(data) - self.order, SLICE):
                part = data[at : at + SLICE + self.order]
                held.append(part)
                owner.append(k)
                size += len(part)
                if size >= SLICE:
                    self._add(out, far, held, owner)
                    held, owner, size = [], [], 0
        if held:
            self._add(out, far, held, owner)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        joined = [np.unique(np.concatenate(f), return_counts=True) if f else none for f in far]
        return out, joined

    def _add(self, out, far, held, owner) -> None:
        keys, mine = run_keys(held, self.order)
        p, gone = self.runs().find(keys)
        p = p.astype(np.float64)
        if len(gone):
            p[gone], left = self.by_escape(keys[gone])
            if left.any():
                at = gone[left]
                p[at] = 0.0
                who = np.repeat(np.array(owner), mine)[at]
                cuts = np.flatnonzero(np.diff(who)) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    far[who[part[0]]].append(keys[at[part]])
        total = np.concatenate(([0.0], np.cumsum(p)))
        last = np.cumsum(mine)
        np.add.at(out, owner, total[last] - total[last - mine])


def run_keys(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of order + 1 bytes in each part, as integers, part after part, and how many each has."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data) - order
    runs = np.zeros(n, np.uint64)
    for k in range(order + 1):
        runs = runs << np.uint64(8) | data[k : n + k]
    sizes = np.array([len(t) for t in parts])
    keep = np.ones(len(data), bool)
    for k in range(order):  # no run begins in one part and ends in another
        keep[np.cumsum(sizes) - sizes + k] = False
    return runs[keep[order:]], sizes - order


class Hashes:
    """64-bit hashes of words, remembered. Different words could share one: below 1 in 10^6 for ten million words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 42)
        return np.array([known[w] for w in words], np.uint64).view(np.int64)


#: Hash of the end token; no word is empty.
END_HASH = int(np.uint64(xxhash.xxh64_intdigest(b"", 42)).view(np.int64))


def byte_runs(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of order + 1 bytes (a context and its symbol), as integers, and their counts."""
    return np.unique(run_keys([bytes([END]) * order + t + bytes([END]) for t in texts], order)[0], return_counts=True)


def corpus_counts(training: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n) over a `text` column: kind 0 word hashes with the end token, kind 1 runs of order + 1 bytes."""

    def run(batches):
        hashes, runs = Hashes(), []
        for batch in batches:
            held, size, words = [], 0, Counter()
            texts = raw_texts(batch.column(0))
            for k, raw in enumerate(texts):
                text = (raw or b"").lower()
                words.update(text.split())
                held.append(text)
                size += len(text)
                if size >= SLICE or k + 1 == len(texts):
                    runs.append(byte_runs(held, order))
                    held, size = [], 0
                    if sum(len(x) for x, _ in runs) > HELD_RUNS:
                        runs = [merged(runs)]
                        if len(runs[0][0]) > HELD_RUNS // 2:
                            yield batch_of(1, *runs.pop())
                if len(words) >= REMEMBERED:
                    yield batch_of(0, hashes.of(list(words)), np.array(list(words.values())))
                    words.clear()
            if words:
                yield batch_of(0, hashes.of(list(words)), np.array(list(words.values())))
            if texts:
                yield batch_of(0, np.array([END_HASH]), np.array([len(texts)]))
        if runs:
            yield batch_of(1, *merged(runs))

    def merged(runs):
        keys, at = np.unique(np.concatenate([x for x, _ in runs]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in runs])).astype(np.int64)

    def batch_of(kind, key, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    return training.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def levels_of(runs: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Counts (key, n) of runs of 1, 2, ... order + 1 bytes: those of shorter runs are sums of those of longer ones."""
    out = [runs]
    for k in range(order, 0, -1):
        level = out[-1].groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(F.sum("n").alias("n"))
        out.append(cut(level) if k > 2 else level)
    return out[::-1]


def contexts_of(level: DataFrame) -> DataFrame:
    """(context, total, kinds) of the runs of an order."""
    return level.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))


def train_head(levels: list[DataFrame], most: int = HEAD_RUNS) -> Head:
    """The contexts that are counted most often, as many as have at most `most` runs of the highest order; with a context always its suffix,
    which is counted no less often."""
    order = len(levels) - 1
    step = F.floor(F.log2("total") * 8).cast("int")
    steps = contexts_of(levels[order]).groupBy(step.alias("step")).agg(F.sum("kinds").alias("kinds")).collect()  # at most 512 rows
    least, room, whole = 0, most, True
    for r in sorted(steps, key=lambda r: -r.step):
        room -= r.kinds
        if room < 0:
            least, whole = r.step + 1, False
            break
    grams = []
    for level in levels:
        if not whole:
            often = contexts_of(level).where(step >= least).select("context")
            level = level.withColumn("context", F.shiftright("key", 8)).join(often, "context", "left_semi")
        found = level.select("key", "n").toArrow()
        grams.append((found.column("key").to_numpy(), found.column("n").to_numpy()))
    return Head(order, grams, whole)


def table_scores(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, p): log10 probabilities of distinct runs of the highest order, by joins with the whole table, an order at a time."""
    last = -math.log10(max(1, 256 - levels[0].count()))
    none = F.lit(None).cast("double")
    open_ = keys.withColumns({"p": F.lit(0.0), "rest": none, "further": none})
    done = []
    for k in range(len(levels) - 1, -1, -1):
        contexts = contexts_of(levels[k])
        if k:
            mine = levels[k].select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key"))
            seen = mine.join(levels[k - 1], "key").groupBy("context").agg(F.sum("n").alias("seen"))
            up = contexts_of(levels[k - 1]).select(F.col("context").alias("suffix"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
            contexts = contexts.join(seen, "context").withColumn("suffix", F.col("context").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(up, "suffix")
            more = F.col("up_kinds") - F.col("kinds")
            all_ = (F.col("up_total") - F.col("seen")) * 2
            contexts = contexts.select("context", "total", "kinds", F.log10(F.greatest(all_, F.lit(1))).alias("new_rest"), F.when(more > 0, F.log10(more / all_)).otherwise(0.0).alias("new_further"))
        else:
            contexts = contexts.select("context", "total", "kinds", none.alias("new_rest"), none.alias("new_further"))
        at = F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1)
        found = open_.withColumn("run", at).withColumn("context", F.shiftright("run", 8)).join(contexts, "context", "left").join(levels[k].select(F.col("key").alias("run"), "n"), "run", "left")
        hit = F.col("n").isNotNull()
        found = cut(found.select(
            "key", hit.alias("hit"),
            (F.col("p") + F.when(hit, F.log10(F.col("n") * 2 - 1) - F.coalesce("rest", F.log10(F.col("total") * 2))).when(F.col("total").isNull(), 0.0)
             .otherwise(F.coalesce("further", F.log10(F.col("kinds") / (F.col("total") * 2))))).alias("p"),
            F.col("new_rest").alias("rest"), F.col("new_further").alias("further")))
        done.append(found.where("hit").select("key", "p"))
        open_ = found.where("not hit").drop("hit")
    out = open_.select("key", (F.col("p") + last).alias("p"))
    for part in done:
        out = out.unionAll(part)
    return out


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", head_runs: int = HEAD_RUNS) -> DataFrame:
    """Score every document by a model of order 5 and a word unigram learnt from those for which `held_out` (a Column) is not true.

    Columns: the id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (log10, add-half unigram), score (log10 probability of the lower-cased bytes and the end of the text).
    Every row gives one row; null texts are empty and have one token. Without training rows all bytes are alike and
    n_known is 0. The model has every context of up to five bytes that occurs in training; `head_runs` bounds what is broadcast of it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = cut(corpus_counts(rows.where(~F.col("held_out")).select("text")))
    words = counts.where("kind = 0").select("key", "n")
    n_train, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = words.where(F.col("n") >= HEAD_SHARE * n_train).toArrow()
    order = np.argsort(often.column("key").to_numpy())
    head_keys, head_n = often.column("key").to_numpy()[order], often.column("n").to_numpy()[order].astype(np.float64)
    levels = levels_of(counts.where("kind = 1").select("key", "n"))
    head = train_head(levels, head_runs)
    whole = head.whole
    unit = math.log10(n_train + 0.5 * (vocabulary + 1))
    shared = spark.sparkContext.broadcast((head, head_keys, np.log10(head_n + 0.5) - unit))
    kind = rows.schema["id"].dataType.simpleString()

    def lists(parts, value):
        ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, value), *parts]).astype(value)))

    def run(batches):
        head, head_keys, head_logs = shared.value
        hashes, at = Hashes(), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            texts = [(t or b"").lower() for t in raw_texts(batch.column(1))]
            n, known, base, tail_keys, tail_n = [], [], [], [], []
            for t in texts:
                words = Counter(t.split())
                keys = np.append(hashes.of(list(words)), END_HASH)
                times = np.array([*words.values(), 1], np.int64)
                slot, hit = at_keys(head_keys, keys)
                n.append(int(times.sum()))
                known.append(int(times[hit].sum()))
                base.append(float((times[hit] * head_logs[slot[hit]]).sum()))
                tail_keys.append(keys[~hit])
                tail_n.append(times[~hit])
            ids = np.arange(at, at + len(texts))
            at += len(texts)
            score, far = head.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                 lists(tail_keys, np.int64), lists(tail_n, np.int32), lists([x.view(np.int64) for x, _ in far], np.int64), lists([x for _, x in far], np.int32)],
                names=["row", "id", "held_out", "n_tokens", "known", "base", "score", "tail_keys", "tail_n", "far_keys", "far_n"],
            )

    scored = cut(rows.mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail_keys array<long>, tail_n array<int>, far_keys array<long>, far_n array<int>"))
    pairs = lambda name: scored.select("row", F.explode(F.arrays_zip(f"{name}_keys", f"{name}_n")).alias("x")).select("row", F.col(f"x.{name}_keys").alias("key"), F.col(f"x.{name}_n").alias("times"))
    rest = (
        pairs("tail").join(words.where(F.col("n") < HEAD_SHARE * n_train), "key", "left")
        .groupBy("row").agg(
            F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - unit)).alias("more"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"),
        )
    )
    out = scored.drop("tail_keys", "tail_n", "far_keys", "far_n").join(rest, "row", "left").withColumn("far", F.lit(0.0))
    if not whole:
        far = cut(pairs("far"))
        found = far.join(table_scores(far.select("key").distinct(), levels), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("p")).alias("far"))
        out = out.drop("far").join(found, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )
