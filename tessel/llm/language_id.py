"""Language identification by unigram piece models, summed over all segmentations."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Words of more characters are summed as logarithms, in blocks of BLOCK positions: their probabilities would fall below what a float can hold.
LONGEST, BLOCK = 24, 1 << 14
#: Labelled rows of each language that its model is fitted on, at most about.
MAX_TRAIN = 5_000
#: Longer words are left out of the fit (not of the prediction).
TRAIN_LONGEST = 4_096
#: Probability of a character that is no piece, and the count added to each piece.
STRANGE, ADDED = 1e-9, 0.1
REMEMBERED = 600_000
_LETTER = regex.compile(r"\p{L}")
_LETTERS = regex.compile(r"\p{L}+")
_MARK = "▁"


class Vocabulary:
    """Pieces of a public SentencePiece model; control, unknown and byte pieces are left out. Piece 0 stands for a strange character."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = sorted({p.lower() for p in plain})
        self.size = len(pieces) + 1
        # every beginning of a piece by its hash; a beginning that is no piece itself has number 0
        number = {p[:k]: 0 for p in pieces for k in range(1, len(p))} | {p: k + 1 for k, p in enumerate(pieces)}
        keys = np.zeros(len(number), np.uint64)
        for k, text in enumerate(number):
            h = 0
            for c in text:
                h = self._step(h, ord(c)) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        order = np.argsort(keys)
        self.keys, self.values, self.longest = keys[order], np.array(list(number.values()), np.int64)[order], max(map(len, pieces))
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")

    @staticmethod
    def _step(h: int, c: int) -> int:
        h = (h ^ c) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return h ^ h >> 29

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (word, from, to, piece), by end and word, and the words' lengths in characters. All words grow by a character at a time
        from all their positions, as long as they are the beginning of a piece."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
        live, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for size in range(1, self.longest + 1):
            fits = at[live] + size <= n[word[live]]
            live = live[fits]
            h = (h[fits] ^ codes[live + (size - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            slot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[slot] == h
            value = np.where(hit, self.values[slot], 0)
            arc = np.ones(len(live), bool) if size == 1 else value > 0
            found.append((word[live[arc]], at[live[arc]], at[live[arc]] + size, value[arc]))
            live, h = live[hit], h[hit]
            if not len(live):
                break
        w, i, j, k = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(j << 40 | w, kind="stable")
        return w[order], i[order], j[order], k[order], n


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def parts(token: str) -> list[str]:
    """The runs of letters in a white-space-separated token, each with the mark of a word's beginning. Numerals are no letters."""
    return [_MARK + token] if token.isalpha() else [_MARK + run for run in _LETTERS.findall(token)]


def forward(words: list[str], vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """log probability of each word under each column of p (pieces x languages): the sum over all segmentations."""
    out, short = np.zeros((len(words), p.shape[1])), [k for k, w in enumerate(words) if len(w) <= LONGEST]
    if short:
        w, i, j, k, n = vocab.lattice([words[x] for x in short])
        alpha = np.zeros((LONGEST + 1, len(short), p.shape[1]))
        alpha[0] = 1.0
        for a, b in _ends(j):
            _add(alpha[j[a]], w[a:b], alpha[i[a:b], w[a:b]] * p[k[a:b]])
        out[short] = np.log(alpha[n, np.arange(len(short))])
    if len(short) < len(words):
        logs = np.log(p)
        for x, word in enumerate(words):
            if len(word) > LONGEST:
                out[x] = _forward_long(word, vocab, logs)[-1]
    return out


def _arcs(word: str, vocab: Vocabulary, first: int):
    """Arcs (from, to, piece) of a word that begin in the block of BLOCK positions from `first` on, by end."""
    _, i, j, k, _ = vocab.lattice([word[first : first + BLOCK + vocab.longest]])
    keep = i < BLOCK
    return i[keep] + first, j[keep] + first, k[keep]


def _forward_long(word: str, vocab: Vocabulary, logs: np.ndarray, keep: bool = False) -> np.ndarray:
    """log forward sums of one word, per position; only the last ones if `keep` is false, in memory that does not grow with the word."""
    n, reach = len(word), vocab.longest
    alpha, start = np.full(((n if keep else min(n, BLOCK)) + reach + 1, logs.shape[1]), -np.inf), 0
    alpha[0] = 0.0
    for first in range(0, n, BLOCK):
        if first and not keep:
            held = alpha[BLOCK : BLOCK + reach + 1].copy()
            alpha[:] = -np.inf
            alpha[: len(held)], start = held, first
        i, j, k = _arcs(word, vocab, first)
        for a, b in _ends(j):
            alpha[j[a] - start] = np.logaddexp.reduce(np.concatenate((alpha[j[a] - start][None], alpha[i[a:b] - start] + logs[k[a:b]])), axis=0)
    return alpha[: n - start + 1]


class WordScores:
    """log probabilities of tokens under each language, remembered up to a bound. Tokens that share a run of letters share its sum."""

    def __init__(self, vocab: Vocabulary, p: np.ndarray):
        self.vocab, self.p = vocab, p
        self.clear()

    def clear(self) -> None:
        self.known, self.runs, self.logs, self.used = {}, {}, np.zeros((1 << 16, self.p.shape[1])), 1

    def _store(self, rows: np.ndarray) -> range:
        at = self.used
        self.used += len(rows)
        if self.used > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((max(len(self.logs), len(rows)), self.logs.shape[1]))])
        self.logs[at : self.used] = rows
        return range(at, self.used)

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.clear()
        cut = [(t, parts(t)) for t in tokens if t not in self.known]
        fresh = list({x for _, xs in cut for x in xs if x not in self.runs})
        step = max(500, 400_000 // max(1, self.p.shape[1]))
        for a in range(0, len(fresh), step):
            some = fresh[a : a + step]
            self.runs.update(zip(some, self._store(forward(some, self.vocab, self.p))))
        many = [(t, xs) for t, xs in cut if len(xs) > 1]
        self.known.update((t, self.runs[xs[0]] if xs else 0) for t, xs in cut if len(xs) < 2)
        if many:
            self.known.update(zip([t for t, _ in many], self._store(np.stack([self.logs[[self.runs[x] for x in xs]].sum(0) for _, xs in many]))))

    def total(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        return self.logs[[known[t] for t in tokens]].sum(0)


def expected_counts(words: list[str], times: np.ndarray, vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece, by forward and backward sums under p (one column)."""
    long = [k for k, w in enumerate(words) if len(w) > LONGEST]
    out = sum((_expected_long(words[k], vocab, np.log(p)) * times[k] for k in long), np.zeros(vocab.size))
    short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
    if not short:
        return out
    words, times = [words[k] for k in short], times[short]
    w, i, j, k, n = vocab.lattice(words)
    alpha, beta = np.zeros((2, LONGEST + 1, len(words)))
    alpha[0] = 1.0
    beta[n, np.arange(len(words))] = 1.0
    q = p[k]
    spans = _ends(j)
    for a, b in spans:
        _add(alpha[j[a]], w[a:b], alpha[i[a:b], w[a:b]] * q[a:b])
    back = np.lexsort((w, -i))
    for a, b in _ends(i[back]):
        x = back[a:b]
        _add(beta[i[x[0]]], w[x], beta[j[x], w[x]] * q[x])
    uses = alpha[i, w] * q * beta[j, w] / alpha[n[w], w] * times[w]
    return out + np.bincount(k, uses, vocab.size)


def _expected_long(word: str, vocab: Vocabulary, logs: np.ndarray) -> np.ndarray:
    alpha = _forward_long(word, vocab, logs[:, None], keep=True)[:, 0]
    beta, out = np.full(len(word) + 1, -np.inf), np.zeros(vocab.size)
    beta[-1] = 0.0
    for first in reversed(range(0, len(word), BLOCK)):
        i, j, k = _arcs(word, vocab, first)
        back = np.argsort(-i, kind="stable")
        for a, b in _ends(-i[back]):
            x = back[a:b]
            beta[i[x[0]]] = np.logaddexp.reduce(logs[k[x]] + beta[j[x]])
        out += np.bincount(k, np.exp(alpha[i] + logs[k] + beta[j] - alpha[-1]), vocab.size)
    return out


def _ends(sorted_: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_)])) if len(sorted_) else []


def _add(target: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """target[at] += values, where `at` is sorted."""
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    target[at[first]] += np.add.reduceat(values, first, axis=0)


def piece_counts(training: DataFrame, path: str) -> DataFrame:
    """(lang, piece, n): expected piece counts of all texts of each language, all segmentations weighed by a flat piece distribution."""

    def run(batches):
        vocab = vocabulary(path)
        flat = np.full(vocab.size, 1.0 / vocab.size)
        flat[0] = STRANGE
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(vocab.size))
        held, size = defaultdict(Counter), 0

        def settle():
            for lang, counts in held.items():
                seen = Counter()
                for word, n in counts.items():
                    for part in parts(word):
                        if len(part) <= TRAIN_LONGEST:
                            seen[part] += n
                keys = list(seen)
                for a in range(0, len(keys), 20_000):
                    some = keys[a : a + 20_000]
                    total[lang] += expected_counts(some, np.array([seen[x] for x in some], float), vocab, flat)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.lower().split()
                held[lang].update(words)
                size += len(words)
                if size > 2_000_000 and sum(map(len, held.values())) > REMEMBERED:
                    settle()
                    size = 0
        settle()
        for lang, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(n[k])], names=["lang", "piece", "n"])

    return training.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def identify_language(
    docs: DataFrame, learn, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN
) -> DataFrame:
    """(id, lang_pred, score): the language of every text, by models of the rows for which `learn` (a Column) is true.

    A language's model is a probability for each piece of a fixed public vocabulary (lower-cased), learnt from a sample of about
    `max_train` labelled rows of that language, chosen by a hash of id and text (all, where there are no more), so that a rare language has as
    good a model as a common one. A text's probability is the product over its words of the sum over all segmentations; words are
    runs of letters of any length. Score is the share of the winner among the languages, which weigh alike; the first in code-point
    order wins a tie. Texts that are null or have no letter (numerals such as a half or Roman eight are none), and all texts if
    nothing could be learnt, are `und` with score 0. Rows with a null lang teach nothing. Every row gives one row. The model has
    (languages x pieces) numbers, whatever the size of the corpus.
    """
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    shares = usable.groupBy("lang").agg(F.count("*").alias("rows"))
    draw = F.pmod(F.xxhash64(F.lit("train"), "id", "text"), F.lit(1 << 40)) * F.col("rows") < F.lit(max_train).cast("decimal(20,0)") * (1 << 40)
    chosen = usable.join(F.broadcast(shares), "lang").where(draw)
    counts = piece_counts(chosen.select("lang", "text"), vocabulary_path).toPandas()
    langs = sorted(counts.lang.unique())
    size = vocabulary(vocabulary_path).size
    table = np.zeros((size, len(langs)))
    table[counts.piece.to_numpy(int), np.searchsorted(np.array(langs), counts.lang.to_numpy(str)) if langs else np.zeros(0, int)] = counts.n.to_numpy(float)
    table += ADDED
    table /= table.sum(0)
    table[0] = STRANGE
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        langs, p = shared.value
        memory = WordScores(vocabulary(vocabulary_path), p)
        for batch in batches:
            pred, score = [], []
            texts = batch.column(1).to_pylist()
            for first in range(0, len(texts), 1000):
                some = texts[first : first + 1000]
                split = [t.lower().split() if langs and t and _LETTER.search(t) else None for t in some]
                memory.learn({w for words in split if words for w in words})
                for words in split:
                    if not words:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    total = memory.total(words)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    score.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
