"""Quality classification by co-training a content view and a metadata view."""

from __future__ import annotations

import operator
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.llm.common import cut, raw_texts, slices

#: Labelled rows that the classifier is fitted on, at most. The pool of unlabelled rows has no bound.
MAX_LABELLED = 10_000
#: Rounds, rows that a view hands the other in a round (its most confident of the whole pool; of each kind as many as its share of the labels,
#: but at least LEAST_SHARE, so that the mix of kinds about stays), and the least confidence.
ROUNDS, EXCHANGED, LEAST_SHARE, CONFIDENT = 3, 800, 0.25, 0.99
#: A view counts in the combination as no surer than this.
SUREST = 1e-3
#: Content features that a label's model may use; one occurs in at least MIN_ROWS labelled rows, unlike chance
#: (MIN_Z standard deviations), and changes the odds of the label by a factor of e at least. A source or language with fewer rows counts as other.
MAX_FEATURES, MIN_ROWS, MIN_Z, MIN_LOG_ODDS = 4_000, 3, 3.5, 1.0
REMEMBERED = 200_000
#: Measures are cut at these quantiles.
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99)
BINS = len(QUANTILES) + 1
_TOKEN = re.compile(rb"([^!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)(.*)", re.S)
_PLAIN = b".,;:?'\"-"
#: Measures of the metadata view, in order.
MEASURES = ("chars", "words", "lines", "words_per_line", "chars_per_word", "distinct_share", "upper_share", "digit_share", "symbol_share", "space_share", "repeat_share")
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _PLAIN)


def content_features(token: bytes) -> tuple[int, ...]:
    """Hashes of what a token shows: its word in lower case, the symbols after it, and whether it is in capitals."""
    word, rest = _TOKEN.fullmatch(token).groups()
    out = [b"w" + word.lower()] if word else []
    symbols = rest.strip(_PLAIN)
    if symbols:
        out.append(b"s" + symbols)
    if len(word) > 2 and word.isupper():
        out.append(b"capitals")
    return tuple(xxhash.xxh64_intdigest(x) >> 1 for x in out)


def measures(raw: bytes, tokens: list[bytes], distinct: int) -> list[float]:
    n, w, lines = len(raw), len(tokens), raw.count(b"\n") + 1
    share = lambda chars: (n - len(raw.translate(None, chars))) / max(n, 1)
    return [np.log1p(n), np.log1p(w), np.log1p(lines), w / lines, n / max(w, 1), distinct / max(w, 1), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(b" \t\n"), sum(map(operator.eq, tokens, tokens[1:])) / max(w - 1, 1)]


class Reader:
    """Features of documents. Tokens are remembered up to a bound; with `wanted` (hash -> column) only those features are kept."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted, self.known = wanted, {}

    def read(self, raw: bytes | None) -> tuple[set[int], list[float]]:
        raw = raw or b""
        tokens, known, out = raw.split(), self.known, set()
        distinct = set(tokens)
        if len(known) > REMEMBERED:
            known.clear()
        for t in distinct:
            f = known.get(t)
            if f is None:
                f = content_features(t)
                if self.wanted is not None:
                    f = tuple(self.wanted[x] for x in f if x in self.wanted)
                known[t] = f
            out.update(f)
        return out, measures(raw, tokens, len(distinct))


Rows = tuple[np.ndarray, np.ndarray]  # the features of all rows, row after row, and how many each row has


def margins(rows: Rows, w: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's features and the constant, which comes last."""
    flat, sizes = rows
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[flat], len(sizes)) + w[-1]


def joined(a: Rows, b: Rows) -> Rows:
    return np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))


def some(rows: Rows, keep: np.ndarray) -> Rows:
    return rows[0][np.repeat(keep, rows[1])], rows[1][keep]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p, least: float = 1e-9):
    return np.log(np.clip(p, least, 1 - least) / np.clip(1 - p, least, 1 - least))


def fit_logistic(rows: Rows, width: int, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression over binary features (the last weight is the constant), by accelerated gradient steps with a
    diagonal scale."""
    cols, sizes = rows
    owner = np.repeat(np.arange(len(sizes)), sizes)
    w, v = np.zeros(width + 1), np.zeros(width + 1)
    scale = np.append(np.bincount(cols, weight[owner] / 4, width), weight.sum() / 4) + ridge
    spread = max(1.0, np.sqrt(np.average(sizes + 1, weights=weight)))
    for k in range(steps):
        z = w + k / (k + 3) * v
        margin = np.bincount(owner, z[cols], len(sizes)) + z[-1]
        error = weight * (sigmoid(margin) - y)
        grad = np.append(np.bincount(cols, error[owner], width), error.sum()) + ridge * np.append(z[:-1], 0)
        new = z - grad / (scale * spread)
        w, v = new, new - w
    return w


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and constant of a logistic curve through held-out margins, by Newton steps that are halved until the loss falls. Targets are drawn
    in a little, and the scale slightly towards 1."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t, x = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2)), np.array([1.0, 0.0])

    def loss(x):
        z = x[0] * margin + x[1]
        return (np.logaddexp(0, z) - t * z).sum() + 0.5 * (x[0] - 1) ** 2

    for _ in range(50):
        p = sigmoid(x[0] * margin + x[1])
        g = np.array([((p - t) * margin).sum() + x[0] - 1, (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin**2).sum() + 1, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step, size = np.linalg.solve(h, g), 1.0
        while loss(x - size * step) > loss(x) and size > 1e-6:
            size /= 2
        x = x - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(x[0], 0.0)), float(x[1])


class Metadata:
    """The metadata view: bins of the measures, source and language. A value that too few labelled rows have is `other`."""

    def __init__(self, measured: np.ndarray, source: list, lang: list):
        self.edges = [np.unique(np.quantile(measured[:, k], QUANTILES)) if len(measured) else np.zeros(0) for k in range(len(MEASURES))]
        self.values = [{v: k + 1 for k, v in enumerate(sorted((v for v, n in Counter(x).items() if n >= MIN_ROWS), key=lambda v: (v is None, v or "")))} for x in (source, lang)]
        self.width = len(MEASURES) * BINS + sum(len(v) + 1 for v in self.values)

    def rows(self, measured: np.ndarray, source: list, lang: list) -> Rows:
        out = np.empty((len(source), len(MEASURES) + 2), np.int64)
        for k, edges in enumerate(self.edges):
            out[:, k] = k * BINS + np.searchsorted(edges, measured[:, k])
        base = len(MEASURES) * BINS
        for k, (known, column) in enumerate(zip(self.values, (source, lang))):
            out[:, len(MEASURES) + k] = [base + known.get(v, 0) for v in column]
            base += len(known) + 1
        return out.ravel(), np.full(len(source), out.shape[1])


class Label:
    """Two calibrated views of one label and their combination; the probability that a document is good."""

    def __init__(self, may_use: np.ndarray, content: Rows, metadata: Rows, widths: tuple[int, int], y: np.ndarray):
        self.widths, self.y, self.given = widths, y, None
        self.constant = (float(y.mean()) if len(y) else 1.0) if not len(y) or y.min() == y.max() else None
        if self.constant is None:
            self.prior = float(np.log(y.mean() / (1 - y.mean())))
            keep = may_use[content[0]]
            sizes = np.bincount(np.repeat(np.arange(len(y)), content[1])[keep], minlength=len(y))
            self.may_use, self.labelled = may_use, ((content[0][keep], sizes), metadata)
            self.held = np.arange(len(y)) % 5 == 4  # a fifth only calibrates
            self.added: list[dict[int, tuple]] = [{}, {}]  # for each view: row -> (features, label)

    def fit(self) -> None:
        """Both views on the labelled rows and on what the other view has handed over."""
        self.views = []
        for v, rows in enumerate(self.labelled):
            train, y, weight = some(rows, ~self.held), self.y[~self.held], np.ones((~self.held).sum())
            if self.added[v]:
                more = list(self.added[v].values())
                train = joined(train, (np.concatenate([f for f, _ in more]), np.array([len(f) for f, _ in more])))
                y, weight = np.append(y, [x for _, x in more]), np.append(weight, np.full(len(more), 0.5))
            w = fit_logistic(train, self.widths[v], y, weight)
            self.views.append((w, *fit_platt(margins(some(rows, self.held), w), self.y[self.held])))

    def finish(self) -> None:
        total = sum(logit(p, SUREST) for p in self.by_view([some(r, self.held) for r in self.labelled])) - self.prior
        self.final = fit_platt(total, self.y[self.held])

    def by_view(self, rows: list[Rows]) -> list[np.ndarray]:
        return [sigmoid(a * margins(r, w) + b) for (w, a, b), r in zip(self.views, rows)]

    def score(self, rows: list[Rows]) -> np.ndarray:
        """Rows of probabilities by content, by metadata, and by both."""
        if self.constant is not None:
            return np.full((3, len(rows[0][1])), self.constant)
        one, two = self.by_view(rows)
        a, b = self.final
        return np.stack((one, two, sigmoid(a * (logit(one, SUREST) + logit(two, SUREST) - self.prior) + b)))

    def sure(self, rows: list[Rows], taken: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(view and kind, rows, confidence) of rows of which a view is sure, and which are not taken."""
        out = []
        for v, p in enumerate(self.by_view(rows)):
            clear = (np.abs(logit(p) - self.prior) >= 1) & ~taken
            for good in (0, 1):
                q = p if good else 1 - p
                at = np.flatnonzero(clear & (q >= CONFIDENT))
                at = at[np.argsort(-q[at], kind="stable")[: self.room(good)]]
                out.append((2 * v + good, at, q[at]))
        return out

    def room(self, good: int) -> int:
        """How many rows of a kind go to the other view in a round, at most."""
        return int(EXCHANGED * np.clip(sigmoid(self.prior if good else -self.prior), LEAST_SHARE, 1 - LEAST_SHARE))

    def learn(self, view: int, good: int, row: int, content: np.ndarray, metadata: np.ndarray) -> None:
        features = metadata if view == 0 else content[self.may_use[content]]
        self.added[1 - view][row] = (features, float(good))

    def for_scoring(self) -> Label:
        """Without the rows it was fitted on."""
        for name in ("labelled", "added", "held", "y"):
            self.__dict__.pop(name, None)
        return self


class Classifier:
    """A label for quality and one for toxicity. A document is as good as the worse of the two says."""

    def __init__(self, columns: dict[int, int], metadata: Metadata, labels: list[Label]):
        self.columns, self.metadata, self.labels = columns, metadata, labels

    def rows(self, reader: Reader, texts: list, source: list, lang: list) -> list[Rows]:
        flat, sizes, measured = array("i"), np.zeros(len(texts), np.int64), np.zeros((len(texts), len(MEASURES)))
        for k, t in enumerate(texts):
            found, measured[k] = reader.read(t)
            flat.extend(sorted(found))
            sizes[k] = len(found)
        return [(np.frombuffer(flat, np.int32).astype(np.int64) if len(flat) else np.zeros(0, np.int64), sizes), self.metadata.rows(measured, source, lang)]

    def score(self, rows: list[Rows]) -> np.ndarray:
        return np.minimum(*(label.score(rows) for label in self.labels))


def _labelled(docs: DataFrame, labels: DataFrame, names: list[str], max_labelled: int) -> DataFrame:
    """(id, text, source, lang, y), stored: the labelled rows of the fit, a row for each of at most `max_labelled` ids, chosen by hash. Bit 0 of y:
    good, bit 1: not toxic. Of rows that repeat an id one is chosen by its text's hash."""
    id_col, text_col, source_col, lang_col = names
    mark = F.min((F.col("quality") == 1).cast("int")) + 2 * F.min((F.coalesce("toxic", F.lit(0)) == 0).cast("int"))
    marks = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(mark.alias("y"))
    chosen = marks.orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(max_labelled)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    found = base.join(F.broadcast(chosen), "id")
    return cut(found.groupBy("id").agg(F.min_by(F.struct("text", "source", "lang", "y"), F.xxhash64("text", "source", "lang")).alias("r")).select("id", "r.*"))


def _feature_counts(labelled: DataFrame) -> DataFrame:
    """(feature, n, good, clean): in how many rows of the sample a feature is, and how many of them are good and not toxic."""

    def run(batches):
        reader = Reader()
        for batch in slices(batches):
            y, parts = np.asarray(batch.column(1)), [np.array(sorted(reader.read(t)[0]), np.int64) for t in raw_texts(batch.column(0))]
            mine = np.repeat(y, [len(x) for x in parts])
            keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.bincount(at, x, len(keys)).astype(np.int64)) for x in (np.ones(len(mine)), mine & 1, mine >> 1))], names=["feature", "n", "good", "clean"])

    return labelled.select("text", "y").mapInArrow(run, "feature long, n long, good long, clean long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "good", "clean")]).where(F.col("n") >= MIN_ROWS)


def _chosen(counts: DataFrame, column: str, usual: float) -> np.ndarray:
    """The features that tell most of a label, at most MAX_FEATURES."""
    if not 0 < usual < 1:
        return np.zeros(0, np.int64)
    n, good = F.col("n"), F.col(column)
    z = F.abs((good - n * usual) / F.sqrt(n * usual * (1 - usual)))
    odds = F.abs(F.log((good + 0.5) / (n - good + 0.5)) - float(np.log(usual / (1 - usual))))
    return counts.where((z >= MIN_Z) & (odds >= MIN_LOG_ODDS)).orderBy(z.desc(), "feature").limit(MAX_FEATURES).select("feature").toArrow().column(0).to_numpy()


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, max_labelled: int, rounds: int) -> Classifier:
    """Fit on a bounded sample of labelled rows, then let the views label all other rows for each other.

    A row labelled twice is good only if all its labels say so; a null quality leaves a label out, a null toxic is none. The features of
    all rows outside the sample are stored once, as numbers of the features that the models may use (rows that look alike count once); in
    each round both views score that whole pool, and the most confident rows, EXCHANGED of a view, go to the other view.
    """
    spark, names = docs.sparkSession, [id_col, text_col, source_col, lang_col]
    sample = _labelled(docs, labels, names, max_labelled)
    counts = cut(_feature_counts(sample))
    usual = [x or 0.0 for x in sample.agg(F.avg(F.col("y").bitwiseAND(1)), F.avg(F.shiftright("y", 1))).first()]
    chosen = [_chosen(counts, c, u) for c, u in zip(("good", "clean"), usual)]
    features = np.unique(np.concatenate(chosen))
    columns = {f: k for k, f in enumerate(features.tolist())}

    def read(batches):
        reader = Reader(columns)
        for batch in slices(batches):
            found = [reader.read(t) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(f) for f, _ in found], pa.list_(pa.int32())), pa.array([m for _, m in found], pa.list_(pa.float64())), *batch.columns[2:]], names=["h", "content", "measures", "source", "lang", "y"])

    seen = sample.select(F.xxhash64("id").alias("h"), "text", "source", "lang", "y").mapInArrow(read, "h long, content array<int>, measures array<double>, source string, lang string, y int").orderBy("h").toArrow().combine_chunks()
    column = lambda name: seen.column(name).combine_chunks()
    measured = np.array(column("measures").flatten(), np.float64).reshape(-1, len(MEASURES))
    source, lang, y = column("source").to_pylist(), column("lang").to_pylist(), np.array(column("y"), np.int64)
    content = np.array(column("content").flatten(), np.int64), np.array(column("content").value_lengths(), np.int64)
    metadata = Metadata(measured, source, lang)
    rows, widths = metadata.rows(measured, source, lang), (len(features), metadata.width)
    model = Classifier(columns, metadata, [Label(np.isin(features, f), content, rows, widths, x.astype(float)) for f, x in zip(chosen, (y & 1, y >> 1))])
    open_ = [x for x in model.labels if x.constant is None]
    for x in open_:
        x.fit()
    if open_ and rounds:
        pool = _pool(docs, sample.select("id"), model, names)
        for _ in range(rounds):
            if not _exchange(pool, open_):
                break
            for x in open_:
                x.fit()
    for x in open_:
        x.finish()
        x.for_scoring()
    return model


def _pool(docs: DataFrame, sample: DataFrame, model: Classifier, names: list[str]) -> DataFrame:
    """(h, content, metadata), stored: how each row outside the sample looks to the two views, every look once."""
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(model.columns, model.metadata, []))

    def look(batches):
        model = shared.value
        reader = Reader(model.columns)
        for batch in slices(batches):
            both = model.rows(reader, raw_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat.astype(np.int32))) for flat, sizes in both]
            yield pa.RecordBatch.from_arrays(lists, names=["content", "metadata"])

    id_col, text_col, source_col, lang_col = names
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    rest = base.join(F.broadcast(sample), "id", "left_anti")
    return cut(rest.mapInArrow(look, "content array<int>, metadata array<int>").withColumn("h", F.xxhash64("content", "metadata")).dropDuplicates(["h"]).select("h", "content", "metadata"))


def _exchange(pool: DataFrame, labels: list[Label]) -> int:
    """One round: what each view is most sure of in the whole pool goes to the other view. Returns how many rows went."""
    taken = [np.unique(np.array([h for part in x.added for h in part], np.int64)) for x in labels]
    lean = [Label.__new__(Label) for _ in labels]
    for x, own in zip(labels, lean):
        own.__dict__ = {"views": x.views, "prior": x.prior}
    rooms = [x.room(good) for x in labels for _ in (0, 1) for good in (0, 1)]
    shared = pool.sparkSession.sparkContext.broadcast((lean, taken))

    def run(batches):
        labels, taken = shared.value
        best: dict[int, list] = {}
        for batch in batches:
            h = np.asarray(batch.column(0))
            lists = [batch.column(k) for k in (1, 2)]
            rows = [(np.asarray(x.flatten()).astype(np.int64), np.asarray(x.value_lengths()).astype(np.int64)) for x in lists]
            for k, (label, gone) in enumerate(zip(labels, taken)):
                for slot, at, q in label.sure(rows, np.isin(h, gone)):
                    held = best.setdefault(4 * k + slot, [])
                    held += zip((-q).tolist(), h[at].tolist(), lists[0].take(pa.array(at)).to_pylist(), lists[1].take(pa.array(at)).to_pylist())
                    if len(held) > 8 * EXCHANGED:
                        held.sort(key=lambda r: r[:2])
                        del held[rooms[4 * k + slot] :]
        for slot, held in best.items():
            held.sort(key=lambda r: r[:2])
            if held := held[: rooms[slot]]:
                cols = list(zip(*held))
                yield pa.RecordBatch.from_arrays([pa.array([slot] * len(held), pa.int32()), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32()))], names=["slot", "q", "h", "content", "metadata"])

    found = pool.mapInArrow(run, "slot int, q double, h long, content array<int>, metadata array<int>")
    for by in (["slot", F.pmod("h", F.lit(32))], ["slot"]):
        found = found.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("q", "h"))).where(F.col("_n") <= F.element_at(F.array(*map(F.lit, rooms)), F.col("slot") + 1)).drop("_n")
    n = 0
    for r in found.orderBy("slot", "q", "h").toLocalIterator():
        labels[r.slot // 4].learn(r.slot % 4 // 2, r.slot % 2, r.h, np.array(r.content, np.int64), np.array(r.metadata, np.int64))
        n += 1
    return n


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    threshold: float = 0.5, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS,
) -> DataFrame:
    """(id, p_content, p_metadata, score, keep): probability that a document is good by each view and by both; keep if score >= threshold.

    Quality and toxicity are two labels with a model each; a document gets the lower probability of the two.
    The content view sees which words, symbols and capitals occur; the metadata view sees source, language and measures of
    the page. Each round, either view hands the other up to EXCHANGED unlabelled rows, those of the whole table of which it is
    surest. Every row gives one row; null and empty texts are scored as empty. Labels of one kind only give that kind's share to
    all; without labels all is kept. Fitted on a bounded sample of labelled rows, applied to all rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, source_col, lang_col, max_labelled, rounds))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared.value
        reader = Reader(model.columns)
        for batch in slices(batches):
            p = model.score(model.rows(reader, raw_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[2] >= threshold)], names=["id", "p_content", "p_metadata", "score", "keep"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    return base.mapInArrow(run, f"id {kind}, p_content double, p_metadata double, score double, keep boolean").withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    threshold: float = 0.5, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS,
) -> DataFrame:
    """The rows of `docs`, all columns, that classify_quality keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, source_col, lang_col, max_labelled, rounds))
    at = [docs.columns.index(c) for c in (text_col, source_col, lang_col)]

    def run(batches):
        model = shared.value
        reader = Reader(model.columns)
        for batch in slices(batches):
            text, source, lang = (batch.column(k) for k in at)
            p = model.score(model.rows(reader, raw_texts(text), source.cast(pa.string()).to_pylist(), lang.cast(pa.string()).to_pylist()))
            yield batch.filter(pa.array(p[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
