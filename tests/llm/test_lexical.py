"""Ranked lexical search against a plain reading of its rules."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """{position of the item: [(score, id), ...]} by the rules as they stand; ids sorted with null last."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // length
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


def test_search_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted_rows(want) == sorted_rows(lexical.search(docs, items).collect())


def test_blocks_of_items_and_slices_do_not_matter(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").limit(9)
    want = sorted_rows(lexical.search(docs, items, k=3).collect())
    monkeypatch.setattr(lexical, "ITEMS", 4)
    assert want == sorted_rows(lexical.search(docs, items, k=3).collect())


@pytest.mark.parametrize("k", [1, 3, 10])
def test_awkward_rows(spark, k):
    """Nulls, no terms, ties, repeated rows and ids, a very long text, other scripts, clashing columns."""
    long = " ".join(f"w{x % 991}" for x in range(60_000))
    docs = [(1, "Alpha beta BETA"), (1, "Alpha beta BETA"), (1, "gamma"), (2, None), (3, ""), (4, " .,;\n"), (None, "alpha beta beta"), (None, None), (5, long), (6, "漢字 été ÉTÉ"), (7, "beta" * 9), (8, "alpha\x00beta w1")]
    items = [(1, "beta ALPHA alpha"), (1, "beta ALPHA alpha"), (None, "été"), (2, None), (3, ""), (4, "--"), (5, "unknownword"), (6, long), (7, "É É")]
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, item string, n long, score long")
    asks = spark.createDataFrame([(*d, "y", 7) for d in items], "item_id long, text string, name string, rank int")
    assert sorted_rows(brute(docs, items, k)) == sorted_rows(lexical.search(frame, asks, k).collect())


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items, no_items = spark.createDataFrame([("x", "a")], "item_id string, text string"), spark.createDataFrame([], "item_id string, text string")
    assert lexical.search(none, items).count() == lexical.search(docs, no_items).count() == 0
    assert lexical.search(none, items).dtypes == lexical.search(docs, no_items).dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == brute([(1, "a b")], [("x", "a")])
    common = spark.createDataFrame([(k, "a") for k in range(2000)], docs.schema)  # in every document: its weight is 0
    assert lexical.search(common, items).collect() == []


def test_bounds_enclose_the_scores():
    rng = np.random.default_rng(3)
    wanted = lexical.Wanted([" ".join(f"t{x}" for x in rng.integers(0, 40, 9)).encode() for _ in range(12)])
    size = len(wanted.number)
    weights = lexical.Weights(500, 90_000, rng.integers(1, 500, size))
    sizes = rng.integers(0, size, 30)
    term = np.concatenate([np.sort(rng.choice(size, s, replace=False)) for s in sizes]).astype(np.int32)
    tf, n = rng.integers(1, 50, len(term)), rng.integers(1, 3000, 30)
    impact = weights.impacts(n, sizes, term, tf)
    steps = -(-impact // weights.step[term])
    assert steps.max() <= 255 and steps.min() >= 0
    lower, upper = lexical._bounds(sizes, term, steps, wanted, weights.step)
    doc = np.repeat(np.arange(30), sizes)
    for i, own in enumerate(wanted.of_item):
        score = np.bincount(doc, np.where(np.isin(term, own), impact, 0), 30)
        assert (lower[i] <= score).all() and (score <= upper[i]).all()
        assert (upper[i] - lower[i] <= weights.step[own].sum()).all()


def test_terms_cut_bytes_as_the_pattern_cuts_characters():
    text = "".join(map(chr, [*range(0x250), 0x2028, 0x3000, 0x10FFFF])) + "Aa1_b-É"
    assert [t.decode() for t in lexical.terms(text.encode())] == plain_terms(text)
    assert lexical.terms(None) == lexical.terms(b"") == []
    assert pa.array([b""]).to_pylist() == [b""]
