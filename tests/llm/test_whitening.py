"""Whitening against numpy, and on awkward vectors."""

import math

import numpy as np
import pytest

from tessel.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string, w string"


def plain(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums) / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    return x, n, sums, e, w, np.trace(v)


def by_row(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return out


def test_whitening_of_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    x, n, sums, e, w, trace = plain(rows.values())
    out = by_row(queries.op13_whitening(spark, SF))
    assert out.keys() == rows.keys() and all(sorted(c) == list(range(1, 17)) for c in out.values())
    signs = None
    for own, i in zip(x, rows):
        got = [out[i][k + 1][0] for k in range(16)]
        assert all(r.n == n and r.deviation == sum((int(a) * n - int(s)) ** 2 for a, s in zip(own, sums)) for r in got)
        want = ((own * n - sums) / n @ w[:, :16]) / np.sqrt(e[:16])
        have = np.array([r.whitened for r in got])
        signs = np.sign(want * have) if signs is None else signs
        assert have * signs == pytest.approx(want, abs=1e-8)
        assert [r.explained for r in got] == pytest.approx((e[:16] / trace).tolist(), rel=1e-6)
        assert got[0].identity_error <= 1e-8


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k % 7), float(k * k % 11), 0.5 * k], "a", None, "c", "w") for k in range(30)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, nan, 2.0]), (93, [inf, 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (None, None)]
    more = [(3, good[3][1]), (3, good[4][1]), (None, good[5][1])]  # repeated rows and ids, a null id
    frame = spark.createDataFrame([*good, *((*b, None, None, None, None) for b in [*bad, *more])], SCHEMA)
    out = by_row(whitening.whiten(frame, most=16))
    assert out.keys() == {*range(30), None} and all(sorted(c) == [1, 2, 3] for c in out.values())
    assert [len(out[i][1]) for i in (0, 3, None)] == [1, 3, 1]
    assert out[None][2][0][2:] == out[5][2][0][2:] and out[0][1][0].n == 30
    assert out[0][1][0].identity_error < 1e-9


def test_directions_without_variance(spark):
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert {(r.component, r.whitened is None) for r in rows} == {(1, False), (2, True), (3, True)}
    assert all(r.explained == pytest.approx(1 if r.component == 1 else 0, abs=1e-9) and r.identity_error < 1e-9 for r in rows)
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in same)
    none = spark.createDataFrame([(1, None)], "vec_id string, embedding array<float>")
    assert whitening.whiten(none).collect() == [] and whitening.whiten(none).dtypes[0] == ("vec_id", "string")


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1e15, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    big = 1 << 62
    x = [[big + 10**6, 10**6], [-big + 10**6, 10**6 + 64], [64 * 10**15 + 10**6, 10**6 + 128]]
    sums = [sum(c) for c in zip(*x)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    want = {i + 1: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {i: None if w >= 10**38 else w for i, w in want.items()} == {i: None if v is None else int(v) for i, v in got.items()}


def test_exact_arithmetic_in_both_ranges():
    rng = np.random.default_rng(0)
    for scale in (10, 1 << 40, 1 << 61):
        x = rng.integers(-scale, scale, (6, 4))
        c = whitening.centred(x, 1000, [int(s) for s in x.sum(0, dtype=object)])
        want = [[int(v) * 1000 - s for v, s in zip(row, x.sum(0, dtype=object))] for row in x.tolist()]
        assert c.tolist() == want and whitening.squares(c) == [sum(v * v for v in row) for row in want]
