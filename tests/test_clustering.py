"""The clusters of a worked example, of single edges, and what holds for any edges."""

import random
from collections import Counter, defaultdict

from tessel.operators import clustering
from tessel.operators.clustering import cluster, cluster_geos, cluster_large, components

# The one published answer of this algorithm, whose program is not public; edges and answer must stay as they are.
EXAMPLE = [
    (1, 2, 10.0, True, False), (1, 3, 4.0, False, False), (2, 3, 3.0, False, False), (4, 5, 10.0, True, False), (4, 6, 6.0, False, False), (3, 4, 1.0, False, False),
    (7, 8, 10.0, True, False), (7, 9, 2.0, False, True), (10, 11, 10.0, True, False), (10, 12, 3.0, False, True), (1, 7, 0.25, False, False),
]
ANSWER = {
    (1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 1, 1), (4, 4, 4, 1), (5, 4, 4, 1), (6, 6, 4, 1), (7, 7, 7, 7), (8, 7, 7, 7), (9, 9, 0, 7), (10, 10, 10, 10), (11, 10, 10, 10), (12, 12, 0, 10),
}


def random_edges(seed, n=120):
    draw = random.Random(seed)
    return [(*draw.sample(range(1, n), 2), float(draw.randint(1, 9)), draw.random() < 0.3, draw.random() < 0.2) for _ in range(n)]


def test_worked_example():
    assert set(cluster(EXAMPLE)) == ANSWER


def test_single_edges():
    assert cluster([(1, 2, 1.0, True, False)]) == [(1, 1, 1, 0), (2, 1, 1, 0)]
    assert cluster([(1, 2, 1.0, False, False)]) == [(1, 1, 1, 0), (2, 2, 1, 0)]
    assert cluster([(1, 2, 1.0, False, True)]) == [(1, 1, 0, 1), (2, 2, 0, 1)]
    assert cluster([]) == []


def test_limits_and_conflicts_hold():
    for seed in range(20):
        edges = random_edges(seed, 60)
        found = {u: (d, m, h) for u, d, m, h in cluster(edges)}
        assert set(found) == {u for e in edges for u in e[:2]}
        assert max(Counter(d for d, _, _ in found.values()).values()) <= 5
        by_device = defaultdict(set)
        for d, m, h in found.values():
            by_device[d].add((m, h))
        assert all(len(x) == 1 for x in by_device.values())
        for a, b, _, _, conflict in edges:
            if conflict and found[a][0] != found[b][0]:
                assert found[a][1] != found[b][1] or found[a][1] == 0


def test_geos_are_apart_and_components_can_be_dealt(spark):
    rows = [("x", *e) for e in EXAMPLE] + [("y", *e) for e in EXAMPLE[:3]] + [("z", *e) for e in random_edges(5)] + [("z", 500, 500, 1.0, False, False), (None, 1, 2, 1.0, True, None)]
    frame = spark.createDataFrame(rows, "geo string, uid1 long, uid2 long, weight double, same boolean, diff boolean")
    want = {(g, *r) for g in ("x", "y", "z", None) for r in cluster([e[1:] for e in rows if e[0] == g])}
    for per_task in (500, 1_000):
        assert {tuple(r) for r in cluster_geos(frame, per_task).collect()} == want
    assert cluster_geos(frame.limit(0)).collect() == []


SCHEMA = "geo string, uid1 long, uid2 long, weight double, same boolean, diff boolean"


def test_worked_example_in_bulk_rounds(spark):
    rows = [(g, *e) for g in ("x", None) for e in EXAMPLE]
    assert {tuple(r) for r in cluster_large(spark.createDataFrame(rows, SCHEMA)).collect()} == {(g, *r) for g in ("x", None) for r in ANSWER}


def check_limits(edges, found):
    """Every uid once, no group beyond its limit, groups nested, and no two devices of a conflict in one match."""
    of = {(g, u): (d, m, h) for g, u, d, m, h in found}
    assert len(of) == len(found) and set(of) == {(e[0], u) for e in edges for u in e[1:3]}
    device, up = Counter((g, d) for (g, _), (d, _, _) in of.items()), defaultdict(set)
    assert max(device.values()) <= 5
    for (g, _), (d, m, h) in of.items():
        up[g, "d", d].add((m, h))
        up[g, "m", m].add(h)
    assert all(len(x) == 1 for k, x in up.items() if k[1] == "d" or k[2])
    houses = defaultdict(set)
    for (g, u), (d, m, h) in of.items():
        houses[g, h].add(m or -d)
    assert max((len(x) for (_, h), x in houses.items() if h), default=0) <= 100
    for g, a, b, _, _, conflict in edges:
        x, y = of[g, a], of[g, b]
        assert not conflict or x[0] == y[0] or x[1] != y[1] or x[1] == 0


def test_large_components_keep_limits_and_conflicts(spark):
    edges = [("a", *e) for e in random_edges(1, 150)] + [("b", 0, k, 1.0 + k % 3, k % 2 == 0, k % 7 == 0) for k in range(1, 160)] + [(None, k, k + 1, 1.0, True, False) for k in range(40)]
    frame = spark.createDataFrame(edges, SCHEMA)
    check_limits(edges, [tuple(r) for r in cluster_geos(frame, 20).collect()])


def test_bulk_rounds_are_as_good_as_single_moves(spark):
    """Weight inside devices and matches is about that of the task-local way."""
    edges = [("z", *e) for e in random_edges(3, 250)]
    inside = lambda of, k: sum(e[3] for e in edges if of[e[1]][k] == of[e[2]][k] != 0)
    plain = {u: g for u, *g in cluster([e[1:] for e in edges])}
    bulk = {r.uid: tuple(r)[2:] for r in cluster_large(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert all(inside(bulk, k) > 0.9 * inside(plain, k) for k in range(3))


def test_components(spark):
    rows = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 300), (7, 7)]
    found = {tuple(r) for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {(k, 0) for k in range(51)} | {(100, 100), (200, 100), (300, 100)}


def test_rounds_see_whole_numbers_in_the_order_of_geos_and_uids(spark, monkeypatch):
    """Structs of geo and uid are numbered once, before components and rounds; no round shuffles or sorts them."""
    kinds = []

    def noted(edges, *_):
        kinds.append(edges.schema["a"].dataType.simpleString())
        return edges.selectExpr("inline(array(struct(a AS n), struct(b AS n)))").distinct().selectExpr("n", "n AS label")

    real = clustering.components
    monkeypatch.setattr(clustering, "components", lambda edges: kinds.append(edges.schema["a"].dataType.simpleString()) or real(edges))
    monkeypatch.setattr(clustering, "propagate", noted)
    rows = [("b", 3, 9, 1.0, True, False), ("b", 9, 4, 1.0, False, False), ("a", 7, 5, 1.0, False, True), (None, 0, 9, 1.0, False, False)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = cluster_geos(frame, 1)
    assert kinds == ["bigint"] * 4
    assert {tuple(r)[:3] for r in found.collect()} == {("b", 3, 3), ("b", 9, 9), ("b", 4, 4), ("a", 7, 7), ("a", 5, 5), (None, 0, 0), (None, 9, 9)}
    _, ids = clustering._numbered(frame)
    order = [(r.geo, r.uid) for r in ids.orderBy("id").collect()]
    assert order == sorted(order, key=lambda n: (n[0] is not None, n[0] or "", n[1])) and len(order) == 7
