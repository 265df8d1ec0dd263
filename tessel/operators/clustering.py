"""Clusters of the remainder: devices, matches and households of each geo."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators.propagation import collapse, named_by_least, propagate
from tessel.session import Rounds, materialise

#: Most uids of a device, devices of a preliminary household, devices of a match, matches of a household.
DEVICE, PRELIMINARY, MATCH, HOUSEHOLD = 5, 50, 10_000, 100
SELF_WEIGHT, THRESHOLD, PASSES = 1e-5, 1e-6, 100
EDGES_PER_TASK = 250_000
#: Nodes that a task's forest holds before it is sent on.
FOREST = 1 << 19
#: Edges of a round of components that one task takes at least, where there are more tasks than LEAST_TASKS.
LINKS_PER_TASK, LEAST_TASKS = 1 << 16, 12

Edges = dict[tuple, tuple[float, bool]]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges that a task holds, as few as connect the same nodes: each node with the least that it reaches through them."""
    top: dict = {}

    def find(x):
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    def flush():
        ends = [(x, find(x)) for x in top]
        pairs = [(x, y) for x, y in ends if x != y]
        top.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                top[max(x, y)] = top.setdefault(min(x, y), min(x, y))
        if len(top) >= FOREST:
            yield flush()
    if top:
        yield flush()


def components(edges: DataFrame, thinned: bool = False) -> DataFrame:
    """(node, root) of edges (a, b): root is the smallest node that links reach. Nodes are of any type with an order.

    Each task first keeps a forest of its edges only (nodes that are structs go as they are, and so do edges that are `thinned`: that went
    through forest() in the Python operator that made them, as a task of two such operators takes two workers). Then, in each round, neighbours greater than a node
    move to its smallest neighbour, and each node points to its smallest, until every node points straight to its root. Rounds grow with
    the logarithm of the longest path. Smallest neighbours are combined before they are shuffled and meet the edges in joins,
    which adaptive execution can split where one node has very many neighbours. Rounds of few edges take few tasks: partitions of a shuffle
    are read together, by the number of edges, which no round raises. Self edges, repeated edges and nulls do not matter.
    """
    rounds = Rounds(edges.sparkSession)
    links = edges.where("a <> b").select("a", "b")
    if not thinned and not isinstance(links.schema["a"].dataType, T.StructType):
        links = links.mapInArrow(forest, links.schema)
    links = rounds.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges_left = links.count()
    while True:
        tasks = max(LEAST_TASKS, -(-edges_left // LINKS_PER_TASK))
        ends = F.inline(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        counted = links.select(ends).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(tasks)
        edges_left, open_nodes = counted.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 OR up + down > 1"))).first()
        if not open_nodes:
            break  # whatever points somewhere points to one node, which points nowhere
        ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = ends.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        low = moved.groupBy("a").agg(F.min("b").alias("m"))
        pulled = moved.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = rounds.keep(pulled.coalesce(tasks).unionAll(low.select("a", F.col("m").alias("b")).coalesce(tasks)).distinct().coalesce(tasks))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def neighbours(edges: Edges) -> tuple[dict, dict]:
    """Weights to other nodes, and the incident weight of each node (a self edge counts once)."""
    near, incident = defaultdict(dict), defaultdict(float)
    for (a, b), (w, _) in edges.items():
        incident[a] += w
        near[a]
        if a != b:
            near[a][b] = near[b][a] = w
            incident[b] += w
    return near, incident


def propagate_labels(edges: Edges, limit: int, start: dict | None = None) -> dict:
    """Label of each node. A node moves where weight * (1 - (size / limit)^2) is greatest, if that beats staying; nodes of little weight come first."""
    near, incident = neighbours(edges)
    label = {n: start[n] if start else n for n in near}
    size = defaultdict(int)
    for c in label.values():
        size[c] += 1
    order = sorted(near, key=lambda n: (incident[n], n))
    worth = lambda w, n: w * (1 - (n / limit) ** 2)
    for _ in range(PASSES):
        moved = False
        for n in order:
            pull, own = defaultdict(float), label[n]
            for m, w in near[n].items():
                pull[label[m]] += w
            stay = worth(pull.pop(own, 0.0), size[own] - 1)
            score, neg = max(((worth(w, size[c]), c) for c, w in pull.items() if size[c] < limit), default=(-math.inf, None))
            if score > stay + THRESHOLD:
                size[own] -= 1
                size[neg] += 1
                label[n], moved = neg, True
        if not moved:
            break
    return label


def collapsed(edges: Edges, node: dict, keep_conflicts: bool) -> Edges:
    """Edges between groups: weights add up and conflicts are combined; edges inside a group become one of a tiny weight."""
    out: Edges = {}
    for (a, b), (w, conflict) in edges.items():
        x, y = sorted((node[a], node[b]))
        if x == y:
            out[x, x] = (SELF_WEIGHT, False)
        else:
            known = out.get((x, y), (0.0, False))
            out[x, y] = (known[0] + w, known[1] or (keep_conflicts and conflict))
    return out


def modularity_communities(edges: Edges, limit: int = MATCH) -> dict:
    """Community of each node by greedy modularity, level by level. Nodes of a direct conflict never share one."""
    where = {n: n for pair in edges for n in pair}
    level, members = dict(edges), dict.fromkeys(where, 1)
    while True:
        near, incident = neighbours(level)
        inner = {a: w for (a, b), (w, _) in level.items() if a == b}
        degree = {n: incident[n] + inner.get(n, 0.0) for n in near}
        double = sum(degree.values())
        foes = defaultdict(set)
        for (a, b), (_, conflict) in level.items():
            if conflict:
                foes[a].add(b)
                foes[b].add(a)
        label, total, count = {n: n for n in near}, dict(degree), {n: members[n] for n in near}
        changed = False
        for _ in range(PASSES):
            moved = False
            for n in sorted(near, key=lambda n: (incident[n], n)):
                own, pull = label[n], defaultdict(float)
                for m, w in near[n].items():
                    pull[label[m]] += w
                total[own] -= degree[n]
                count[own] -= members[n]
                shut = {label[m] for m in foes[n]}
                gain = lambda c: pull.get(c, 0.0) - degree[n] * total[c] / double if double else 0.0
                best, most = own, gain(own) + THRESHOLD
                for c in sorted(pull):
                    if c != own and c not in shut and count[c] + members[n] <= limit and gain(c) > most:
                        best, most = c, gain(c)
                total[best] += degree[n]
                count[best] += members[n]
                if best != own:
                    label[n], moved, changed = best, True, True
            if not moved:
                break
        if not changed:
            return where
        where = {n: label[c] for n, c in where.items()}
        members = {c: k for c, k in count.items() if k}
        weights: Edges = {}
        for (a, b), (w, conflict) in level.items():  # unlike collapsed(), inner weights stay: modularity counts them
            x, y = sorted((label[a], label[b]))
            known = weights.get((x, y), (0.0, False))
            weights[x, y] = (known[0] + (2 * w if x == y and a != b else w), known[1] or (conflict and x != y))
        level = weights


def cluster(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(uid, device_id, match_id, household_id) for edges (uid1, uid2, weight, same, diff). A group is named by its smallest uid; match 0 is
    a device of one uid alone, household 0 a match alone. Repeated edges add up."""
    edges: Edges = {}
    same: Edges = {}
    for a, b, w, is_same, is_diff in rows:
        pair = (min(a, b), max(a, b))
        known = edges.get(pair, (0.0, False))
        edges[pair] = (known[0] + w, known[1] or bool(is_diff))
        if is_same:
            same[pair] = (same.get(pair, (0.0, False))[0] + w, False)
    device = {n: n for pair in edges for n in pair} | named(propagate_labels(same, DEVICE))
    devices = collapsed(edges, device, True)
    rough = propagate_labels(devices, PRELIMINARY)
    inside = defaultdict(dict)
    for (a, b), e in devices.items():
        if rough[a] == rough[b]:
            inside[rough[a]][a, b] = e
    match = {d: d for pair in devices for d in pair}
    for own in inside.values():
        match |= named(modularity_communities(own))
    matches = collapsed(devices, match, False)
    house = propagate_labels(matches, HOUSEHOLD, {m: rough[d] for d, m in match.items()})
    house = named(house)
    uids, parts, homes = defaultdict(int), defaultdict(set), defaultdict(set)
    for u, d in device.items():
        uids[d] += 1
        parts[match[d]].add(d)
        homes[house[match[d]]].add(match[d])
    out = []
    for u, d in sorted(device.items()):
        m, h = match[d], house[match[d]]
        alone = len(parts[m]) == 1 and uids[d] == 1
        out.append((u, d, 0 if alone else m, 0 if len(homes[h]) == 1 else h))
    return out


def named(label: dict) -> dict:
    """The same groups, each named by its smallest member."""
    least: dict = {}
    for n, c in label.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in label.items()}


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (x, y, weight, same, diff) between whole numbers instead of uids of geos, and the numbers' table (id, geo, uid); both stored. Numbers begin
    at 1 and follow the order of geos and uids, so that ties go as they would. Rounds shuffle and sort them faster than structs."""
    end = lambda k: F.struct(F.col("geo").cast("string").alias("geo"), F.col(f"uid{k}").alias("uid"))
    both = edges.select(end(1).alias("a"), end(2).alias("b"), "weight", "same", "diff")
    nodes = both.select(F.col("a").alias("n")).unionAll(both.select(F.col("b").alias("n"))).distinct()
    ids = materialise(nodes.repartitionByRange("n").sortWithinPartitions("n").select("n", (F.monotonically_increasing_id() + 1).alias("id")))
    number = lambda k, name: ids.select(F.col("n").alias(k), F.col("id").alias(name))
    numbered = materialise(both.join(number("a", "x"), "a").join(number("b", "y"), "b").select("x", "y", "weight", "same", "diff"))
    return numbered, ids.select("id", "n.geo", "n.uid")


def _as_uids(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(geo, uid, device_id, match_id, household_id) of a clustering of numbers; 0 stays 0."""
    out = found.join(ids.withColumnRenamed("id", "n"), "n")
    for c in ("device", "match", "household"):
        out = out.join(ids.select(F.col("id").alias(c), F.col("uid").alias(f"{c}_id")), c, "left")
    return out.select("geo", "uid", *[F.coalesce(f"{c}_id", F.lit(0)).cast("long").alias(f"{c}_id") for c in ("device", "match", "household")])


def _matches(edges: DataFrame, tasks: int) -> DataFrame:
    """(n, label): match of each device by greedy modularity within its preliminary household. edges (rough, a, b, w, conflict) lie inside one,
    which holds 50 devices at most, so that each is a small problem of its own; a task takes many of them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, labels = [], []
        ends = frame.sort_values(["rough", "a", "b"])
        cuts = [0, *((ends["rough"].to_numpy()[1:] != ends["rough"].to_numpy()[:-1]).nonzero()[0] + 1).tolist(), len(ends)]
        rows = [ends[c].tolist() for c in ("a", "b", "w", "conflict")]
        for at, end in zip(cuts, cuts[1:]):
            found = named(modularity_communities({(x, y): (w, c) for x, y, w, c in zip(*(r[at:end] for r in rows))}))
            nodes += found
            labels += found.values()
        return pd.DataFrame({"n": nodes, "label": labels})

    return edges.withColumn("bucket", F.pmod(F.xxhash64("rough"), F.lit(tasks))).groupBy("bucket").applyInPandas(run, "n long, label long")


def cluster_large(edges: DataFrame) -> DataFrame:
    """G17, X10 for components of any size: (geo, uid, device_id, match_id, household_id) of edges (geo, uid1, uid2, weight, same, diff), none null.

    Devices, preliminary and final households are communities of bulk rounds (propagation.py), matches are found within
    preliminary households. The same limits and conflicts hold as in cluster(), and the same rules decide a move; but all nodes move at once, where
    cluster() moves one after the other, so that another labelling of equal standing may come out.
    """
    numbered, ids = _numbered(edges)
    return _as_uids(_clustered_large(numbered), ids)


def _clustered_large(edges: DataFrame) -> DataFrame:
    """(n, device, match, household) of edges (x, y, weight, same, diff); match and household may be 0."""
    ordered = edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("weight").alias("w"), "same", F.col("diff").alias("conflict"))
    known = materialise(ordered.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("same"), F.col("w"))).alias("same_w"), F.max("conflict").alias("conflict")))
    uids = known.select(F.col("a").alias("n")).unionAll(known.select(F.col("b").alias("n"))).distinct()
    of_same = named_by_least(propagate(known.where("same_w IS NOT NULL").select("a", "b", F.col("same_w").alias("w")), DEVICE))
    device = materialise(uids.join(of_same, "n", "left").select("n", F.coalesce("label", "n").alias("label")))
    devices = materialise(collapse(known, device, SELF_WEIGHT, True))
    rough = materialise(propagate(devices, PRELIMINARY))
    home = lambda k: rough.select(F.col("n").alias(k), F.col("label").alias(f"{k}_home"))
    inside = devices.join(home("a"), "a").join(home("b"), "b").where("a_home = b_home").select(F.col("a_home").alias("rough"), "a", "b", "w", "conflict")
    found = _matches(inside, max(LEAST_TASKS, math.ceil(devices.count() / LINKS_PER_TASK)))
    match = materialise(rough.select("n").join(found, "n", "left").select("n", F.coalesce("label", "n").alias("label")))
    matches = materialise(collapse(devices, match, SELF_WEIGHT, False))
    start = match.join(rough.withColumnRenamed("label", "home"), "n").groupBy("label").agg(F.max("home").alias("home")).select(F.col("label").alias("n"), F.col("home").alias("label"))
    house = named_by_least(propagate(matches, HOUSEHOLD, start))
    sizes = lambda frame, name: frame.groupBy("label").agg(F.count("*").alias(name))
    of_device = sizes(device, "uids").withColumnRenamed("label", "device")
    of_match = match.join(sizes(match, "devices"), "label").select(F.col("n").alias("device"), F.col("label").alias("match"), "devices")
    of_house = house.join(sizes(house, "matches"), "label").select(F.col("n").alias("match"), F.col("label").alias("house"), "matches")
    rows = device.withColumnRenamed("label", "device").join(of_device, "device").join(of_match, "device").join(of_house, "match")
    return rows.select(
        "n", "device", F.when((F.col("devices") == 1) & (F.col("uids") == 1), F.lit(0)).otherwise(F.col("match")).cast("long").alias("match"),
        F.when(F.col("matches") == 1, F.lit(0)).otherwise(F.col("house")).cast("long").alias("household"))


def cluster_geos(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(geo, uid, device_id, match_id, household_id) for every uid of edges (geo, uid1, uid2, weight, same, diff); uids are long.

    No step looks beyond a connected component, so that geos are dealt out by components, about `edges_per_task` edges to a task, and the
    result is that of the whole geo. Components of more edges than that are clustered as in cluster_large(). Null flags are false. Edges
    with a null uid or weight hold no evidence.
    """
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("same", "diff")]
    known = edges.where("uid1 IS NOT NULL AND uid2 IS NOT NULL AND weight IS NOT NULL").select("geo", "uid1", "uid2", F.col("weight").cast("double").alias("weight"), *flags)
    numbered, ids = _numbered(known)
    roots = components(numbered.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "x")
    tasks = max(1, math.ceil(numbered.count() / edges_per_task))
    rooted = materialise(numbered.join(roots, "x", "left").withColumn("root", F.coalesce("root", "x")))
    large = materialise(rooted.groupBy("root").count().where(F.col("count") > edges_per_task).select("root"))
    dealt = rooted.join(large, "root", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(tasks)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["x", "y", "weight"])[["x", "y", "weight", "same", "diff"]].itertuples(index=False, name=None)
        return pd.DataFrame(cluster(list(rows)), columns=["n", "device", "match", "household"])

    out = dealt.groupBy("bucket").applyInPandas(run, "n long, device long, match long, household long")
    if not large.isEmpty():
        out = out.unionAll(_clustered_large(rooted.join(large, "root", "left_semi").drop("root")))
    return _as_uids(out, ids)
