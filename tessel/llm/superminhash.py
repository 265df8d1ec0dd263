"""Near duplicates by SuperMinHash signatures, banding, verification on whole sets, and union of what is linked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import drop_path, raw_texts, slices, store, words
from tessel.llm.components import connected_components
from tessel.llm.simhash import shingle_hashes

WIDTH, SIMILARITY_PERCENT = 3, 85
#: Values of a signature, and those of a band. Sets of similarity 0.85 agree on no band with a chance of (1 - 0.85^4)^32 = 5e-11.
VALUES, BAND = 128, 4
#: Elements whose ranks are worked out at once.
ELEMENTS = 1 << 16
#: Sets, and elements of sets, that one work item holds; larger groups are dealt out.
MEMBERS, MEMBER_ELEMENTS = 1024, 1 << 19
#: Members of a large group that all its work items hold, about.
PIVOTS = 32
#: Rows of a table of classes that is broadcast, at most; more go through a shuffle.
BROADCAST = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: 64 bits that look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, values: int = VALUES) -> np.ndarray:
    """SuperMinHash of many sets at once: (sets, values); elements with the set that holds each.

    An element ranks all positions by a permutation of its own; at the position that its j-th draw names it offers j plus a
    fraction, and each position keeps the least offer. Draws go round by round over all elements. After round j all later offers are
    j + 1 at least, so a set whose positions are all below that stops. A set without elements keeps the largest value.
    """
    best = np.full(sets * values, ~np.uint64(0))
    own, base, order = elements, owner.astype(np.int64) * values, None
    for j in range(values):
        if not len(own):
            break
        draw = mixed(own + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = (j + ((draw >> np.uint64(32)) * np.uint64(values - j) >> np.uint64(32)).astype(np.int64)) if j else ((draw >> np.uint64(32)) * np.uint64(values) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(own))
        place = pick if order is None else order[row, pick].astype(np.int64)
        np.minimum.at(best, base + place, np.uint64(j) << np.uint64(32) | draw & np.uint64(0xFFFFFFFF))
        open_ = best.reshape(sets, values).max(1) >= np.uint64(j + 1) << np.uint64(32)
        going = open_[base // values]
        if order is None:
            order = np.broadcast_to(np.arange(values, dtype=np.int16), (int(going.sum()), values)).copy()
        else:
            order[row, pick] = order[:, j]
            order = order[going]
        own, base, pick = own[going], base[going], pick[going]
        if j == 0:
            order[np.arange(len(own)), pick] = 0  # what stood first goes where the draw was
    return best.reshape(sets, values)


def bands(signature: np.ndarray, size: int = BAND) -> np.ndarray:
    """(sets, bands): a key for each run of `size` values; runs at different places give different keys."""
    parts = signature.reshape(len(signature), -1, size)
    key = np.broadcast_to(mixed(np.arange(1, parts.shape[1] + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(size):
        key = mixed(key ^ parts[:, :, k])
    return key


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, s1, s2, t, keys): size and 128-bit name of each row's set, a hash of its text, and band keys (none for an empty set)."""

    def run(batches):
        for batch in slices(batches):
            found = [np.unique(shingle_hashes(words(t or b""), width)) for t in raw_texts(batch.column(1))]
            sizes = np.array([len(x) for x in found], np.int64)
            names = np.array([divmod(xxhash.xxh3_128_intdigest(x.tobytes()), 1 << 64) for x in found], np.uint64).reshape(-1, 2)
            keys, at = [np.zeros(0, np.uint64)], 0
            while at < len(found):
                end, room = at + 1, ELEMENTS - sizes[at]
                while end < len(found) and sizes[end] <= room:
                    room -= sizes[end]
                    end += 1
                own = signatures(np.concatenate(found[at:end]), np.repeat(np.arange(end - at), sizes[at:end]), end - at)
                keys.append(bands(own)[sizes[at:end] > 0].ravel())
                at = end
            per = np.where(sizes > 0, VALUES // BAND, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *(pa.array(names[:, k].view(np.int64)) for k in (0, 1)), batch.column(2), lists], names=["id", "n", "s1", "s2", "t", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, t long, keys array<long>")


class Overlaps:
    """Sets of one work item. One is compared with many at once: its elements are marked and counted in the others."""

    def __init__(self, sets: list[np.ndarray], percent: float):
        self.percent, self.sizes = percent, np.array([len(x) for x in sets], np.int64)
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.marked = np.zeros(len(self.flat) and int(self.flat.max()) + 1, bool)

    def near(self, i: int, j: np.ndarray) -> np.ndarray:
        """Of the sets j, those with 100 * common >= percent * all elements of both; none if either is empty."""
        size, sizes = self.sizes[i], self.sizes[j]
        fits = (sizes > 0) & (100 * np.minimum(sizes, size) >= self.percent * np.maximum(sizes, size))
        j, sizes = j[fits], sizes[fits]
        if not len(j) or not size:
            return j[:0]
        mine = self.flat[self.starts[i] : self.starts[i] + size]
        self.marked[mine] = True
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[j] - (ends - sizes), sizes)
        common = np.add.reduceat(self.marked[self.flat[at]], ends - sizes, dtype=np.int64)
        self.marked[mine] = False
        return j[100 * common >= self.percent * (sizes + size - common)]


def linked(sets: list[np.ndarray], label: np.ndarray, percent: float) -> np.ndarray:
    """Labels after joining all sets that are near each other. Sets that share a label need no comparison, so that a dense group costs a
    few passes."""
    label, own = label.copy(), Overlaps(sets, percent)
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        near = np.unique(label[own.near(i, j[label[j] != label[i]])])
        if len(near):
            label[np.isin(label, near)] = label[i]
    return label


def led(sets: list[np.ndarray], percent: float) -> np.ndarray:
    """Which sets are near an earlier one that is not led itself."""
    out, own = np.zeros(len(sets), bool), Overlaps(sets, percent)
    for i in range(len(sets) - 1):
        if not out[i]:
            j = np.arange(i + 1, len(sets))
            out[own.near(i, j[~out[j]])] = True
    return out


def _small(frame: DataFrame) -> DataFrame:
    """A stored table of few bytes a row, broadcast if its size allows."""
    return F.broadcast(frame) if frame.count() <= BROADCAST else frame


def work_items(docs: DataFrame, text_col: str, members: DataFrame) -> DataFrame:
    """(item, node, label, text) by item, in order, for members (t, node, label, items): texts go to the items by the hash t of the text.
    A task sends each node once, however many copies of its text it reads."""

    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for k, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    texts = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    held = texts.join(_small(members), "t").select("node", "label", "items", "text")
    sent = held.mapInArrow(once, "node long, label long, items array<string>, text string")
    return sent.select(F.explode("items").alias("item"), "node", "label", "text").repartition("item").sortWithinPartitions("item", "node")


def item_sets(batches, width: int):
    """(nodes, labels, sets of shingles) of each work item with two members at least."""
    item, nodes, labels, sets = None, [], [], []
    for batch in slices(batches):
        for at, node, label, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), raw_texts(batch.column(3))):
            if at != item:
                if len(nodes) > 1:
                    yield nodes, labels, sets
                item, nodes, labels, sets = at, [], [], []
            if not nodes or node != nodes[-1]:
                nodes.append(node)
                labels.append(label)
                sets.append(np.unique(shingle_hashes(words(raw or b""), width)))
    if len(nodes) > 1:
        yield nodes, labels, sets


def _link_items(docs: DataFrame, text_col: str, members: DataFrame, width: int, percent: float) -> DataFrame:
    """Links (a, b) among the members of each work item that connect them just as all links between them do."""

    def run(batches):
        for nodes, labels, sets in item_sets(batches, width):
            first: dict[int, int] = {}
            start = np.array([first.setdefault(x, k) for k, x in enumerate(labels)])
            end = linked(sets, start, percent)
            other = [k for k in range(len(nodes)) if end[k] != k and end[k] != start[k]]
            if other:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in other], pa.int64()), pa.array([nodes[end[k]] for k in other], pa.int64())], names=["a", "b"])

    return work_items(docs, text_col, members).mapInArrow(run, "a long, b long")


def dealt_out(members: DataFrame, pairs: bool) -> DataFrame:
    """Members (t, n, node, root, label) with the work items of each and the parts of its group. A group is cut into parts by a hash: an item is
    a part with some pivots of the whole group, so that what all parts are like is joined across them, or a pair of parts."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    parts = sizes.select("root", "size", F.greatest(F.ceil(F.col("size") / MEMBERS), F.ceil(F.col("n") / MEMBER_ELEMENTS)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    name = lambda *x: F.concat_ws("/", "root", *x)
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    if pairs:
        items = F.transform(every, lambda k: name(F.least(k, own), F.greatest(k, own)))
    else:
        items = F.when(F.pmod(F.xxhash64(F.lit(1), "node"), F.col("size")) < PIVOTS, F.transform(every, lambda k: name(k))).otherwise(F.array(name(own)))
    return members.join(parts, "root").select("t", "node", "label", items.alias("items"), "root", "parts")


def _named(links: DataFrame) -> DataFrame:
    """(node, root) of links that lead straight to the name of their group."""
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Group of every row: the id, n_shingles, component_id (smallest id that links reach), kept.

    Equal sets of shingles are one class. Classes that share a band of their SuperMinHash signatures, directly or by a
    chain, make a group; within it all classes are compared on their whole sets unless links join them already. A group beyond one work item is
    dealt out in parts, each with the same few pivots, and then in pairs of parts, of which only classes go that still share a band with
    a class they are not joined with.

    Every input row gives one row, repeated rows and ids included. Null and empty texts, and texts of white space, have 0 shingles
    and are linked with nothing, not even each other: component_id is their own id. Rows with a null id belong to the component of
    their class but never name it; kept is false for them where the component has an id, and true where it has none. Other columns are not read. An
    empty table gives no rows. Shingles are told by 64 bits of hash, sets by 128: two shingles of one pair of texts coincide below one in 10^9.
    """
    spark = docs.sparkSession
    rows, _ = store(_sets(docs, id_col, text_col, width), "sets")
    classes, classes_path = store(
        rows.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("least"), F.min("t").alias("t"), F.max("n").alias("n"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
    stars = keyed.join(shared, "key").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = connected_components(stars)
    grouped = classes.join(_small(groups), "node").select("node", "root", "t", "n", "keys", F.col("node").alias("label"))
    members, members_path = store(grouped, "members")
    dealt, dealt_path = store(dealt_out(members, False), "dealt")
    links, links_path = store(_link_items(docs, text_col, dealt, width, percent), "links")
    paths = [classes_path, members_path, dealt_path, links_path]
    large = dealt.where("parts > 1").select("node")
    if large.isEmpty():
        roots = _named(links)
    else:
        # an item's names hold for the whole group where it is one item; others meet in components
        apart = _small(large)
        whole = _named(links.join(apart, links.a == apart.node, "left_anti"))
        across = links.join(apart, links.a == apart.node, "left_semi")
        found = connected_components(across)
        label = F.coalesce("root", "node").alias("label")
        named = members.drop("label", "root").join(found, "node", "left").select("node", label, F.explode("keys").alias("key"))
        mixed_keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        open_nodes = named.join(mixed_keys, "key", "left_semi").select("node", "label").distinct().join(apart, "node", "left_semi")
        left, left_path = store(members.drop("label", "keys").join(open_nodes, "node"), "members")
        paired, paired_path = store(dealt_out(left, True), "dealt")
        more, more_path = store(_link_items(docs, text_col, paired, width, percent), "links")
        paths += [left_path, paired_path, more_path]
        roots = whole.unionAll(found if more.isEmpty() else connected_components(across.unionAll(more)))
    rooted = classes.select("s1", "s2", "node", "least").join(roots, "node", "left")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("group_least"))
    names, _ = store(rooted.join(least, "root", "left").select("s1", "s2", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("group_least")).alias("component_id")), "names")
    for path in paths:
        drop_path(spark, path)
    out = rows.select("id", "n", "s1", "s2").join(names, ["s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
