"""SimHash fingerprints and an exact Hamming-radius search over bit planes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, raw_texts, slices, words
from tessel.llm.components import connected_components
from tessel.operators.clustering import forest

SEED = 42
#: Largest number of members of a bucket that one work item compares at once; larger buckets are dealt out as pairs of such chunks.
CHUNK = 1024
#: Planes added between two looks at whether a block is still within the radius.
STRIDE = 8


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, in how many of the hashes it is set."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[k : k + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def shingle_hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `width` words, joined by a space; of the whole sequence if it is shorter."""
    text = b" ".join(tokens)
    if len(tokens) <= width:
        return np.array([xxhash.xxh64_intdigest(text, SEED)] if tokens else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pieces = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(text[s:e], SEED) for s, e in pieces], np.uint64)


def simhash(raw: bytes | None, width: int = 4) -> int:
    """64-bit fingerprint of a text: a bit is 1 if set in over half of the shingle hashes; 0 without words."""
    hashes = shingle_hashes(words(raw), width) if raw else ()
    if not len(hashes):
        return 0
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): one row per input row; a null or empty text has fingerprint 0."""

    def run(batches):
        for batch in slices(batches):
            found = np.array([simhash(t, width) for t in raw_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical store of fingerprints: plane b holds bit b of all of them, 64 to a word; one word of padding follows."""
    n = -(-len(fps) // 64) * 64 + 64
    bits = np.zeros((64, n), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def packed(flags: np.ndarray) -> np.ndarray:
    n = -(-len(flags) // 64) * 64
    out = np.zeros(n, np.uint8)
    out[: len(flags)] = flags
    return np.packbits(out, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, ask: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Of the asked positions i (packed flags), those whose fingerprint differs from that at i + shift in at most `radius` bits.

    64 positions share a word. Differing bits are counted by carry-save adders into bit-sliced
    counters, two planes to an adder step; a word is abandoned once all its asked positions exceed
    the radius.
    """
    depth = radius.bit_length()
    at = np.flatnonzero(ask)
    alive = ask[at]
    off, turn = np.uint64(shift % 64), np.uint64((64 - shift % 64) % 64)
    far, last = at + shift // 64, planes.shape[1] - 1
    sums = [np.zeros(len(at), np.uint64) for _ in range(depth)]
    over = np.zeros(len(at), np.uint64)

    def differing(b: int) -> np.ndarray:
        other = planes[b, np.minimum(far, last)]
        if off:
            other = (other >> off) | (planes[b, np.minimum(far + 1, last)] << turn)
        return planes[b, at] ^ other

    for first in range(0, 64, STRIDE):
        for b in range(first, first + STRIDE, 2):
            x, y = differing(b), differing(b + 1)
            half = sums[0] ^ x
            carry = (sums[0] & x) | (half & y)
            sums[0] = half ^ y
            for k in range(1, depth):
                carry, sums[k] = sums[k] & carry, sums[k] ^ carry
            over |= carry
        beyond, equal = over.copy(), ~np.uint64(0)
        for k in range(depth - 1, -1, -1):  # counter > radius, from its highest bit down
            if radius >> k & 1:
                equal = equal & sums[k]
            else:
                beyond |= equal & sums[k]
                equal = equal & ~sums[k]
        alive = alive & ~beyond
        keep = alive != 0
        if not keep.all():
            at, far, alive, over, sums = at[keep], far[keep], alive[keep], over[keep], [s[keep] for s in sums]
        if not len(at):
            break
    out = np.zeros_like(ask)
    out[at] = alive
    return out


def link_runs(fps: np.ndarray, run: np.ndarray, radius: int) -> np.ndarray:
    """Labels that join, within each run, all fingerprints a chain of links connects. `run` must be sorted.

    Position i is compared with i + 1, i + 2, ... up to the longest run; pairs that are joined already
    need no comparison, so a dense group costs a few passes and never lists its pairs.
    """
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes))  # members from here to the end of the run
    planes = planes_of(fps)
    for shift in range(1, int(sizes.max())):
        if shift % 64 == 1 and (left <= shift).all():
            break
        i = np.flatnonzero(left > shift)
        i = i[label[i] != label[i + shift]]
        if not len(i):
            continue
        flags = np.zeros(n, np.uint8)
        flags[i] = 1
        near = within(planes, packed(flags), shift, radius)
        found = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[:n])
        if len(found):
            parent: dict[int, int] = {}

            def top(x):
                while x in parent:
                    x = parent[x]
                return x

            for a, b in np.unique(np.stack([label[found], label[found + shift]], 1), axis=0).tolist():
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            moved = np.arange(n)
            for x in parent:
                moved[x] = top(x)
            label = moved[label]
    return label


def block_masks(radius: int, n: int) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree on all bits of at least one.

    64 bits are cut into radius + agree blocks, of which at most `radius` can differ, and each choice of
    `agree` blocks is a mask. More agreeing blocks make longer keys, for more fingerprints: the result
    is the same for any choice.
    """
    agree = next((k for k in (2, 3, 4) if n <= 1 << (64 * k // (radius + k) + 6)), 4)
    blocks = radius + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(one[k] for k in chosen) for chosen in combinations(range(blocks), agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_edges(distinct: DataFrame, radius: int, n: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` exactly as all links within the radius do; of each task's, a forest."""
    # the masks are one folded literal, so that the plan and its code stay small for any number of them
    masks = F.split(F.lit(",".join(str(signed(m)) for m in block_masks(radius, n))), ",").cast("array<bigint>")
    keyed = distinct.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", F.col("k").cast("short").alias("k"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    large = (
        keyed.groupBy("k", "key").count().where(F.col("count") > chunk)
        .select("k", "key", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    items = F.when(
        F.col("parts").isNull(), F.array(F.lit(0))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, mine) * F.col("parts") + F.greatest(j, mine)))
    dealt = keyed.join(large, ["k", "key"], "left").select("k", "key", F.explode(items).alias("item"), "fp")
    dealt = dealt.repartition("k", "key", "item").sortWithinPartitions("k", "key", "item", "fp")

    def run(batches):
        rest = None
        for batch in batches:
            part = [np.asarray(batch.column(i)) for i in range(4)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            change = np.flatnonzero((part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]) | (part[2][1:] != part[2][:-1])) + 1
            end = int(change[-1]) if len(change) else 0
            rest = [x[end:] for x in part]
            if end:
                yield from joined(part[3][:end], change[:-1], end)
        if rest is not None and len(rest[0]):
            yield from joined(rest[3], np.zeros(0, np.int64), len(rest[3]))

    def joined(fp, change, n):
        starts = np.r_[0, change].astype(np.int64)
        sizes = np.diff(np.r_[starts, n])
        keep = np.repeat(sizes > 1, sizes)
        fp, run_of = fp[keep], np.repeat(np.arange(len(starts)), sizes)[keep]
        label = link_runs(fp.view(np.uint64), run_of, radius)
        other = np.flatnonzero(label != np.arange(len(label)))
        if len(other):
            yield pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[label[other]])], names=["a", "b"])

    return dealt.mapInArrow(lambda batches: forest(run(batches)), "a long, b long")


def linked(distinct: DataFrame, radius: int) -> DataFrame:
    """(node, root) of the distinct fingerprints `fp` that have another within the radius."""
    return connected_components(link_edges(distinct, radius, distinct.count()), thinned=True)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and near-duplicate component of every row.

    Columns: the id, fingerprint (16 hex digits), component_id (smallest id that links reach). Every row
    of the input gives one row, repeated ids included. Null and empty texts, and texts of white space,
    have fingerprint zero and so form one group with whatever else is within the radius of zero. Rows
    with a null id get the component of their fingerprint, and never name a component (null where no
    other row of the component has an id). Other columns are not read. An empty table gives no rows.

    Equal fingerprints are brought together first, so copies cost one comparison whatever their number.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = linked(distinct.select("fp"), radius)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "root")
    group = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("group_least"))
    named = rooted.join(group, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("group_least")).alias("component_id"))
    return fps.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
