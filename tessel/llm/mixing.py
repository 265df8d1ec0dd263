"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.llm.common import cut, word_count

#: Members of a group of the reduction tree, about.
FAN = 64
#: Most sources whose table is broadcast; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: Repeated rows that one record stands for while they are told apart; more are dealt out in such chunks.
CHUNK = 4096
#: Repeated rows that are numbered in one place.
NUMBERED = 100_000


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """Targets of (source, source_size): weights repeat over the sources in code-point order, null last.

    `share` of all sizes is dealt by weight; a target stops at `cap` times its source's size and the rest is
    dealt again by weight. That fixed point is a water level: sources are taken by rising cap per weight, and
    the first whose cap lies above the level, if all before it stop at theirs, sets it for the rest.
    """
    one = sizes.select("source", "source_size", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("n", F.lit(len(weights))) + 1).cast("int"))
    one = one.select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("most"))
    rising = W.orderBy(F.col("most") / F.col("weight"), "n")
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * float(share) - before) / rest
    found = one.withColumn("level", level).withColumn("open", F.col("most") >= F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("n"), F.col("level").alias("level")))).over(everything)
    return found.withColumn("level", first.getField("level")).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target")
    )


def uniform(*cols) -> Column:
    """A number in (0, 1) that only depends on the columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _state(p: Column, e: Column) -> Column:
    return F.struct(p.alias("p"), e.alias("e"))


def _pivot(a: Column, b: Column, u: Column) -> tuple[Column, Column]:
    """One transfer between two units with probabilities p and masses w: the sum of p * w stays, so do both expectations,
    and one p becomes 0 or 1. Returns both p."""
    pa, pb, wa, wb = a["p"], b["p"], a["e"]["w"], b["e"]["w"]
    up, down = F.least(1 - pa, pb * wb / wa), F.least(pa, (1 - pb) * wb / wa)
    rise = u * (up + down) < down
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    full, empty = (1 - pa) * wa <= pb * wb, pa * wa <= (1 - pb) * wb
    a_new = F.when(rise, F.when(full, 1.0).otherwise(clip(pa + up))).otherwise(F.when(empty, 0.0).otherwise(clip(pa - down)))
    b_new = F.when(rise, F.when(full, clip(pb - up * wa / wb)).otherwise(0.0)).otherwise(F.when(empty, clip(pb + down * wa / wb)).otherwise(1.0))
    return a_new, b_new


def _fold(units: DataFrame, groups: DataFrame | None, salt: int, seed: int, few: bool) -> DataFrame:
    """Deal units into `groups` per stratum (one, if None) and fold each by transfers between its carried unit and the next, from the
    heaviest down. Stored with columns stratum, f.out (settled units) and f.at (the unit that is left)."""
    if groups is None:
        dealt = units.withColumn("g", F.lit(0).cast("long"))
    else:
        dealt = units.join(F.broadcast(groups) if few else groups, "stratum").withColumn("g", F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.col("groups")))
    member = F.struct(F.col("p"), F.struct("w", "id", "extra").alias("e"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), F.col("id").alias("i"), member.alias("m"))))
    rows = F.transform("all", lambda x: x["m"])

    def step(acc, x):
        a, b = acc["at"], x
        a_new, b_new = _pivot(a, b, uniform(F.lit(seed), F.lit(salt), a["e"]["id"], b["e"]["id"]))
        settled = (a_new == 0.0) | (a_new == 1.0)
        out = _state(F.when(settled, a_new).otherwise(b_new), F.when(settled, a["e"]).otherwise(b["e"]))
        keep = _state(F.when(settled, b_new).otherwise(a_new), F.when(settled, b["e"]).otherwise(a["e"]))
        return F.struct(F.concat(acc["out"], F.array(out)).alias("out"), keep.alias("at"))

    start = F.struct(F.slice(rows, 1, 0).alias("out"), F.element_at(rows, 1).alias("at"))
    rest = F.slice(rows, 2, F.greatest(F.size("all") - 1, F.lit(0)))
    return cut(dealt.groupBy("stratum", "g").agg(ordered.alias("all")).select("stratum", F.aggregate(rest, start, step).alias("f")))


def round_units(units: DataFrame, fan: int = FAN, seed: int = 0) -> DataFrame:
    """(stratum, id, w, extra, take): each unit's probability p becomes 0 or 1.

    `units`: stratum int, id struct, w double > 0, p double in [0, 1], extra struct. Within a stratum the total of
    take * w equals the total of p * w up to one unit, and each unit is taken with probability p. Units are dealt
    into groups of about `fan`; of each group one unit is left, which goes on to the next level of the tree. About
    4 * fan units, chosen by hash, wait for the root: the units left by the tree exchange mass with them, the lightest
    last, so that the one unit whose rounding is not made good is a light one.
    """
    n = cut(units.groupBy("stratum").agg(F.count("*").alias("n")))
    few = n.count() <= MAX_BROADCAST_SOURCES
    marked = units.join(F.broadcast(n) if few else n, "stratum").withColumn("waits", F.pmod(F.xxhash64(F.lit(seed), F.lit(-2), F.col("id")), F.col("n")) < 4 * fan)
    columns = ["stratum", "id", "w", "p", "extra"]
    settled = lambda f: f.select("stratum", F.explode("f.out").alias("x")).select("stratum", "x.e.id", "x.e.w", "x.e.extra", F.col("x.p").cast("int").alias("take"))
    left = lambda f: f.select("stratum", "f.at.e.id", "f.at.e.w", "f.at.p", "f.at.e.extra")
    waiting, units, level, done = marked.where("waits").select(columns), marked.where("not waits").select(columns), 0, []
    while True:
        groups = units.groupBy("stratum").agg(F.ceil(F.count("*") / fan).cast("long").alias("groups"))
        if (groups.agg(F.max("groups")).first()[0] or 0) <= 1:
            break
        folded = _fold(units, groups, level, seed, few)
        done.append(settled(folded))
        units, level = left(folded), level + 1
    folded = _fold(units.unionByName(waiting), None, level, seed, few)
    done.append(settled(folded))
    out = left(folded).select("stratum", "id", "w", "extra", (uniform(F.lit(seed), F.lit(-1), F.col("id")) < F.col("p")).cast("int").alias("take"))
    for part in done:
        out = out.unionAll(part)
    return out


def one_by_one(groups: DataFrame) -> DataFrame:
    """A row for each of the `rows` that a group stands for, with its `occurrence`. Large groups are dealt out in chunks."""
    few = groups.where(F.col("rows") <= CHUNK).withColumn("occurrence", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    chunks = groups.where(F.col("rows") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))))
    last = F.least(F.col("rows"), (F.col("chunk") + 1) * CHUNK) - 1
    many = chunks.repartition("h", "chunk").withColumn("occurrence", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk")
    return few.unionByName(many)


def _decided(docs: DataFrame, weights: list[float], share: float, cap: float, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, h, size, source_size, target, copies): a row for each row of `docs`."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("h"), word_count(F.col(text_col)).alias("size"))
    groups = cut(rows.groupBy("id", "source", "h").agg(F.min("size").alias("size"), F.count("*").alias("rows")))
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = cut(source_targets(sizes, list(weights), share, cap).withColumn("stratum", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))))
    few = targets.count() <= MAX_BROADCAST_SOURCES
    units = one_by_one(groups)
    joined = units.alias("u").join((F.broadcast(targets) if few else targets).alias("t"), F.expr("u.source <=> t.source")).select("id", "u.source", "h", "occurrence", "size", "stratum", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    split = joined.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    extra = ["size", "whole", "source", "source_size", "target"]
    chosen = round_units(
        split.where(open_).select("stratum", F.struct("id", "h", "occurrence").alias("id"), F.col("size").cast("double").alias("w"), "p", F.struct(*extra).alias("extra")), seed=seed
    ).select(F.col("id.id").alias("id"), F.col("id.h").alias("h"), "extra.*", "take")
    fixed = split.where(~open_).select("id", "h", *extra, F.lit(0).alias("take"))
    return chosen.unionByName(fixed).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("take")).otherwise(F.lit(0)).cast("long"))


def mix_sources(
    docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
) -> DataFrame:
    """How often the mix takes each document: id, size, source_size, target, copies, taken (= copies * size).

    Size is the number of words, 0 for null and empty texts, which are never taken. The copies of a document are
    target / source_size rounded down or up, by chance, but so that a source's taken words differ from its target
    by less than one document's size; no document is taken more than `cap` times (rounded up). Every row is a document with a
    decision of its own, rows that repeat an id, a text or both too. A null source is a source of its own, a null id an
    id. The decisions depend on ids, sources and texts only: reruns agree, at any partitioning. An empty table gives
    no rows. The sources' own table, a row each, is ordered in one place.
    """
    out = _decided(docs, weights, share, cap, id_col, text_col, source_col, seed)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: each row of `docs`, all columns, as often as mix_sources takes it. Of rows that agree in id, source and text as many
    copies are taken as was decided for them together, spread evenly; which of them are taken once more than others is not defined."""
    plan = _decided(docs, weights, share, cap, id_col, text_col, source_col, seed)
    plan = cut(plan.groupBy(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("h").alias("_h")).agg(F.sum("copies").alias("_total"), F.count("*").alias("_rows")).where("_total > 0"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_h"))
    keyed = docs.withColumn("_hash", F.xxhash64(text_col))
    out = keyed.join(plan.where("_rows = 1"), same).withColumn("_copies", F.col("_total"))
    if not plan.where("_rows > 1").isEmpty():
        salt = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_rows") / NUMBERED))
        many = cut(keyed.join(plan.where("_rows > 1"), same).withColumn("_salt", salt))
        key = ["_id", "_source", "_h"]
        counts = many.groupBy(*key, "_salt").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select(*[F.col(c).alias(f"s{c}") for c in (*key, "_salt")], before.alias("_start"))
        numbered = many.withColumn("_n", F.row_number().over(W.partitionBy(*key, "_salt").orderBy(F.lit(0)))).join(starts, F.expr(" AND ".join(f"{c} <=> s{c}" for c in (*key, "_salt"))))
        more = F.col("_start") + F.col("_n") <= F.col("_total") % F.col("_rows")
        out = out.select(*docs.columns, "_copies").unionByName(numbered.select(*docs.columns, (F.floor(F.col("_total") / F.col("_rows")) + more.cast("long")).alias("_copies")))
    return out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*docs.columns)
