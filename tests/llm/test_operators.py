"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import decontaminate, language_id, line_dedup, media, mixing, near_dedup, ppm, quality, queries, simhash, token_store, url_filter
from tessel.operators import clustering

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, h string, size string, copies string, rows string, leaf string, held_out string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="module")
def awkward(spark, benchmark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with inner names."""
    item = benchmark.orderBy("item_id").first().text
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "other text here now", "fr", "s"), (2, None, None, None), (3, "", "", ""), (4, " \t\n\x0b\x0c\r ", "en", "s"),
            (None, "a b c d e f", "en", None), (None, None, None, "s"), (5, long, "en", "t"), (6, "x" * 200_000, "de", "t"), (7, "une é ÿ 漢字 😀 12.5%", "fr", "t"), (8, item, "en", "u"), (9, item + " more", "en", "u")]
    return spark.createDataFrame([(*r, None, "i", "f", "h", "z", "c", "r", "l", "o") for r in rows], SCHEMA)


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


# --- 1 ---


def brute_groups(prints: dict, radius=4):
    ids, top = sorted(prints), {i: i for i in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids}


def plain_simhash(text, width=4):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, texts):
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    want = brute_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("chunk", [8, 1024])
def test_links_of_dense_groups(spark, chunk):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 6, dtype=np.uint64)]
    prints = {base[k % 6] ^ sum({1 << int(b) for b in rng.integers(0, 64, 3)}) for k in range(300)}
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    edges = simhash.link_edges(frame, 4, len(prints), chunk)
    roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for p in prints:
        got[roots.get(simhash.signed(p), simhash.signed(p))].add(p)
    for p, g in brute_groups({p: p for p in prints}).items():
        want[g].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_linked_fingerprints_take_one_worker_a_task(spark, monkeypatch):
    """A task of two Python operators takes two workers, which its executor keeps for all later stages."""
    kept, keep = [], clustering.Rounds.keep
    monkeypatch.setattr(clustering.Rounds, "keep", lambda self, frame: kept.append(frame) or keep(self, frame))
    roots = simhash.linked(spark.createDataFrame([(0,), (1,), (3,), (-1,)], "fp long"), 4)
    assert {r.node: r.root for r in roots.collect()} == {0: 0, 1: 0, 3: 0}
    assert all(f._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1 for f in kept)


def test_near_duplicates_keep_one_of_each_group(docs, texts):
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(docs).select("doc_id").collect()}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.encode().lower().split()]}
    for i in set(texts) - kept:
        assert any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) for k in kept), i
    left = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not left


def shingle_set(text, width=5):
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}


def similar(a, b, similarity=0.8):
    return len(a & b) >= similarity * len(a | b)


def remaining_pairs(spark, rows, **more):
    """Kept ids, and which pairs of them are still near duplicates; every text that went has a near duplicate in the input."""
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(frame, **more).select("doc_id").collect()}
    sets = [shingle_set(t) for t in rows]
    assert all(any(k != i and similar(sets[i], sets[k]) for k in range(len(rows))) for i in range(len(rows)) if i not in kept)
    return kept, [(a, b) for a in kept for b in kept if a < b and similar(sets[a], sets[b])]


def test_near_duplicates_beyond_the_fingerprint_radius(spark):
    """Appended, cut, edited and short copies of similarity 0.8 or more, many of whose fingerprints differ in more bits than the radius."""
    rng, rows, far, pairs = np.random.default_rng(5), [], 0, 0
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    for n, edit in [(n, e) for n in (8, 20, 60, 200, 1000) for e in ("append", "cut", "one") for _ in range(8)]:
        text = word(n)
        shingles, last = n - 4, None
        if edit == "append":
            last = text + word(max(1, int(0.22 * shingles)))
        elif edit == "cut":
            last = text[: n - max(1, int(0.18 * shingles))]
        else:
            last = text[:-1] + word(1)
        pair = " ".join(text), " ".join(last)
        if similar(shingle_set(pair[0]), shingle_set(pair[1])):
            pairs += 1
            far += (plain_simhash(pair[0], 2) ^ plain_simhash(pair[1], 2)).bit_count() > near_dedup.RADIUS
            rows += pair
    assert far > 20
    kept, left = remaining_pairs(spark, rows)
    assert not left and len(kept) == pairs


def test_near_duplicates_in_a_crowd_of_one_template(spark):
    """Texts that share 85 % of their shingles, not similar enough themselves, among them 30 pairs that are: others lead the groups."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    template, rows = word(300), [" ".join(word(40))]
    for k in range(150):
        more = word(25)
        rows += [" ".join(template + more + word(25)) for _ in range(2 if k < 30 else 1)]
    sets = [shingle_set(t) for t in rows]
    assert sum(similar(sets[a], sets[b]) for a in range(len(rows)) for b in range(a)) == 30
    kept, left = remaining_pairs(spark, rows)
    assert not left and len(kept) == len(rows) - 30


@pytest.mark.parametrize("broadcast", [near_dedup.BROADCAST, 0])
def test_similar_pairs_read_no_sets_of_texts_that_meet_by_chance(spark, monkeypatch, broadcast):
    """Neighbours share a passage of 5 of their 96 shingles; 40 pairs lie around the similarity, of equal and of unequal lengths. All pairs that are
    similar are found, and whole sets are read for few texts beyond those."""
    rng, rows, read, sets_of = np.random.default_rng(9), [], [], near_dedup._sets
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    for _ in range(150):
        both = word(9)
        rows += [" ".join(word(45) + both + word(46)) for _ in range(2)]
    for k in range(40):
        text, n = word(100), 15 + k % 8
        rows += [" ".join(text), " ".join(text[:-n] + word(n // 4 if k % 2 else 0)) if k % 4 else " ".join(text + word(n + 2))]
    sets = [shingle_set(t) for t in rows]
    true = {(a, a + 1) for a in range(0, len(rows), 2) if similar(sets[a], sets[a + 1])}
    assert 10 < len(true) < 40
    texts = spark.createDataFrame(list(enumerate(rows)), "h long, text string")
    monkeypatch.setattr(near_dedup, "BROADCAST", broadcast)
    monkeypatch.setattr(near_dedup, "_sets", lambda texts, width: read.append(texts.count()) or sets_of(texts, width))
    found, _ = near_dedup.similar_pairs(texts, texts.limit(0), len(rows), 5, 0.8)
    assert {(r.a, r.b) for r in found.collect()} == true
    assert read and sum(read) <= 80


def test_parities_never_tell_too_large_a_difference():
    rng = np.random.default_rng(10)
    for n, other, common in [(0, 0, 0), (0, 3, 0), (1, 1, 1), (64, 65, 60), (500, 600, 480), (1000, 1030, 0), (700, 2, 1)]:
        shared, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (common, n - common, other - common))
        x, y = near_dedup.parities(np.r_[shared, a]), near_dedup.parities(np.r_[shared, b])
        least = near_dedup.least_difference(x, y)
        assert least == near_dedup.least_difference(y, x) <= n + other - 2 * common
        assert least > (n + other) / 5 or common or not n


def test_near_duplicates_among_copies_in_many_tasks(spark):
    """Copies of a text in every task count once, and an empty table stays empty."""
    rng = np.random.default_rng(8)
    text = [f"w{x}" for x in rng.integers(0, 9000, 80)]
    rows = [" ".join(text)] * 300 + [" ".join([*text, "end"])] * 50 + [" ".join(f"v{x}" for x in rng.integers(0, 9000, 60)), None, "", " "]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(12)
    kept = sorted(r.doc_id for r in near_dedup.drop_near_duplicates(frame).collect())
    assert len(kept) == 3 and kept[0] in (0, 300) and kept[1] == 350 and kept[2] in (351, 352, 353)
    assert near_dedup.drop_near_duplicates(frame.limit(0)).collect() == []


# --- 2 ---


@pytest.mark.parametrize("n", [0, 1, 63, 64, 157, 158, 159, 170, 171, 172, 8192, 8193, 20_000])
def test_transport_stream_round_trip(n):
    raw = bytes(k * 7 % 256 for k in range(n))
    stream = media.multiplex(media.padded(raw), n)
    read = media.demultiplex(stream)
    s = read.streams[media.ES_PID]
    assert len(stream) % 188 == 0 and bytes(s.data) == media.padded(raw) and read.n_bytes == n
    assert (read.damaged, read.continuity_errors) == (0, 0) and s.random_access == [o for o, _ in s.pts] == list(range(0, len(s.data), media.UNIT))


def test_transport_stream_damage_is_counted():
    stream = media.multiplex(media.padded(b"x" * 3000), 3000)
    assert media.demultiplex(stream[: 188 * 4] + stream[188 * 5 :]).continuity_errors == 1
    assert media.demultiplex(stream[: 188 * 4] + stream[188 * 3 : 188 * 4] + stream[188 * 4 :]).continuity_errors == 0  # a repeated packet
    assert media.demultiplex(b"\0" + stream[1:]).damaged == 1
    assert media.demultiplex(stream[:300]).damaged == 1 and not media.demultiplex(None).streams


def test_no_damage_raises():
    """Flipped, cut and shuffled bytes, and tables with a valid checksum whose lengths lie."""
    rng = np.random.default_rng(8)
    stream = media.multiplex(media.padded(b"text " * 900), 4500)
    for _ in range(400):
        raw = np.frombuffer(stream, np.uint8).copy()
        raw[rng.integers(0, 400, rng.integers(1, 12))] = rng.integers(0, 256)
        media.demultiplex(raw.tobytes()[: rng.integers(1, len(raw))])
    head = lambda pid, table: (bytes([media.SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + table).ljust(188, b"\xff")
    for body in (b"\xe1\x00\xff\xff", b"\xe1\x00\xf0\x02\x05\xff", b"\xe1\x00\xf0\x03\x05\x01\x00" + b"\x06\xe1\x00\xff\xff", b"\xe1\x00\xf0\x00\x06\xe1"):
        for _ in (0, 1):
            found = media.demultiplex(stream[:188] + head(media.PMT_PID, media.section(2, 1, body)) + stream[376:])
            assert found.packets == len(stream) // 188


def test_tables_may_take_several_packets():
    """A program table of 60 streams over four packets, cut anywhere, and a second table right behind it in the same packet."""
    info = bytes([media.REGISTRATION, 12]) + media.FORMAT + (77).to_bytes(8, "big")
    entries = b"".join(bytes([media.PRIVATE_PES]) + (0xE000 | 0x100 + k).to_bytes(2, "big") + b"\xf0\x05\x0a\x03eng" for k in range(60))
    pmt = media.section(2, 1, b"\xe1\x00" + (0xF000 | len(info)).to_bytes(2, "big") + info + entries)
    again = media.section(2, 2, b"\xe3\x00\xf0\x00\x06\xe3\x00\xf0\x00")
    whole = media.multiplex(media.padded(b"x" * 500), 500)
    for cut in (1, 50, 183):
        parts, rest, packets = [pmt[:cut]], pmt[cut:] + again, []
        while rest:
            parts.append(rest[:184])
            rest = rest[184:]
        for k, part in enumerate(parts):
            body = (b"\0" if not k else b"") + part
            stuff = b"" if len(body) == 184 else bytes([183 - len(body)]) + (b"\x00" + b"\xff" * (182 - len(body)) if len(body) < 183 else b"")
            packets.append(bytes([media.SYNC, (0x40 if not k else 0) | media.PMT_PID >> 8, media.PMT_PID & 0xFF, (0x30 if stuff else 0x10) | k]) + stuff + body)
        found = media.demultiplex(whole[:188] + b"".join(packets) + whole[376:])
        assert (found.damaged, found.n_bytes, sorted(found.streams)) == (0, 77, [*range(0x100, 0x100 + 60), 0x300])
        assert bytes(found.streams[media.ES_PID].data) == media.padded(b"x" * 500) and found.streams[media.ES_PID].clock == [0]
    assert media.demultiplex(whole[:188] + packets[0]).damaged == 1  # the rest of the table is missing


def test_media_digests(docs, texts):
    for r in media.media_digests(docs).collect():
        raw = media.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.multiplex(raw, r.n_bytes)).hexdigest()


# --- 3 ---


def test_url_filter_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{SF}/pages.parquet'")
    want = sorted(map(repr, con.sql(queries.ORACLE_SQL["op3_url_filter"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in queries.op3_url_filter(spark, SF).collect()) == want


def test_url_cascade_is_exact(spark):
    keys = [f"k{k}" for k in range(3000)]
    universe, listed = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(k,) for k in keys[::10]], "key string")
    for most in (url_filter.MAX_LISTED, 10):  # bits in the plan, and in tables of one row
        levels = url_filter.build_cascade(universe, listed, 0, most)
        assert len(levels) > 1 and (levels[0].table is None) == (most > 300)
        found = url_filter.attach(universe, levels).where(url_filter.in_cascade(F.col("key"), levels)).select("key")
        assert sorted(r.key for r in found.collect()) == sorted(keys[::10])


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.com", "x://example.com/en/?q", "x://www.example.com/en/", "x://notexample.com/en/", "x://a.b.net/es/x://y", "x://com/", "x://é.net/fr/#", "x://example.com/en/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, key string")
    for limit in (url_filter.MAX_LISTED, 1):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, queries.URL_RULES, max_listed=limit).collect()}
        assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[4] == ("a.example.com", "", None, "allow")
        assert [got[k][2:] for k in (5, 6, 7, 8, 9, 10)] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block"), ("com/", "allow"), ("net/fr/", "block")]
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


# --- 4 ---


def water_level(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, rest, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: rest * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        rest -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix(docs, texts):
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(t.encode().split()) for i, t in texts.items()}
    total = Counter()
    for i in texts:
        total[source[i]] += size[i]
    target = water_level(total, [3, 1, 2], 1.5, 2.0)
    rows = mixing.mix_sources(docs).collect()
    taken = Counter()
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]]) and r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(texts)
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in texts if source[i] == s) for s in total)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("kind", ["null ids", "one id", "copies"])
def test_mix_of_repeated_rows(spark, kind):
    """Rows without ids, or of one id, or that are copies, are decided row by row, so that targets are met to one document."""
    rows = [(None if k % 2 and kind == "null ids" else 7 if k % 2 else k, " ".join(["w"] * (1 if kind == "copies" and k % 2 else 1 + k % 40) + [f"x{k}"] * (not (kind == "copies" and k % 2))), f"s{k % 3}", k) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    out = mixing.mix_sources(docs).collect()
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(t.split())
    target, taken = water_level(size, [3, 1, 2], 1.5, 2.0), Counter()
    for r in out:
        taken[next(s for s in size if target[s] == pytest.approx(r.target) and size[s] == r.source_size)] += r.taken
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 41 for s in size)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))
    mixed = mixing.apply_mix(docs).collect()
    words, times = Counter(), Counter()
    for r in mixed:
        words[r.source] += len(r.text.split())
        times[r.n] += 1
    assert words == taken and max(times.values()) <= 2


def test_large_groups_of_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    monkeypatch.setattr(mixing, "NUMBERED", 50)
    docs = spark.createDataFrame([(None, "a b c", None, "d")] * 1000 + [(k, "a b", "s", "e") for k in range(10)], "doc_id long, text string, source string, size string")
    out, mixed = mixing.mix_sources(docs).collect(), mixing.apply_mix(docs)
    assert len(out) == 1010 and sum(r.copies for r in out) == mixed.count() and mixed.columns == docs.columns
    target = water_level({None: 3000, "s": 20}, [3, 1, 2], 1.5, 2.0)
    assert abs(sum(r.taken for r in out if r.doc_id is None) - target[None]) <= 3


def test_rounding_tree_keeps_mass_and_chances(spark):
    """A small fan makes a tree of several levels; the sum of p * w is kept to one light unit, and each unit is taken p of the time."""
    n, units = 400, [(1, k, float(1 + k % 9), 0.1 + 0.8 * (k % 10) / 10) for k in range(400)]
    frame = spark.createDataFrame(units, "stratum int, i long, w double, p double").select("stratum", F.struct("i").alias("id"), "w", "p", F.struct("i").alias("extra"))
    hits, mass = Counter(), sum(w * p for _, _, w, p in units)
    for seed in range(6):
        out = mixing.round_units(frame, fan=4, seed=seed).collect()
        assert len(out) == n and abs(sum(r.w * r.take for r in out) - mass) <= 9
        hits.update(r.id.i % 10 for r in out if r.take)
    assert all(abs(hits[k] / 240 - (0.1 + 0.08 * k)) < 0.12 for k in range(10))


# --- 5 ---


def test_quality(docs, labels):
    """Held-out rows: labels of a part of the ids are kept back from the fit."""
    marks = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    learn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 7)
    held = set(marks) - {r.doc_id for r in learn.collect()}
    found = {r.doc_id: r.keep for r in quality.classify_quality(docs, learn).collect()}
    assert len(found) == docs.count()
    good = [found[i] for i in held if marks[i] == (1, 0)]
    assert len(good) > 10 and sum(good) >= 0.97 * len(good)  # too few labels to learn what is bad: see the larger table
    kept = {r.doc_id for r in quality.keep_good(docs, learn).select("doc_id").collect()}
    assert kept == {i for i, k in found.items() if k}
    assert quality.classify_quality(docs, labels.limit(0)).where("not keep").count() == 0


def test_quality_on_held_out_rows_of_a_larger_table(spark):
    docs, labels = (spark.read.parquet(f"{SF[:-3]}01/{n}.parquet") for n in ("documents", "labels"))
    marks = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    learn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 7)
    held = set(marks) - {r.doc_id for r in learn.collect()}
    found = {r.doc_id: r.keep for r in quality.classify_quality(docs, learn).collect()}
    good, bad, toxic = ([found[i] for i in held if f(*marks[i])] for f in (lambda q, t: (q, t) == (1, 0), lambda q, t: q == 0, lambda q, t: t == 1))
    assert min(map(len, (good, bad, toxic))) > 10 and sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad) and sum(toxic) <= 0.25 * len(toxic)


def plain_exchange(model, looks, taken):
    """Brute force of a round for one label: the surest rows of each view and kind over all looks."""
    out = {}
    for v, p in enumerate(model.by_view([(np.concatenate([x[k] for x in looks.values()]), np.array([len(x[k]) for x in looks.values()])) for k in (0, 1)])):
        for good in (0, 1):
            q = p if good else 1 - p
            rows = [(-q[n], h) for n, h in enumerate(looks) if h not in taken and q[n] >= quality.CONFIDENT and abs(quality.logit(p[n]) - model.prior) >= 1]
            for _, h in sorted(rows)[: model.room(good)]:
                out[1 - v, h] = good
    return out


def test_the_whole_pool_is_searched_in_each_round(spark, monkeypatch):
    """What a round hands over are the surest rows of the whole table, for every number of partitions."""
    docs, labels = (spark.read.parquet(f"{SF[:-3]}01/{n}.parquet") for n in ("documents", "labels"))
    monkeypatch.setattr(quality, "EXCHANGED", 12)
    seen, exchange = [], quality._exchange

    def spy(pool, labels):
        looks = {r.h: (np.array(r.content, np.int64), np.array(r.metadata, np.int64)) for r in pool.collect()}
        before = [[dict(part) for part in x.added] for x in labels]
        want = [plain_exchange(x, looks, {h for part in x.added for h in part}) for x in labels]
        n = exchange(pool.repartition(5), labels)
        for x, old, w in zip(labels, before, want):
            assert {(v, h): int(y) for v in (0, 1) for h, (_, y) in x.added[v].items() if h not in old[v]} == w
        seen.append(n)
        return n

    monkeypatch.setattr(quality, "_exchange", spy)
    quality.train(docs, labels, "doc_id", "text", "source", "lang", 10_000, 2)
    assert len(seen) == 2 and seen[0] > 0


# --- 6 ---


@pytest.mark.parametrize("head_runs", [ppm.HEAD_RUNS, 20_000, 0])
def test_lm_scores(docs, texts, head_runs):
    """Whatever part of the model is broadcast, the score is that of the whole trie."""
    small = docs.where("length(text) < 800")
    mine = {r.doc_id: texts[r.doc_id].encode().lower() for r in small.collect()}
    train = [i for i in mine if zlib.crc32(str(i).encode()) % 5 != 1]
    words, trie = Counter(), ppm.Trie()
    for i in train:
        words.update([*mine[i].split(), b""])
        data = bytes([ppm.END]) * ppm.ORDER + mine[i] + bytes([ppm.END])
        for k in range(ppm.ORDER, len(data)):
            trie.learn(data[k - ppm.ORDER : k], data[k])
    n, v, rows = words.total(), len(words), ppm.score_documents(small, queries.fold() == 1, head_runs=head_runs).collect()
    assert len(rows) == len(mine) and len(train) < len(mine)
    for r in rows:
        tokens = [*mine[r.doc_id].split(), b""]
        base = sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(tokens), sum(t in words for t in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(trie.score(mine[r.doc_id]), rel=1e-5)


def test_trie_probabilities_by_hand():
    """After "abracadabra", a context gives (2c - 1) / 2n to a symbol it knows; an escape leaves the others to shorter contexts without its symbols."""
    trie, data = ppm.Trie(2), b"\xff\xffabracadabra"
    for k in range(2, len(data)):
        trie.learn(data[k - 2 : k], data[k])
    p = lambda context, symbol: trie.probability(context, ord(symbol))
    assert p(b"ab", "r") == pytest.approx(3 / 4)  # ab is followed by r twice: (2 * 2 - 1) / 4
    assert p(b"ra", "c") == pytest.approx(1 / 2)
    # escape from ra (1 / 2); after a: b 2, d 1, without c, and two kinds: b has 3 / 6, an escape 2 / 6
    assert p(b"ra", "b") == pytest.approx(1 / 2 * 3 / 6)
    assert p(b"ra", "z") == pytest.approx(1 / 2 * 2 / 6 * (2 / 14) / 251)  # then of a 5, r 2 an escape of two kinds, to 251 other bytes
    for context in (b"zz", b"\xff\xff", b"ab"):
        assert 0.5 < sum(trie.probability(context, s) for s in range(256)) <= 1 + 1e-9  # an escape that no symbol is left for is lost
    assert ppm.Trie(2).score(b"aaaaaaaaaaaaaaaa", adapt=True) > ppm.Trie(2).score(b"qwertzuiopasdfgh", adapt=True)


# --- 7 ---


def test_token_ids(docs, texts, tmp_path):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    path = str(tmp_path / "ids")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.token_digests(docs, queries.tokenizer_path(), path=path).collect()}
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert (token_store.lookup(path, i) == ids).all() and token_store.lookup(path, 10**12) is None


def test_token_ids_of_text_keys(spark, tmp_path):
    rows = [("b", "one two"), ("a", "three"), (None, "four"), ("b", "one two"), ("", None), ("é", "five six")]
    docs, path = spark.createDataFrame(rows, "doc_id string, text string"), str(tmp_path / "ids")
    got = sorted(token_store.token_digests(docs, queries.tokenizer_path(), path=path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, "", "a", "b", "b", "é"] and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert zlib.crc32(token_store.lookup(path, "a").astype("<u4").tobytes()) == got[2].ids_crc32 and token_store.lookup(path, "c") is None


@pytest.mark.parametrize("text", ["it's we'll \x1cab\x1d c\xa0d", "Éé ÿß.Àx §.a éx <|endoftext|>a, 12a3.. ñ–x", "ﬁ İI ΑΣ. Don't!! '''s ..a a..b", "a.̈b ë x́ 漢字。", "", " \t\n"])
def test_encoder_is_the_tokenizer(text):
    from tokenizers import Tokenizer

    coder = token_store.Encoder(queries.tokenizer_path())
    assert coder.by_piece
    assert np.frombuffer(coder.encode(text.encode()), coder.dtype).tolist() == Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_encoder_keeps_a_tail_when_its_store_is_emptied(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 2)
    coder = token_store.Encoder(queries.tokenizer_path())
    for word in ("one.", "two.", "three,", "four.", "five,", "six.", "seven,"):
        assert coder.encode(word.encode()) == coder.whole(word)


def test_encoder_remembers_no_long_words():
    """Words have no bound of their own: a store of as many long ones would take gigabytes."""
    coder = token_store.Encoder(queries.tokenizer_path())
    for word in ("x" * 5000, "Y" * 5000 + ".", "a" + "!" * 5000, "%" * 5000, "one."):
        assert coder.encode(word.encode()) == coder.whole(word)
    assert max(map(len, [*coder.pieces, *coder.cores])) <= token_store.REMEMBERED_BYTES and b"one." in coder.pieces


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys)))
    index = token_store.ShardIndex.load(token_store.ShardIndex.build(keys, np.arange(len(keys)), np.ones(len(keys), int)).dump())
    found, offset, _ = index.find(keys)
    assert found.all() and (offset == np.arange(len(keys))).all()
    assert index.find(keys + np.uint64(1))[0].mean() < 0.01


# --- 8 ---


def plain_templates(lines, similarity=0.8):
    """Template number of each line (all of one length), each compared with every template before it."""
    made, out = [], []
    for line in lines:
        same = [sum(a == b for a, b in zip(t, line)) for t in made]
        if same and max(same) >= similarity * len(line) - 1e-9:
            k = same.index(max(same))
            made[k] = [a if a == b else line_dedup.WILD for a, b in zip(made[k], line)]
        else:
            k = len(made)
            made.append(list(line))
        out.append(k)
    return out, made


def plain_dropped(texts):
    """Line numbers to drop of each text: the whole operator without Spark, leaf by leaf in the order of signatures."""
    leaves, holders = defaultdict(dict), defaultdict(set)
    for t in texts:
        for line in t.encode().split(b"\n"):
            tokens = line_dedup.parsed(line)
            if tokens:
                leaf, sig = line_dedup.paths(tokens)
                leaves[leaf][sig] = tokens
                holders[sig].add(t)
    recurring = set()
    for own in leaves.values():
        sigs = sorted(own)
        number, _ = plain_templates([own[s] for s in sigs])
        need, texts_of = 2 if len(own[sigs[0]]) >= line_dedup.MIN_TOKENS else line_dedup.SHORT_TEXTS, defaultdict(set)
        for k, s in zip(number, sigs):
            texts_of[k] |= holders[s]
        recurring |= {s for k, s in zip(number, sigs) if len(texts_of[k]) >= need}
    parse = lambda line: line_dedup.parsed(line.encode())
    return {t: [k for k, line in enumerate(t.split("\n")) if parse(line) and line_dedup.paths(parse(line))[1] in recurring] for t in texts}


def test_line_dedup(docs, texts):
    want = plain_dropped(set(texts.values()))
    assert sum(map(len, want.values())) > 20
    for r in line_dedup.drop_recurring_lines(docs).collect():
        lines = texts[r.doc_id].split("\n")
        assert list(r.dropped) == want[texts[r.doc_id]] and r.text == "\n".join(line for k, line in enumerate(lines) if k not in r.dropped)


def test_templates_are_those_of_all_comparisons():
    rng = np.random.default_rng(12)
    for width in (2, 5, 7, 12, 20):
        base = [[b"t%d" % rng.integers(4) for _ in range(width)] for _ in range(6)]
        lines = []
        for _ in range(300):
            line = list(base[rng.integers(6)])
            for k in rng.choice(width, rng.integers(0, max(1, width // 3) + 1), replace=False):
                line[k] = line_dedup.WILD if rng.random() < 0.3 else b"t%d" % rng.integers(9)
            lines.append(line)
        leaf = line_dedup.Leaf(width, depth=0)
        number, made = plain_templates(lines)
        assert [leaf.add(x) for x in lines] == number and [leaf.template(k) for k in range(leaf.used)] == made


def test_line_templates(spark):
    frame = spark.createDataFrame([(1, "user ann logged in from 10.0.0.1 at noon\nonly here one two three"), (2, "user bob logged in from 10.0.0.2 at noon\nshort line"), (3, "a b c d e 1\nshort line"), (3, "a b c d e 1\nshort line")], "doc_id long, text string")
    got = sorted(rows_of(line_dedup.drop_recurring_lines(frame), "doc_id", "text", "n_dropped"))
    assert got[0] == (1, "user ann logged in from 10.0.0.1 at noon\nonly here one two three", 0)  # the second token is part of the path
    leaf = line_dedup.Leaf(5, depth=0)
    assert [leaf.add(x.split()) for x in (b"a b c d e", b"a b c x e", b"q r s t u")] == [0, 0, 1] and leaf.template(0) == [b"a", b"b", b"c", b"<*>", b"e"]
    frame = spark.createDataFrame([(1, "job run of ann has ended well today at noon"), (2, "job run of bob has ended well today at noon")], "doc_id long, text string")
    assert all(r.n_dropped == 1 and r.text == "" for r in line_dedup.drop_recurring_lines(frame).collect())


def test_short_lines_that_many_texts_share(spark):
    footer = lambda k: f"All rights reserved.\npage {k} of 9\n{k}\n\nonly text number{'x' * k} says this"
    many = [(k, footer(k)) for k in range(1, line_dedup.SHORT_TEXTS + 1)]
    frame = spark.createDataFrame([*many, (90, "by chance\nonly here"), (91, "by chance\nonly there")], "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in line_dedup.drop_recurring_lines(frame).collect()}
    assert all(got[k][:2] == [0, 1] and 2 not in got[k] and 3 not in got[k] for k, _ in many) and got[90] == got[91] == []
    fewer = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring_lines(frame.where(f"doc_id < {line_dedup.SHORT_TEXTS} or doc_id > 89")).collect()}
    assert set(fewer.values()) == {0}  # below the count the footer stays


# --- 9 ---


def test_decontaminate(docs, texts, benchmark):
    def grams(w):
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    want = {}
    for item in benchmark.collect():
        q = item.text.encode().lower().split()
        own = grams(q)
        for i, t in texts.items():
            w = t.encode().lower().split()
            if not set(own) & set(grams(w)):
                continue
            best = max(sum((g & own).values()) / sum((g | own).values()) for g in (grams(w[k : k + len(q)]) for k in range(max(1, len(w) - len(q) + 1))))
            if best >= 0.8:
                want[i, item.item_id] = round(best, 9)
    assert want == {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(docs, benchmark, block_bytes=2000).collect()}
    clean = {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).select("doc_id").collect()}
    assert clean == set(texts) - {i for i, _ in want}


def test_decontaminate_finds_short_windows_whatever_their_fingerprints(spark):
    rng = np.random.default_rng(9)
    items = [[f"w{x}" for x in rng.choice(100_000, 9, replace=False)] for _ in range(3000)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(k, " ".join(w[:8])) for k, w in enumerate(items)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench).collect()}  # 4 of 5 shingles: a similarity of 0.8
    assert found == {(k, k) for k in range(3000)}
    assert decontaminate.find_leaks(frame.withColumn("text", F.expr("substring_index(text, ' ', 7)")), bench).count() == 0  # 3 of 5


def test_multi_index_names_every_similar_window():
    """Windows that share just enough shingles with an item, with repeats, are always within its radius; most others are not named."""
    rng = np.random.default_rng(4)
    for m in (5, 9, 30, 90):
        items = rng.integers(0, 2**63, (40, m), dtype=np.uint64)
        items[:, : m // 4] = items[:, :1]  # repeats
        one = np.zeros(1, np.int64)
        index = decontaminate.MultiIndex(np.concatenate([decontaminate.Votes(x).of(one, m) for x in items]), int(2 * m * 0.2 / 1.8 + 1e-9))
        moved, windows = m - math.ceil(0.8 * 2 * m / 1.8 - 1e-9), items.copy()
        for w in windows:
            w[rng.choice(m, moved, replace=False)] = rng.integers(0, 2**63, moved, dtype=np.uint64)
        votes = np.concatenate([decontaminate.Votes(x).of(one, m) for x in windows])
        found = set(zip(*(x.tolist() for x in index.candidates(votes))))
        assert {(k, k) for k in range(40)} <= found and len(found) < 40 * 8


# --- 10 ---


def test_forward_sums_all_segmentations():
    vocab = language_id.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    p = np.random.default_rng(2).random((vocab.size, 2)) / vocab.size
    words = ["▁there", "▁ñandú", "▁a", "x漢q"]
    w, i, j, k, _ = vocab.lattice(words)
    for n, word in enumerate(words):
        arcs = [(a, b, c) for x, a, b, c in zip(w, i, j, k) if x == n]

        def total(at, lang, word=word, arcs=arcs):
            return 1.0 if at == len(word) else sum(p[c, lang] * total(b, lang) for a, b, c in arcs if a == at)

        assert language_id.forward(words, vocab, p)[n] == pytest.approx(np.log([total(0, 0), total(0, 1)]))


def plain_log(word, vocab, p, lang):
    """All segmentations of a word by a plain sum over positions, as logarithms; an independent reading of the vocabulary's pieces."""
    value = dict(zip(vocab.keys.tolist(), vocab.values.tolist()))
    alpha = [0.0] + [-math.inf] * len(word)
    for i in range(len(word)):
        h = 0
        for j in range(i + 1, min(len(word), i + vocab.longest) + 1):
            h = vocab._step(h, ord(word[j - 1]))
            piece = value.get(h, 0)
            if piece or j == i + 1:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + math.log(p[piece, lang]))
            if h not in value:
                break
    return alpha[-1]


def test_words_of_any_length_are_summed_whole(monkeypatch):
    vocab = language_id.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    p = np.random.default_rng(3).random((vocab.size, 2)) / vocab.size
    words = ["▁donaudampfschifffahrtsgesellschaft", "▁" + "x漢" * 60, "▁there", "▁" + "the" * 400, "a" * 25, "b" * 24]
    for block in (language_id.BLOCK, 40):
        monkeypatch.setattr(language_id, "BLOCK", block)
        got = language_id.forward(words, vocab, p)
        assert got == pytest.approx(np.array([[plain_log(w, vocab, p, k) for k in (0, 1)] for w in words]))
    monkeypatch.setattr(language_id, "LONGEST", 60)
    few = ["▁donaudampfschifffahrtsgesellschaft", "▁unbelievably"]
    whole = language_id.expected_counts(few, np.array([2.0, 3.0]), vocab, p[:, 0])
    monkeypatch.setattr(language_id, "LONGEST", 10)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert language_id.expected_counts(few, np.array([2.0, 3.0]), vocab, p[:, 0]) == pytest.approx(whole)


def test_numerals_are_no_letters(spark):
    pieces = queries.tokenizer_path("piece_bpe_32k.model")
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "½ Ⅷ ①  ²", None), (4, "12 % !", None), (5, "½ cat", None), (6, "le" * 3000 + " chat est la", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(frame, F.lit(True), pieces).collect()}
    assert got[3] == got[4] == ("und", 0.0) and got[5][0] == "en" and got[6][0] == "fr"


def test_language_id(docs, spark):
    out = queries.op10_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


# --- all ---


def test_awkward_tables(spark, awkward, labels, benchmark):
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None), (5, 0, None)], labels.schema))
    benchmark = benchmark.unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, "two words")], benchmark.schema))
    learn = ~F.coalesce(queries.fold() == 0, F.lit(False))
    n, pieces = awkward.count(), queries.tokenizer_path("piece_bpe_32k.model")
    whole = {
        "simhash": lambda d: simhash.simhash_groups(d), "media": lambda d: media.media_digests(d), "mix": lambda d: mixing.mix_sources(d), "quality": lambda d: quality.classify_quality(d, labels),
        "lm": lambda d: ppm.score_documents(d, queries.fold() == 1), "ids": lambda d: token_store.token_digests(d, queries.tokenizer_path()), "lines": lambda d: line_dedup.drop_recurring_lines(d),
        "language": lambda d: language_id.identify_language(d, learn, pieces),
    }
    for name, f in whole.items():
        assert len(f(awkward).collect()) == n, name
        assert f(awkward.limit(0)).collect() == [], name
    leaks = {r.doc_id for r in decontaminate.find_leaks(awkward, benchmark).collect()}
    assert leaks == {8, 9}
    assert decontaminate.find_leaks(awkward, benchmark.limit(0)).collect() == [] and decontaminate.find_leaks(awkward.limit(0), benchmark).collect() == []
    kept = rows_of(near_dedup.drop_near_duplicates(awkward), "doc_id", "text")
    assert sorted(i for i, _ in kept if i != 2 and i != 3 and i != 4) in ([1, 1, 5, 6, 7, 8], [1, 1, 5, 6, 7, 9]) and sum(i in (2, 3, 4, None) for i, _ in kept) == 1
    copies = Counter(r.doc_id for r in mixing.apply_mix(awkward).select("doc_id").collect())
    assert copies[2] == copies[3] == copies[4] == 0 and mixing.apply_mix(awkward).columns == awkward.columns
    for stage in (quality.keep_good(awkward, labels), decontaminate.drop_leaks(awkward, benchmark), near_dedup.drop_near_duplicates(awkward)):
        assert stage.columns == awkward.columns
        stage.collect()
    und = {r.doc_id: r.lang_pred for r in language_id.identify_language(awkward, learn, pieces).where("doc_id in (2, 3, 4)").collect()}
    assert set(und.values()) == {"und"}


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert rows and all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == docs.columns, name
