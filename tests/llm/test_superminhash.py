"""SuperMinHash near-dedup against brute force."""

import numpy as np
import pytest

from tessel.llm import superminhash as sm

SF = "/root/testdata/sf0.001"


def shingles(text, width=3):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    """(id, n, component, kept) of each row, by all pairs."""
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                top[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        component = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), component, i == component if i is not None else component is None))
    return out


def groups(frame, **more):
    return [tuple(r) for r in sm.near_duplicate_groups(frame, **more).select("doc_id", "n_shingles", "component_id", "kept").collect()]


def edited(rng, words, edits):
    out = list(words)
    for k in rng.choice(len(out), edits, replace=False):
        out[k] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


def test_equals_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(groups(docs)) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize(("members", "elements"), [(1024, 1 << 19), (16, 1 << 19), (1024, 4000)])
def test_crowds_and_pairs_at_the_threshold(spark, monkeypatch, members, elements):
    """Copies of one template at about the threshold, chains, and small sets, whole and dealt out in parts."""
    monkeypatch.setattr(sm, "MEMBERS", members)
    monkeypatch.setattr(sm, "MEMBER_ELEMENTS", elements)
    rng, rows = np.random.default_rng(5), []
    template = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows += [edited(rng, template, e) for e in rng.integers(1, 6, 60)]
    chain = [f"c{x}" for x in range(200)]
    for k in range(25):
        chain[8 * k] = f"step{k}"
        rows.append(" ".join(chain))
    for n in (1, 2, 3, 4, 9, 22, 23):
        base = [f"s{n}x{x}" for x in range(n)]
        rows += [" ".join(base), " ".join(base).upper(), " ".join([*base, "more"]), " ".join(base[:-1])]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(groups(frame)) == sorted(brute(list(enumerate(rows))))


def test_awkward_rows(spark):
    long = " ".join(f"word{k % 9973}x{k // 977}" for k in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text here now"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, "A b c d e f"), (None, "only a null id"), (None, "only a null id"),
            (None, None), (5, long), (6, long + " end"), (7, "x" * 200_000), (8, "é ÿ 漢字"), (9, "É ÿ 漢字"), (10, "one"), (11, "One"), (12, "two words"), (13, "two\twords")]
    frame = spark.createDataFrame([(*r, "n", 1, 2, 3) for r in rows], "doc_id long, text string, id string, n long, s1 long, root long")
    assert sorted(groups(frame), key=repr) == sorted(brute(rows), key=repr)
    text_ids = spark.createDataFrame([("b", "a b c d"), ("a", "a b c d")], "doc_id string, text string")
    assert {r[:3] for r in groups(text_ids)} == {("a", 2, "a"), ("b", 2, "a")}
    assert groups(frame.limit(0)) == [] and groups(frame.where("text is null")) == [(2, 0, 2, True), (None, 0, None, True)]


def plain_signature(elements, values):
    """The definition, element by element, with whole permutations."""
    best = [(1 << 64) - 1] * values
    for x in elements:
        place = list(range(values))
        for j in range(values):
            draw = int(sm.mixed(np.array([(int(x) + (j + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
            pick = j + ((draw >> 32) * (values - j) >> 32)
            place[j], place[pick] = place[pick], place[j]
            best[place[j]] = min(best[place[j]], j << 32 | draw & 0xFFFFFFFF)
    return best


def test_signatures_are_those_of_the_definition():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 3, 17, 100, 400]
    sets = [rng.integers(0, 1 << 63, s, dtype=np.uint64) for s in sizes]
    got = sm.signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), 32)
    assert got.tolist() == [plain_signature(s, 32) for s in sets]


def test_agreement_estimates_similarity_with_less_variance_than_min_hash():
    rng, errors = np.random.default_rng(2), []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
        got = sm.signatures(np.concatenate([pool[:60], pool[10:]]), np.repeat([0, 1], 60), 2)
        errors.append((got[0] == got[1]).mean() - 50 / 70)
    plain = (50 / 70 * 20 / 70 / sm.VALUES) ** 0.5
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.9 * plain


def test_linked_joins_all_and_only_what_links_join():
    rng = np.random.default_rng(7)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 14, rng.integers(1, 14))).astype(np.uint64) for _ in range(12)]
        want = list(range(12))
        for a in range(12):
            for b in range(a):
                common = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = want[a], want[b]
                    want = [min(x, y) if v in (x, y) else v for v in want]
        got = sm.linked(sets, np.arange(12), 85)
        assert len({*zip(want, got.tolist())}) == len(set(want)) == len(set(got.tolist()))
