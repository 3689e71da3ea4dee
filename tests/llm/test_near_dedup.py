import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import near_dedup
from tidemark.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = " ".join(word() for _ in range(60))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 12, 40, 150]))]
        for _ in range(rng.choice([1, 1, 3, 20])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.2:
                text = text[: max(1, len(text) - rng.randrange(1, 5))]
            rows.append((i, " ".join(text)))
            i += 1
    for _ in range(15):
        rows.append((i, common + " " + " ".join(word() for _ in range(rng.choice([5, 30, 200])))))
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("limit", [near_dedup.BROADCAST_IDS, 0])
def test_broadcast_and_shuffled_forms_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", limit)
    rows = corpus(7)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_stage_threshold(spark):
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.keep_one(df).collect()}
    assert kept == {i for i, (n, c) in brute(rows, 80).items() if i == c or not n}


def test_recall_on_the_driver_tables(spark):
    """Every link of the smallest table, found by brute force over an index of shingles."""
    d = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(d).select("doc_id", "text").collect()]
    sets = {i: shingles(t) for i, t in rows}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    common = Counter((a, b) for ids in lists.values() for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :])
    linked = [p for p, n in common.items() if 100 * n >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.read.parquet(d)).collect()}
    assert linked and all(got[a] == got[b] for a, b in linked)
    assert all(near_dedup.chance_of_loss(p) < 2e-5 for p in (80, 85))


def test_estimate_of_a_pair(spark):
    """Against the definition, on sketches of random sets, whole ones and others."""
    rng = random.Random(2)
    k, rows = 40, []
    for _ in range(80):
        base = rng.sample(range(-1000, 1000), rng.choice([3, 20, 40, 90]))
        other = [x if rng.random() < 0.85 else rng.randrange(1000, 2000) for x in base]
        rows.append((sorted(set(base)), sorted(set(other))))
    df = spark.createDataFrame([(a[:k], b[:k], len(a), len(b)) for a, b in rows], "a array<long>, b array<long>, n long, m long")
    got = [r.e for r in df.select(near_dedup.estimated(df.a, df.b, df.n, df.m, 85, k).alias("e")).collect()]
    for (a, b), e in zip(rows, got, strict=True):
        union = sorted(set(a) | set(b))
        if len(union) <= k:
            want = 100 * len(set(a) & set(b)) >= 85 * len(union)
        else:
            want = len(set(union[:k]) & set(a) & set(b)) >= max(1, math.floor(k * 0.85 - 5 * (k * 0.85 * 0.15) ** 0.5))
        assert e == want
    assert len(set(got)) == 2


@pytest.mark.parametrize("wide", [32, 64])
def test_sets_larger_than_a_sketch(spark, monkeypatch, wide):
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    rows = corpus(5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_keep_one_of_null_and_repeated_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(200)) for c in "xyz")
    rows = [(1, x, "a"), (1, x, "a"), (1, y, "b"), (2, x + " end", "c"), (None, y, "d"), (None, z, "e"), (None, z, "e"), (None, z + " end", "f"), (None, "alone", "g"), (None, "", "h"), (None, None, "i"), (3, "", "j"), (3, "", "j"), (4, "  ", "k")]
    got = Counter(r.tag for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)).collect())
    one_of_z = got.pop("e", 0) + got.pop("f", 0)
    assert one_of_z == 1 and got == Counter({"a": 1, "b": 1, "g": 1, "h": 1, "i": 1, "j": 2, "k": 1})


def test_chain_is_one_component(spark):
    """Neighbours are linked, the ends aren't: only the whole chain connects them."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(12)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()} and set(got.values()) == {0}


def test_awkward_rows(spark, awkward, nothing):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)}
    assert by[4] == {(1, 4, True)} and by[5] == {(1, 4, False)} and by[6] == {(1, 6, True)}
    assert by[10] == {(10, 9, False)} and by[None] == {(2, None, False)}
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns
    # The row without id is the only one of its text, and of the two equal rows 4 one stays.
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7, 8, 9, None])
    assert near_dedup.keep_one(nothing).count() == 0


def test_null_and_repeated_ids_link_by_their_own_texts(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[8 * i : 8 * i + 200]) for i in range(5)]
    # The middle of the chain has no id; without it the ends aren't linked.
    rows = [(0, chain[0]), (1, chain[1]), (None, chain[2]), (None, chain[2]), (3, chain[3]), (4, chain[4])]
    # Two texts of one id with equally many shingles, each with a near copy of its own.
    x, y = [" ".join(f"{c}{i}" for i in range(200)) for c in "xy"]
    rows += [(10, x), (10, y), (11, x + " end"), (12, y + " end")]
    # Two linked texts without any id, and one alone.
    z = " ".join(f"z{i}" for i in range(200))
    rows += [(None, z), (None, z + " end"), (None, "alone")]
    for _ in range(2):
        out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len(out) == len(rows)
        got = Counter((r.doc_id, r.component_id, r.kept) for r in out)
        want = [(0, 0, True), (1, 0, False), (None, 0, False), (None, 0, False), (3, 0, False), (4, 0, False)]
        want += [(10, 10, True)] * 2 + [(11, 10, False), (12, 10, False)] + [(None, None, False)] * 3
        assert got == Counter(want)
        rows = rows[::-1]


def test_shingle_hashes():
    s = near_dedup.Shingler()
    assert len(s("a b c d e")) == 1 and len(s("a b c d e f")) == 2
    assert (s("A  b\tc") == s("a b c")).all() and len(s("")) == 0 and len(s(None)) == 0
    assert len(s("x " * 100_000)) == 1
    assert (s("İ É a b c") != s("i é a b c")).any()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k - 1) for k in range(101, 160)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
