"""Links and components against all pairs, also with tiny limits that send
all lists through the frequent-value and block paths."""

import random

import numpy as np
import pytest

from lotquery.llm import near_dedup as nd
from lotquery.llm.common import SPACE, word_hashes


def brute(texts: dict[int, str], similarity: int = 85) -> dict[int, int]:
    sets = {}
    for i, text in texts.items():
        words = text.encode().lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(texts)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    return {i: find(i) for i in ids}


def corpus(seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    bases = [[word() for _ in range(rng.choice([3, 5, 8, 40, 120]))] for _ in range(12)]
    passage = [word() for _ in range(25)]
    texts = []
    for base in bases:
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own + passage
            texts.append(rng.choice([" ", "\n", "  "]).join(own))
    rng.shuffle(texts)
    return {10 * i + 3: t for i, t in enumerate(texts)} | {1: "", 2: " \n"}


@pytest.mark.parametrize("limits", [{}, {"FREQUENT": 2, "LIST_MAX": 4, "BLOCK": 3, "COUNTERS": 64, "SPARE": 1},
                                    {"FREQUENT": 1, "LIST_MAX": 2, "BLOCK": 2, "COUNTERS": 512, "PIVOT_ROUNDS": 0},
                                    {"LIST_MAX": 1, "BLOCK": 3, "PIVOT_ROUNDS": 1, "MARGIN": 0.0}])
def test_components_match_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(nd, name, value)
    texts = corpus(len(limits) + limits.get("BLOCK", 0))
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in nd.near_dedup(docs).collect()}
    expected = brute(texts)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.kept == (i == expected[i]) for i, r in got.items())


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 99), (99, 200), (300, 301), (400, 300)]
    roots = {r.node: r.root for r in nd.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(51)} == {0} and roots[200] == roots[100] == 99 and roots[400] == roots[301] == 300
    assert nd.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_words():
    texts = [b"a bb a", b"", b" bb\n\tccc \x0b", b"\xc3\xa9t\xc3\xa9"]
    hashes, counts, start, stop = word_hashes(texts, SPACE)
    assert counts.tolist() == [3, 0, 2, 1]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4
    assert [texts[2][a:b] for a, b in zip(start[3:5], stop[3:5])] == [b"bb", b"ccc"]


def test_prefix_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.sort(rng.choice(10_000, n, replace=False))
        gone = int(rng.integers(0, max(1, n * 15 // 100) + 1))
        b = np.sort(rng.permutation(a)[gone:])
        if 100 * len(b) >= 85 * n and len(b):
            assert set(a[:nd.first_shared(n, 85)]) & set(b[:nd.first_shared(len(b), 85)])


def near_copies(n: int, seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(len(own))] = f"own{rng.randrange(10 ** 9)}"
        texts[i] = " ".join(own)
    return texts


def test_work_on_a_group_of_near_copies_grows_with_it(spark, monkeypatch):
    """Links and dealt rows in proportion to the copies, not to their square."""
    seen = {}
    real_links, real_dealt = nd._pivot_links, nd._dealt

    def links(*args):
        found, pieces = real_links(*args)
        seen[n]["links"] = found.count()
        return found, pieces

    def dealt(pieces):
        out = real_dealt(pieces)
        seen[n]["dealt"] = out.count()
        return out
    monkeypatch.setattr(nd, "_pivot_links", links)
    monkeypatch.setattr(nd, "_dealt", dealt)
    for n in (400, 1600):
        seen[n] = {}
        docs = spark.createDataFrame(list(near_copies(n, 3).items()), "doc_id long, text string").repartition(4)
        got = {r.component_id for r in nd.near_dedup(docs).collect()}
        assert got == {0}
    assert seen[1600]["links"] <= 1600 and seen[400]["links"] <= 400
    assert seen[1600]["dealt"] <= 5 * seen[400]["dealt"] + 1600


def test_union_estimate(spark):
    """The estimate of the merged sketches is near the similarity of the sets."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 62, int(4000 * share))
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, (4000 - len(both)) // 2)])) for _ in range(2))
        x, y = a[:1200], b[:1200]
        common = np.intersect1d(x, y)
        at = [int(np.searchsorted(s, common[-1])) + 1 for s in (x, y)]
        row = spark.range(1).select(nd.union_estimate(F.lit(len(common)), F.lit(at[0]), F.lit(at[1])).alias("e")).first()
        assert abs(row.e - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05
