"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lotquery.llm.periodic_runs import Grammar, find_runs, merged, periodic_runs, run_digests
from lotquery.llm.queries import op12_periodic_runs

from .conftest import rows


def brute(words):
    """(start, length, period) by start, then period."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(documents):
    sizes = np.array([len(d) for d in documents], np.int64)
    start, end, period = find_runs(np.array([w for d in documents for w in d], np.int64), sizes)
    begins = np.cumsum(sizes) - sizes
    got = [[] for _ in documents]
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        d = int(np.searchsorted(begins + sizes, s, side="right"))
        got[d].append((s - int(begins[d]), e - s, q))
    return got


@pytest.mark.parametrize("letters, longest, seed", [(1, 40, 1), (2, 60, 2), (3, 90, 3), (6, 120, 4)])
def test_random_documents(letters, longest, seed):
    dice = random.Random(seed)
    documents = []
    for _ in range(600):
        words = [dice.randrange(letters) for _ in range(dice.randrange(longest))]
        if words and dice.random() < 0.6:
            a = dice.randrange(len(words))
            p = 1 + dice.randrange((len(words) - a) // 4 + 1)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            if dice.random() < 0.4:
                words[dice.randrange(len(words))] = 9
            if dice.random() < 0.3:
                words += words[:len(words) // 2]
        documents.append(words)
    assert runs_of(documents) == [brute(d) for d in documents]


def test_special_documents():
    fibonacci, before = [1, 0], [1]
    while len(fibonacci) < 500:
        fibonacci, before = fibonacci + before, fibonacci
    thue = [bin(i).count("1") % 2 for i in range(512)]
    documents = [[7] * 1000, [1, 2] * 300 + [1], fibonacci, thue, [], [5], list(range(500)), (list(range(90)) * 5)[:400],
                 ([1] * 7 + [2]) * 9, [3] * 6, [3] * 5, [1, 2, 3] * 4, ([1, 2, 3] * 4)[:-1]]
    got = runs_of(documents)
    assert got == [brute(d) for d in documents]
    assert got[0] == [(0, 1000, 1)] and got[11] == [(0, 12, 3)] and got[12] == []


def test_neighbouring_documents_stay_apart():
    assert runs_of([[1] * 3, [1] * 3, [1] * 6]) == [[], [], [(0, 6, 1)]]


def test_grammar_derives_the_text():
    """Each rule's places all hold the same words, and repeats are compressed."""
    words = np.array(list(range(20)) * 50 + [7] * 64, np.int64)
    grammar = Grammar(words, np.zeros(len(words), np.int64))
    assert len(grammar.borders) < 20 and len(grammar.low) < 200
    for rule, start in zip(grammar.rule, grammar.start):
        low, high = grammar.low[rule], grammar.high[rule]
        assert (words[low:high] == words[start:start + high - low]).all() and low < grammar.middle[rule] < high


def test_merged():
    got = merged(np.array([4, 0, 7, 0, 20]), np.array([10, 6, 12, 9, 30]), np.array([2, 2, 3, 1, 2]))
    assert [x.tolist() for x in got] == [[0, 0, 7, 20], [9, 10, 12, 30], [1, 2, 3, 2]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return {"doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()}


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{folder}/documents.parquet"))}
    docs = {d: t for d, t in docs.items() if len(t or "") < 20_000}  # brute force is quadratic
    got = [r for r in rows(op12_periodic_runs(spark, folder)) if r["doc_id"] in docs]
    assert sorted(got, key=lambda r: r["doc_id"]) == [expected(d, docs[d]) for d in sorted(docs)]
    assert sum(r["n_runs"] for r in got) > 5


def test_odd_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in rows(periodic_runs(odd_docs))}
    assert got[3]["n_words"] == got[4]["n_words"] == 0 and got[3]["runs"] == [] and got[4]["collapsed"] == ""
    assert [tuple(r) for r in got[5]["runs"]] == [(0, 80_000, 2)]
    assert got[5]["collapsed"] == "Lorem wird " + "x" * 50_000 and got[-8]["collapsed"] == "a b c"
    digests = rows(run_digests(periodic_runs(odd_docs)))
    assert len(digests) == 10 and next(r for r in digests if r["doc_id"] is None)["start"] is None
    assert rows(run_digests(periodic_runs(no_docs))) == []
