import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotquery.llm import line_dedup as ld


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), max_size=500))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.uint64)
    table = ld.PerfectHash(keys)
    assert sorted(table.number(keys).tolist()) == list(range(len(keys)))


def test_perfect_hash_keeps_what_no_level_places(monkeypatch):
    monkeypatch.setattr(ld, "LEVELS", 1)
    keys = np.arange(1, 2_000, dtype=np.uint64)
    table = ld.PerfectHash(keys)
    assert len(table.rest) and sorted(table.number(keys).tolist()) == list(range(len(keys)))


def brute(docs, min_points, min_docs):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_points:
                holders.setdefault(k, []).append(i)
    often = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if often.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["Äöü".center(n) + "X" * n for n in range(1, 12)] + ["", "  ", "Été ", "aXb" * 5]
    docs = [(i, rng.choice([None, ""]) if rng.random() < 0.05 else "\n".join(
        rng.choice(["\t", "", " ", "\r"]) + rng.choice(pool).swapcase() * (rng.random() < 0.7) + rng.choice(pool)
        for _ in range(rng.randint(1, 8)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    expected = brute(docs, 6, 3)
    for options in ({}, {"wave_bytes": 1, "shard_keys": 10}):  # one wave, then a wave for each shard
        got = {r.doc_id: tuple(r)[1:] for r in ld.line_dedup(df, 6, 3, **options).collect()}
        assert got == expected
