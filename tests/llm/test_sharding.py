import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lotquery.llm import sharding
from lotquery.llm.sharding import CapacityTree, pack, pack_into, shard_documents


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 150))
def test_pack_is_best_fit_decreasing(sizes, capacity):
    items = [(s, i) for i, s in enumerate(sizes)]
    where, bins = pack(items, capacity)
    left, naive = [], {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        fits = [(room, b) for b, room in enumerate(left) if room >= size]
        if fits:
            room, b = min(fits)
        else:
            b = len(left)
            left.append(capacity)
        left[b] -= size
        naive[name] = b
    assert where == naive and bins == len(left)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), unique=True, max_size=80), st.integers(0, 22))
def test_tree_finds_the_tightest(keys, size):
    tree = CapacityTree()
    for k in keys:
        tree.add(k)
    assert tree.take_tightest(size) == min((k for k in keys if k[0] >= size), default=None)


def test_pack_into_evens_sizes():
    rng = random.Random(2)
    items = [(rng.randint(1, 40), i) for i in range(2_000)] + [(30_000, "whole")]
    where = pack_into(items, 24)
    load = [0] * 24
    for size, name in items:
        load[where[name]] += size
    assert sum(x == 30_000 for x in load) == 1
    rest = sorted(load)[:-1]
    assert rest[-1] - rest[0] <= 0.01 * rest[-1]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    rng = random.Random(4)
    docs = [(i, rng.choice(["copy " * 30, "x" * rng.randint(0, 400), None])) for i in range(1_000)]
    got = shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 5).collect()
    assert len(got) == 1_000
    shard_of, load = {}, {}
    texts = dict(docs)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and r["size"] == len(texts[r.doc_id] or "") + 8
        assert shard_of.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    copies = 158 * sum(t == "copy " * 30 for t in texts.values())
    others = [v for s, v in load.items() if s != shard_of["copy " * 30]]
    assert load[shard_of["copy " * 30]] >= copies and max(others) - min(others) <= 0.02 * max(others) + 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 12)), max_size=20), st.integers(60, 200))
def test_runs_are_packed_like_their_items(runs, capacity):
    """A run of equal items fills the bins that best fit decreasing gives them one by one."""
    where, bins = sharding.pack_runs([(s, i, n) for i, (s, n) in enumerate(runs)], capacity)
    single, count = pack([(s, (i, k)) for i, (s, n) in enumerate(runs) for k in range(n)], capacity)
    assert bins == count
    for i, (_, n) in enumerate(runs):
        taken = [b for b, m in where[i] for _ in range(m)]
        assert len(taken) == n and sorted(taken) == sorted(single[i, k] for k in range(n))


def test_small_groups_are_packed_by_size(spark, monkeypatch):
    """No group is large: all are packed as classes, and shards are near equal."""
    monkeypatch.setattr(sharding, "LARGE", 1)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 500)
    rng = random.Random(6)
    docs = [(i, "".join(rng.choices("abcdef", k=rng.choice([5, 20, 20, rng.randint(0, 300)])))) for i in range(6_000)]
    docs += [(10_000 + i, "the same text") for i in range(300)] + [(20_000 + i, None) for i in range(50)]
    got = shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 6).collect()
    texts, shard_of, load = dict(docs), {}, [0] * 6
    for r in got:
        assert shard_of.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
        load[r.shard] += r["size"]
    assert len(got) == len(docs) and max(load) - min(load) <= 0.01 * max(load)
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_rows_without_an_id_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    docs = [(None, f"text {i}") for i in range(200)]
    got = shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
