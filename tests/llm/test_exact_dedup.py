import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lotquery.llm.exact_dedup import CuckooIndex, exact_dedup, live_entries, retract


def key(i: int) -> bytes:
    return hashlib.sha256(str(i).encode()).digest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 80)), max_size=400))
def test_index_is_a_map(steps):
    index, model = CuckooIndex(1), {}
    for insert, i in steps:
        if insert and i not in model:
            index.insert(key(i), i)
            model[i] = True
        elif not insert:
            assert index.delete(key(i)) == (model.pop(i, None) is not None)
        assert (index.find(key(i)) >= 0) == (i in model)
    assert index.size == len(model) and {v for _, v in index.items()} == set(model)


def test_overflow_resizes_from_stored_keys():
    index = CuckooIndex(1)
    for i in range(5_000):
        index.insert(key(i), i)
    assert index.size == 5_000 and index.mask > 1_000
    assert all(index.values[index.find(key(i))] == i for i in range(5_000))


def test_colliding_fingerprints_are_verified():
    index = CuckooIndex(1)
    same = [bytes(10) + bytes([i]) * 22 for i in range(8)]  # one bucket pair, one fingerprint
    for k in same[:7]:
        index.insert(k, k)
    assert index.find(same[7]) == -1 and all(index.values[index.find(k)] == k for k in same[:7])


def test_against_groups(spark):
    rng = random.Random(3)
    texts = [(i, rng.choice([f"text {rng.randint(0, 60)}", "hot", None, "", "A", "a", "a "])) for i in range(600)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    for i, t in texts:
        own = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))


def test_retract(spark):
    entries = spark.createDataFrame([(key(i % 7), i, 1) for i in range(50)], "digest binary, keep_id long, group_size long")
    live = live_entries(entries)
    gone = spark.createDataFrame([(bytearray(key(1)),), (bytearray(key(1)),), (bytearray(key(99)),)], "digest binary")
    left = {bytes(r.digest): (r.keep_id, r.group_size) for r in retract(live, gone).collect()}
    assert left == {key(i): (max(range(i, 50, 7)), len(range(i, 50, 7))) for i in (0, 2, 3, 4, 5, 6)}
