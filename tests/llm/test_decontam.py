import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotquery.llm import decontam
from lotquery.llm.decontam import FMIndex, find_contamination, remove_contamination, suffix_order


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120))
def test_suffix_order(symbols):
    gaps = [i for i, s in enumerate(symbols) if s == 0]
    as_key = [(-1, gaps.index(i)) if s == 0 else (s, 0) for i, s in enumerate(symbols)]
    assert suffix_order(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: as_key[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=70), min_size=1, max_size=4),
       st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_search_and_locate(runs, phrase):
    text = np.array([s for run in runs for s in [*run, 0]])
    index = FMIndex(text, 6)
    low, high = index.search(np.array([phrase]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(text) - len(phrase) + 1) if text[i:i + len(phrase)].tolist() == phrase]


def brute(text, items, window):
    import re
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for i in range(len(own) - n + 1):
                if own[i:i + n] == w[k:k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(own), len(hit), len(names)


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_against_brute_force(spark, block_words):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "B", "c", "é", "x1", "zz"])
    items = [(i % 5, " ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 7])))) for i in range(7)]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs.append((99, docs[3][1] * 3))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in find_contamination(df, bench, 4, block_words).collect()}
    assert got == {i: brute(t, items, 4) for i, t in docs}
    assert len({n for _, n, _ in got.values()}) > 3


def test_spans_are_cut(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([
        (1, f"Before it, {passage.upper()}, and eleven; after."), (2, "nothing here"),
        (3, passage.replace(" ", ", ")), (4, "é " + passage + " six seven " + passage + " ü")],
        "doc_id long, text string").selectExpr("*", "length(text) AS n_chars")
    bench = spark.createDataFrame([(7, passage + " eleven"), (8, passage)], "item_id long, text string")
    left = {r.doc_id: (r.text, r.n_chars) for r in remove_contamination(docs, bench).collect()}
    texts = {1: "Before it, , and eleven; after.", 2: "nothing here", 4: "é  six seven  ü"}
    assert left == {i: (t, len(t)) for i, t in texts.items()}
    assert not any(r.contaminated for r in find_contamination(remove_contamination(docs, bench), bench).collect())


def test_phrases_in_every_position_of_a_long_text():
    phrases = decontam.Phrases([("i", b"p q r s t u v w x y")])
    hashes, counts, *_ = decontam.word_hashes([b"p q r s t u v w x y " * 3 + b"z " * 50 + b"p q r s t u v w x y"], decontam.NO_WORD)
    hit, items = decontam.occurrences(phrases, hashes, counts)
    assert hit.sum() == 40 and items == [{0}]
