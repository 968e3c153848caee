"""Language ID and quality: fitted on the training share, measured on the held-out one."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotquery.llm import langid
from lotquery.llm.common import table
from lotquery.llm.quality import BINS, DEPTH, FEATURES, fit_trees, score_quality, statistics

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


@pytest.fixture(scope="module")
def chain():
    import random
    rng = random.Random(1)
    parts = {"de": ["schen", "ung", "keit", "ver", "ß"], "es": ["ción", "ado", "mente", "ñ", "ar"]}
    text = lambda k: " ".join("".join(rng.choices(parts[k], k=rng.randint(1, 3))) for _ in range(60))
    langs = ["de", "es"] * 40
    return langid.fit([text(k).encode() for k in langs], langs), text


def test_words_of_code_switched_text(chain):
    model, text = chain
    mixed = (text("de") + " " + text("es")).encode()
    codes, start, length, _ = langid.cut_words([mixed])
    hashes, place, kind = langid.word_types(codes, start, length)
    scores = model.emissions(*langid.ngrams(codes, start[place], length[place]), model.entry(hashes))[kind]
    p, *_ = model.marginals(scores, np.array([len(start)]))
    labels = [model.labels[i] for i in p.argmax(axis=1)]
    assert labels.count("de") in range(57, 64) and np.mean(np.array(labels[:60]) == "de") > 0.95
    assert langid.predict(model, [mixed, b"12 !", b"", text("es").encode()])[0] == ["de", "und", "und", "es"]
    assert model.moves[0, 0] > model.moves[0, 1] and model.moves[1, 1] > model.moves[1, 0]


def test_marginals_match_enumeration():
    import itertools
    rng = np.random.default_rng(3)
    model = langid.Chain(["a", "b", "c"], np.empty(0, np.uint64))
    model.moves, model.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 0, 1, 5])
    scores = rng.normal(size=(10, 3))
    p, moves, first = model.marginals(scores, lengths)
    expected, pairs, at = np.zeros((10, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=int(n))) if n else []
        weights = np.array([np.exp(model.first[y[0]] + sum(scores[at + i, y[i]] for i in range(n))
                                   + sum(model.moves[y[i - 1], y[i]] for i in range(1, n))) for y in paths])
        for y, w in zip(paths, weights / weights.sum() if n else [], strict=True):
            for i in range(n):
                expected[at + i, y[i]] += w
                if i:
                    pairs[y[i - 1], y[i]] += w
        at += n
    assert np.allclose(p, expected, atol=1e-5) and np.allclose(moves, pairs, atol=1e-4)
    assert np.allclose(first, expected[[0, 4, 5]].sum(axis=0), atol=1e-5)


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = score_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, len(FEATURES)))
    model = fit_trees(x, (x[:, 3] + x[:, 7] * x[:, 1] > 0).astype(float))
    binned = model.bins(x)
    assert binned.max() < BINS
    for t in (0, 5):
        for i in range(0, 500, 50):
            node = 0
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[i, model.feature[t][node]] > model.threshold[t][node])
            assert model.walk(binned[i:i + 1], t)[0] == node - (2 ** DEPTH - 1)
    assert np.mean((model.score(x) > 0.5) == (x[:, 3] + x[:, 7] * x[:, 1] > 0)) > 0.9


def test_statistics_are_finite():
    for text in (b"", b" ", b"\n\n", b"\x00", b"a" * 100_000, "é ñ".encode(), b"!!! ???"):
        got = statistics(text)
        assert len(got) == len(FEATURES) and np.isfinite(got).all()
