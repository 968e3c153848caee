"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts in Spark tasks.  The trees are fitted
on a sample of labelled documents of at most ``SAMPLE_ROWS`` rows, chosen by a
hash of the doc_id, and flattened into arrays; scoring walks all documents of a
batch down each tree at once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import map_texts, opened, share, ship, stored, utf8

SAMPLE_ROWS = 20_000
HELD_OUT_PARTS = 5
TREES, DEPTH, BINS = 120, 4, 64
RATE, L2, MIN_WEIGHT = 0.1, 1.0, 2.0
THRESHOLD = 0.3
MARKS = b"!?.,;:*#$%&|@-_/=+<>()[]{}\"'~^\\"
STOP = b".!?"
PLAIN = MARKS + b"0123456789"
MARKS_SET, STOP_SET = {bytes([c]) for c in MARKS}, {bytes([c]) for c in STOP}

FEATURES = (["bytes", "words", "lines", "word_mean", "word_max", "words_distinct", "pairs_distinct", "triples_distinct",
             "top_word", "upper_words", "title_words", "letterless_words", "marked_words", "short_words", "line_mean",
             "line_max", "lines_distinct", "lines_stopped", "lines_short", "upper", "lower", "digits", "space", "marks",
             "beyond_ascii", "control", "byte_entropy", "packed"] + [f"mark_{m}" for m in MARKS])


def statistics(text: bytes) -> list[float]:
    """The numbers of FEATURES for one whole text; shares of nothing are 0."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    part = counts / n
    words = text.split()
    w = max(1, len(words))
    lengths = [len(x) for x in words] or [0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    line_lengths = [len(x) for x in lines] or [0]
    top = Counter(words).most_common(1)
    seen = part[part > 0]
    marks = [part[c] for c in MARKS]
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), sum(lengths) / w, math.log1p(max(lengths)),
        len(set(words)) / w, len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2),
        (top[0][1] if top else 0) / w, sum(map(bytes.isupper, words)) / w, sum(map(bytes.istitle, words)) / w,
        sum(not x.strip(PLAIN) for x in words) / w,
        sum(x[-1:] in MARKS_SET for x in words) / w, sum(k <= 3 for k in lengths) / w,
        sum(line_lengths) / m, math.log1p(max(line_lengths)), len(set(lines)) / m,
        sum(x.rstrip()[-1:] in STOP_SET for x in lines) / m, sum(k < 20 for k in line_lengths) / m,
        part[65:91].sum(), part[97:123].sum(), part[48:58].sum(), part[[9, 10, 11, 12, 13, 32]].sum(), sum(marks),
        part[128:].sum(), part[:9].sum() + part[14:32].sum(), float(-(seen * np.log(seen)).sum()),
        len(zlib.compress(text, 1)) / n, *marks]



class Trees:
    """Boosted trees as arrays: node i of tree t splits at feature[t, i], bin
    threshold[t, i]; its children are 2i + 1 and 2i + 2; leaves hold values."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.feature, self.threshold, self.value = [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def walk(self, binned: np.ndarray, t: int) -> np.ndarray:
        """The leaf of each row in tree ``t``."""
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(DEPTH):
            right = binned[rows, self.feature[t][at]] > self.threshold[t][at]
            at = 2 * at + 1 + right
        return at - (2 ** DEPTH - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        margin = np.full(len(x), self.base)
        for t in range(len(self.value)):
            margin += self.value[t][self.walk(binned, t)]
        return 1 / (1 + np.exp(-margin))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the log loss of labels 0 and 1 over statistics ``x``."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0)
             for j in range(len(FEATURES))]
    p = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
    model = Trees(edges, math.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        return model
    binned = model.bins(x)
    n, f = x.shape
    flat = binned + np.arange(f) * BINS
    margin = np.full(n, model.base)
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        feature, threshold = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, 255, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            wide = 2 ** level
            place = (flat + (node * f * BINS)[:, None]).ravel()
            g = np.bincount(place, np.repeat(grad, f), wide * f * BINS).reshape(wide, f, BINS).cumsum(axis=2)
            h = np.bincount(place, np.repeat(hess, f), wide * f * BINS).reshape(wide, f, BINS).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all ** 2 / (h_all + L2)
            gain[(h < MIN_WEIGHT) | (h_all - h < MIN_WEIGHT)] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            for k in range(wide):
                if gain[k].flat[best[k]] > 1e-6:
                    feature[wide - 1 + k], threshold[wide - 1 + k] = divmod(best[k], BINS)
            at = wide - 1 + node
            node = 2 * node + (binned[np.arange(n), feature[at]] > threshold[at])
        leaves = 2 ** DEPTH
        value = -RATE * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + L2)
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
        margin += value[node]
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in utf8(batch)]
        yield pa.record_batch([batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], names=["quality", "x"])


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sent)
        for batch in batches:
            x = np.array([statistics(t) for t in utf8(batch)]).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])
    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the labelled rows outside the held-out share: all, or the
    ``sample_rows`` with the least hash of doc_id.  Labels other than 0 and 1
    are passed over; of several labels of a doc_id the largest counts."""
    chosen = (labels.filter(F.col("quality").isin(0, 1)).filter(share(F.col("doc_id"), HELD_OUT_PARTS) != 0)
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    chosen = F.broadcast(stored(chosen, "label-sample"))  # sample_rows rows at most
    measured = map_texts(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "quality"),
                         _measure, "quality int, x array<double>")
    # Statistics of sample_rows documents; a doc_id on several rows adds each.
    rows = measured.limit(2 * sample_rows).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["quality"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, held_out, score,
    predicted.  ``labels``: doc_id, quality.

    Null texts are scored as empty ones; repeated rows alike.  A null doc_id is
    not held out and never learnt from.  Without labels, or with one label
    only, all documents get the share of label 1 (0.5 without labels), held to
    0.01 to 0.99.  An empty table gives an empty result.  Other columns are
    ignored.
    """
    sent = ship(docs.sparkSession, train(docs, labels, sample_rows))
    scored = map_texts(docs.select("doc_id", "text"), _score(sent), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(share(F.col("doc_id"), HELD_OUT_PARTS) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
