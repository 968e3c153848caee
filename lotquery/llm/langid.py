"""Language ID by a linear-chain conditional random field over words.

Every word (a run of letters, lower-cased) gets a label.  Its features are its
letter n-grams with word boundaries, so those at a boundary are affixes, and
its entry in a learnt lexicon.  Learnt transitions tie neighbouring words.
Forward-backward gives each word's label probabilities, also where a text
switches languages; their mean over a document's words is its language's score.

Scores sum to 1 over the learnt languages whatever the text.  What tells that a
text is in one of them at all is the share of its words that look learnt: by
the lexicon, or by n-grams of training words.

All arrays: a batch's texts are one array of code points, its distinct words
are scored once, and forward-backward runs over all documents of a batch in
step, longest first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lotquery.llm.common import map_texts, opened, share, ship, stored, utf8

HELD_OUT, PARTS = 2, 4
#: Labelled texts to learn from, of all languages together, and the longest of them.
SAMPLE_DOCS, SAMPLE_CHARS = 1_000, 20_000
ORDERS = (1, 2, 3, 4)
#: N-grams of this order, word boundaries included, tell learnt words from others.
SEEN_ORDER = 4
TABLE_BITS = 16
LEXICON_MIN = 5
#: Words of one language in a training sequence, and parts of a sequence.
RUN_WORDS, RUNS = 25, 4
STEPS, RATE, L2 = 30, 0.3, 1e-3
UNKNOWN = "und"
#: A document in several languages belongs to the one it opens in: its first
#: OPENING_WORDS count this much more, together, against all its words.
OPENING_WORDS, OPENING = 10, 0.3
PRIME = 0x100000001B3
BEGIN, END = 2, 3


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and of all words the start, the
    length and the text's number."""
    lower = [t.decode("utf-8", "replace").lower() for t in texts]
    codes = np.frombuffer("\n".join(lower).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lower])
    table = _letters()
    edge = np.diff(np.concatenate([[0], table[codes].astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return codes, start, stop - start, np.searchsorted(ends, start, side="right")


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(max(n - 1, 0), PRIME, np.uint64)]).astype(np.uint64))


def word_types(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct words, a place of each among the words,
    and each word's distinct word."""
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    offset = np.concatenate([[0], np.cumsum(length)])[:-1]
    within = np.arange(length.sum(), dtype=np.int32) - np.repeat(offset.astype(np.int32), length)
    mixed = codes[np.repeat(start.astype(np.int32), length) + within].astype(np.uint64)
    mixed += np.uint64(0x9E3779B9)
    mixed *= _powers(int(length.max()))[within]
    return np.unique(np.add.reduceat(mixed, offset), return_index=True, return_inverse=True)


def features(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: table rows of all their n-grams, and each one's word;
    hashes of those of SEEN_ORDER (of shorter words: the word), and each one's word."""
    wide = length + 2
    offset = np.concatenate([[0], np.cumsum(wide)])
    within = np.arange(offset[-1]) - np.repeat(offset[:-1], wide)
    inner = (within > 0) & (within < np.repeat(wide, wide) - 1)
    text = np.where(within == 0, BEGIN, END).astype(np.uint64)
    text[inner] = codes[(np.repeat(start, wide) + within - 1)[inner]]
    left = np.repeat(wide, wide) - within
    word = np.repeat(np.arange(len(start)), wide)
    rows, owners, marks, marked = [], [], [], []
    for n in ORDERS:
        fits = left >= n
        at = np.flatnonzero(fits)
        h = np.full(len(at), n * 0x51ED270B, np.uint64)
        for k in range(n):
            h = (h ^ text[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        rows.append((h >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
        owners.append(word[at])
        if n <= SEEN_ORDER:
            tells = np.flatnonzero((n == SEEN_ORDER) | (wide[word[at]] == n))
            marks.append(h[tells])
            marked.append(word[at[tells]])
    return np.concatenate(rows), np.concatenate(owners), np.concatenate(marks), np.concatenate(marked)


def ngrams(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct words: table rows of all their n-grams, and each one's word."""
    return features(codes, start, length)[:2]


class Chain:
    """Weights of the field: n-gram table, lexicon, transitions, first label."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.seen = np.empty(0, np.uint64)  # n-grams of training words, sorted
        self.table = np.zeros((2 ** TABLE_BITS, k), np.float64)
        self.entries = np.zeros((len(lexicon) + 1, k), np.float64)
        self.moves = np.zeros((k, k), np.float64)
        self.first = np.zeros(k, np.float64)

    def entry(self, hashes: np.ndarray) -> np.ndarray:
        """The lexicon rows of words; the last row for others."""
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def learnt(self, marks: np.ndarray, marked: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """0 to 1 for distinct words: 1 for those of the lexicon, else the share
        of ``marks`` (see ``features``) that training words have."""
        n = len(entries)
        found = self.seen[np.minimum(np.searchsorted(self.seen, marks), len(self.seen) - 1)] == marks if len(self.seen) else marks < 0
        return np.where(entries < len(self.lexicon), 1.0,
                        np.bincount(marked, found, n) / np.maximum(np.bincount(marked, minlength=n), 1))

    def emissions(self, rows: np.ndarray, owners: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Label scores of distinct words: mean n-gram weight and lexicon weight."""
        n = len(entries)
        count = np.bincount(owners, minlength=n)
        grams = np.stack([np.bincount(owners, self.table[rows, k], n) for k in range(len(self.labels))], axis=1)
        return grams / np.sqrt(np.maximum(count, 1))[:, None] + self.entries[entries]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over sequences of ``lengths`` words that follow each
        other in ``scores``: label probabilities of each word, expected moves,
        and the first words' label probabilities."""
        k = len(self.labels)
        order = np.argsort(-lengths, kind="stable")
        order = order[:np.count_nonzero(lengths)]
        sizes = lengths[order]
        steps = int(sizes[0]) if len(sizes) else 0
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
        off = np.concatenate([[0], np.cumsum(active)])
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(order))
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        time = np.arange(len(scores)) - np.repeat(begin, lengths)
        place = off[time] + np.repeat(rank, lengths)
        packed = np.empty((len(scores), k), np.float32)
        packed[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
        move = np.exp(self.moves - self.moves.max()).astype(np.float32)
        start = np.exp(self.first - self.first.max()).astype(np.float32)
        alpha = np.empty_like(packed)
        for t in range(steps):
            here = slice(off[t], off[t + 1])
            a = packed[here] * (start if t == 0 else alpha[off[t - 1]:off[t - 1] + active[t]] @ move)
            alpha[here] = a / (a.sum(axis=1, keepdims=True) + 1e-30)
        expected = np.zeros((k, k))
        beta = np.ones((0, k), np.float32)
        for t in range(steps - 1, -1, -1):
            here, n = slice(off[t], off[t + 1]), active[t]
            now = np.ones((n, k), np.float32)
            if t < steps - 1 and len(beta):
                ahead = beta * packed[off[t + 1]:off[t + 2]]
                now[:len(beta)] = ahead @ move.T
                both = alpha[off[t]:off[t] + len(beta)]
                total = (both * now[:len(beta)]).sum(axis=1, keepdims=True) + 1e-30
                expected += ((both / total).T @ ahead) * move
                now /= now.max(axis=1, keepdims=True) + 1e-30
            beta = now
            p = alpha[here] * beta
            alpha[here] = p / (p.sum(axis=1, keepdims=True) + 1e-30)  # read no more as forward messages
        return alpha[place], expected, alpha[:active[0] if steps else 0].sum(axis=0)


def fit(texts: list[bytes], langs: list[str]) -> Chain:
    """Weights that maximise the likelihood of sequences cut from labelled
    texts: runs of words of different texts in turn, as in code-switched text."""
    labels = sorted(set(langs))
    codes, start, length, doc = cut_words(texts)
    hashes, place, kind = word_types(codes, start, length)
    gold_of = np.array([labels.index(x) for x in langs], np.int64)
    seen = np.bincount(kind, minlength=len(hashes))
    chain = Chain(labels, hashes[seen >= LEXICON_MIN])
    if not len(start):
        return chain
    rows, owners, marks, _ = features(codes, start[place], length[place])
    chain.seen = np.unique(marks)
    if len(labels) < 2:
        return chain
    # Runs of RUN_WORDS words, shuffled; RUNS of them make a sequence.
    first_of = np.searchsorted(doc, np.arange(len(texts)))
    run = doc * 10 ** 9 + (np.arange(len(doc)) - first_of[doc]) // RUN_WORDS
    _, run = np.unique(run, return_inverse=True)
    shuffled = np.random.default_rng(7).permutation(run.max() + 1)[run]
    words = np.argsort(shuffled, kind="stable")
    lengths = np.bincount(shuffled[words] // RUNS)
    kind, gold = kind[words], gold_of[doc[words]]
    entries = chain.entry(hashes)
    weight = 1 / np.sqrt(np.bincount(owners, minlength=len(hashes)))[owners]
    k = len(labels)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    inner = np.ones(len(kind), bool)
    inner[begin[lengths > 0]] = False
    at = np.flatnonzero(inner)
    seen_moves = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)
    seen_first = np.bincount(gold[begin[lengths > 0]], minlength=k)
    slots = {name: np.zeros_like(getattr(chain, name)) for name in ("table", "entries", "moves", "first")}
    for _ in range(STEPS):
        p, moves, first = chain.marginals(chain.emissions(rows, owners, entries)[kind], lengths)
        p[np.arange(len(gold)), gold] -= 1
        by_type = np.stack([np.bincount(kind, p[:, j], len(hashes)) for j in range(k)], axis=1)
        n = len(kind)
        down = {"table": np.stack([np.bincount(rows, by_type[owners, j] * weight, len(chain.table)) for j in range(k)], axis=1),
                "entries": np.stack([np.bincount(entries, by_type[:, j], len(chain.entries)) for j in range(k)], axis=1),
                "moves": moves - seen_moves, "first": first - seen_first}
        for name, g in down.items():  # Adagrad
            w = getattr(chain, name)
            g = g / n + L2 * w / n
            slots[name] += g * g
            w -= RATE * g / (np.sqrt(slots[name]) + 1e-8)
    return chain


def predict(chain: Chain, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
    """Each text's label, its score, and the share of its words that look learnt."""
    codes, start, length, doc = cut_words(texts)
    labels, scores, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not len(start) or not chain.labels:
        return labels, scores, known
    hashes, place, kind = word_types(codes, start, length)
    rows, owners, marks, marked = features(codes, start[place], length[place])
    entries = chain.entry(hashes)
    by_type = chain.emissions(rows, owners, entries).astype(np.float32)
    lengths = np.bincount(doc, minlength=len(texts))
    p, *_ = chain.marginals(by_type[kind], lengths)
    total = np.stack([np.bincount(doc, p[:, j], len(texts)) for j in range(p.shape[1])], axis=1)
    mean = total / np.maximum(lengths, 1)[:, None]
    known = (np.bincount(doc, chain.learnt(marks, marked, entries)[kind], len(texts)) / np.maximum(lengths, 1)).tolist()
    first_of = np.searchsorted(doc, np.arange(len(texts)))
    early = np.arange(len(doc)) - first_of[doc] < OPENING_WORDS
    opening = np.stack([np.bincount(doc[early], p[early, j], len(texts)) for j in range(p.shape[1])], axis=1)
    choice = mean + OPENING * opening / np.maximum(np.minimum(lengths, OPENING_WORDS), 1)[:, None]
    for i in np.flatnonzero(lengths):
        best = int(choice[i].argmax())
        labels[i], scores[i] = chain.labels[best], min(1.0, float(mean[i, best]))
    return labels, scores, known


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = opened(sent)
        for batch in batches:
            labels, scores, known = predict(chain, utf8(batch))
            yield pa.record_batch([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()),
                                   pa.array(known, pa.float64())],
                                  names=[*batch.schema.names, "lang_pred", "lang_score", "lang_known"])
    return run


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Chain:
    """A chain learnt from a hash-chosen sample of labelled documents outside
    the held-out share, as many of each language as there are, up to an even
    part of ``sample_docs``."""
    known = docs.filter((F.col("lang").isNotNull()) & (F.length("text") <= SAMPLE_CHARS) & (F.length("text") > 0)
                        & (share(F.col("doc_id"), PARTS) != HELD_OUT)).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rare_first = counts.orderBy(F.desc("n"), "lang").limit(sample_docs)  # one text of a language at least
    each = sample_docs / max(1, rare_first.count())
    rates = F.broadcast(stored(rare_first.select("lang", (F.lit(each) / F.col("n")).alias("_rate")), "lang-rates"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = (known.join(rates, "lang").filter(draw < F.col("_rate"))
              .orderBy(draw / F.col("_rate"), "doc_id", "text").limit(2 * sample_docs).select("text", "lang"))
    rows = sample.collect()  # 2 * sample_docs texts of SAMPLE_CHARS at most
    return fit([r.text.encode() for r in rows], [r.lang for r in rows])


def label_languages(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with lang_pred, lang_score (0 to 1) and
    lang_known (0 to 1): the share of its words that look learnt.

    A null text, or one without letters, gets ``und``, 0 and 0.  Without labelled
    rows all get ``und``; with one language all texts with letters get it.
    Repeated rows are treated alike, empty tables give empty results, and other
    columns stay (but for columns named like the results, which are replaced).
    """
    chain = chain or train(docs)
    sent = ship(docs.sparkSession, chain)
    rows = docs.drop("lang_pred", "lang_score", "lang_known")
    return map_texts(rows, _predict(sent), StructType([*rows.schema.fields]).add("lang_pred", "string").add("lang_score", "double").add("lang_known", "double"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    named = label_languages(docs.select("doc_id", "text"), train(docs))
    return named.select("doc_id", F.coalesce(share(F.col("doc_id"), PARTS) == HELD_OUT, F.lit(False)).alias("held_out"),
                        "lang_pred", F.col("lang_score").alias("score"))
