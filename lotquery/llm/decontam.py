"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of a few megabytes inside a Spark task.  Its
words become symbols of the benchmark's vocabulary.  Words beyond it, and runs
of known words shorter than any phrase, hold no occurrence and turn into
separators.  The shard's FM-index is the Burrows-Wheeler transform of that
sequence in a wavelet tree, with suffix positions sampled.  All phrases are
searched backwards at once by wavelet-tree ranks, occurrences are located by
walking to the next sample, and their spans are merged.

Phrases reach the tasks in blocks of at most ``BLOCK_WORDS`` words; with more
than one block the documents' marks are stored in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import NO_WORD, map_texts, opened, released, ship, stored, utf8, word_hashes

WINDOW = 10
BLOCK_WORDS = 1_000_000
SAMPLE = 32


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of symbols (0: separators, which all differ, in order of
    place), by prefix doubling; sorted parts are left alone."""
    n = len(text)
    gaps = text == 0
    first = np.where(gaps, np.cumsum(gaps) - 1, text + gaps.sum())
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = first[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 1
    while True:
        alone = heads & np.concatenate([heads[1:], [True]])
        open_ = np.flatnonzero(~alone)  # places in the order that aren't settled
        if not len(open_):
            return order
        at = order[open_]
        ahead = at + h
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + nxt
        by = np.argsort(key, kind="stable")
        order[open_] = at[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        heads[open_] = new
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks and access of symbols; one bit vector a level, zeros before ones."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            zeros = int(len(symbols) - ones.sum())
            self.levels.append((bit, Bits(ones), zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low, high = np.zeros_like(i), i
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one = bits.at(i)
            ones = bits.rank(i)
            out |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return out


class FMIndex:
    """Index of a sequence of symbols 1 to sigma - 1 with separators 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_order(text)
        n = len(text)
        self.tree = WaveletTree(np.where(order > 0, text[order - 1], 0), sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # Every SAMPLE-th position, and those after a separator: no walk crosses one.
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.sampled, self.samples, self.n = Bits(kept), order[kept], n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase (its
        symbols in a row of ``phrases``)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            a = self.first[c] + self.tree.rank(c, low[live])
            b = self.first[c] + self.tree.rank(c, high[live])
            low[live], high[live] = a, b
            live = live[a < b]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            known = self.sampled.at(rows)
            out[todo[known]] = self.samples[self.sampled.rank(rows[known])] + steps
            todo, rows = todo[~known], rows[~known]
            c = self.tree.at(rows)
            rows = self.first[c] + self.tree.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The distinct windows of benchmark items, by length, with their items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        hashes, counts, *_ = word_hashes([t.lower() for _, t in items], NO_WORD)
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        found: dict[int, dict[bytes, set[int]]] = {}
        at = 0
        for (name, _), n in zip(items, counts.tolist(), strict=True):
            wide = min(n, window)
            for k in range(n - wide + 1 if n else 0):
                key = symbols[at + k:at + k + wide].tobytes()
                found.setdefault(wide, {}).setdefault(key, set()).add(number[name])
            at += n
        self.by_length = {wide: (np.frombuffer(b"".join(keys), np.int64).reshape(-1, wide),
                                 [np.array(sorted(x)) for x in keys.values()]) for wide, keys in found.items()}
        self.least = min(found, default=0)


def occurrences(phrases: Phrases, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
    """Of a shard's words: which are in an occurrence; of its documents: the
    numbers of the items that occur."""
    covered, items = np.zeros(len(hashes) + 1, np.int64), [set() for _ in counts]
    if not phrases.least or not len(hashes):
        return covered[:-1] > 0, items
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[at] == hashes, at + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    # Runs of known words within a document, long enough for the shortest phrase.
    begins = (symbols > 0) & np.concatenate([[True], (symbols[:-1] == 0) | (doc[1:] != doc[:-1])])
    run = np.cumsum(begins) * (symbols > 0)
    kept = (np.bincount(run)[run] >= phrases.least) & (run > 0)
    word = np.flatnonzero(kept)
    if not len(word):
        return covered[:-1] > 0, items
    ends = np.concatenate([run[word][1:] != run[word][:-1], [True]])
    place = np.arange(len(word)) + np.concatenate([[0], np.cumsum(ends)[:-1]])
    text = np.zeros(len(word) + int(ends.sum()), np.int64)
    text[place] = symbols[word]
    word_at = np.zeros(len(text), np.int64)
    word_at[place] = word
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    for wide, (matrix, owners) in phrases.by_length.items():
        low, high = index.search(matrix)
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        if not len(hit):
            continue
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        start = word_at[index.locate(rows)]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + wide, -1)
        which = np.repeat(hit, times)
        for d, p in set(zip(doc[start].tolist(), which.tolist(), strict=True)):
            items[d].update(owners[p].tolist())
    return np.cumsum(covered)[:-1] > 0, items


def _mark(sent):
    """Adds a block's hits to the columns _cover (a byte a word) and _items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = opened(sent)
        for batch in batches:
            hashes, counts, *_ = word_hashes([t.lower() for t in utf8(batch)], NO_WORD)
            hit, items = occurrences(phrases, hashes, counts)
            ends = np.cumsum(counts)
            cover, names = [], []
            for n, end, found, old, known in zip(counts.tolist(), ends.tolist(), items, batch.column("_cover").to_pylist(),
                                                 batch.column("_items").to_pylist(), strict=True):
                now = hit[end - n:end].astype(np.uint8)
                cover.append((now | np.frombuffer(old, np.uint8) if old is not None else now).tobytes())
                names.append(sorted({phrases.names[i] for i in found}.union(known or ())))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"_cover": pa.array(cover, pa.binary()), "_items": pa.array(names, pa.list_(pa.string()))}
            yield pa.record_batch(list(columns.values()), names=list(columns))
    return run


def phrase_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark in blocks of items with ``block_words`` words at most (one
    item at least); a null item_id is named ''."""
    items, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    for row in rows.toLocalIterator():  # a block at a time
        text = (row.text or "").encode()
        words = int(word_hashes([text.lower()], NO_WORD)[1][0])
        if items and held + words > block_words:
            yield Phrases(items, window)
            items, held = [], 0
        items.append((row.name, text))
        held += words
    yield Phrases(items, window)


def mark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (text and columns of other names) with _cover (a byte for each
    word: 1 inside an occurrence) and _items (names of the items that occur, sorted)."""
    spark = docs.sparkSession
    marked = docs.withColumns({"_cover": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")})
    for i, phrases in enumerate(phrase_blocks(benchmark, window, block_words)):
        if i:
            marked = stored(marked, "benchmark-marks")
        marked = map_texts(marked, _mark(ship(spark, phrases)), marked.schema)
    return marked


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated.  ``benchmark``: item_id, text.

    Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lowered.  A
    window is ``window`` words of an item that follow each other, or a shorter
    item's words; items and documents without words (null texts included) have
    none.  Rows that repeat are treated alike; items that share an item_id
    count once.  Without items nothing is hit; an empty table of documents
    gives an empty result.  Other columns are ignored.
    """
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cover, items = batch.column("_cover").to_pylist(), batch.column("_items").to_pylist()
            hits = [int(np.frombuffer(c, np.uint8).sum()) for c in cover]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([len(c) for c in cover], pa.int64()), pa.array(hits, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([h > 0 for h in hits])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    marked = mark_hits(docs.select("doc_id", "text"), benchmark, window, block_words)
    return marked.select("doc_id", "_cover", "_items").mapInArrow(
        released(tell), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                         block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the merged spans of benchmark windows cut from text, from
    the first word's start to the last one's end, and n_chars (if there is such
    a column) counted again; documents that lose all their words go.  Others
    stay as they are, null texts too."""
    counted = "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = batch.column("text").to_pylist(), []
            chars = batch.column("n_chars").to_pylist()
            for k, cover in enumerate(batch.column("_cover").to_pylist()):
                hit = np.frombuffer(cover, np.uint8)
                stay.append(not len(hit) or not hit.all())
                if hit.any() and stay[-1]:
                    raw = texts[k].encode()
                    _, _, start, stop = word_hashes([raw.lower()], NO_WORD)
                    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                    parts, at = [], 0
                    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                        parts.append(raw[at:start[a]])
                        at = stop[b - 1]
                    texts[k] = b"".join([*parts, raw[at:]]).decode()
                    chars[k] = len(texts[k])
            yield pa.record_batch([pa.array(texts, pa.string()), pa.array(chars, pa.int64()), batch.column("row")],
                                  names=["text", "n_chars", "row"]).filter(pa.array(stay, pa.bool_()))

    # The other columns travel as one struct, so their names meet none of the marks'.
    others = [c for c in docs.columns if c not in {"text", "n_chars"}]
    carried = docs.select("text", (F.col("n_chars") if counted else F.lit(None)).cast("long").alias("n_chars"),
                          F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"{i}") for i, c in enumerate(others)]).alias("row"))
    left = map_texts(mark_hits(carried, benchmark, window, block_words), cut, carried.schema)
    types = {f.name: f.dataType for f in docs.schema}
    return left.select(*[F.col(c).cast(types[c]).alias(c) if c in {"text", "n_chars"} else F.col(f"row.`{others.index(c)}`").alias(c)
                         for c in docs.columns])
