"""Periodic runs of words, found through a grammar.

Each document's word ids are compressed by Re-Pair: pairs of symbols that stand
side by side more than once become nonterminals, the most frequent pair at each
place first, all places in rounds, until no pair can be replaced twice.  A run
that lies in a document lies in the expansion of some nonterminal, the smallest
of which has its border between left and right part inside the run; or it
crosses a border between the symbols that are left.  So runs are computed once
for each nonterminal, across its border and within its expansion, then
translated to all positions at which it was derived, and intervals of the same
period that share at least a period merge to maximal ones.

What crosses a border with a period in (L/2, L], at exponent 4 or more, repeats
one of three grams of L words near the border at just the period's distance;
equal grams have equal names, made by doubling, which also tell how far the
period holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import map_texts, utf8

#: A run has at least this many words, and this many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: From a document's id and words to the words whose runs are wanted.
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code's rank among the distinct ones, and each rank's count."""
    _, number, count = np.unique(codes, return_inverse=True, return_counts=True)
    return number, count


class Grams:
    """Names of all grams of 1, 2, 4, ... words that recur in their document:
    equal names for equal grams, -1 for a gram that doesn't recur."""

    def __init__(self, words: np.ndarray, end: np.ndarray) -> None:
        """``words``: ids that no two documents share; ``end``: each word's document's end."""
        self.levels: list[np.ndarray] = []
        codes, at, size = words, np.arange(len(words)), 1
        while len(at):
            number, count = _ranks(codes)
            again = count[number] > 1
            at, number = at[again], number[again]
            names = np.full(len(words), -1, np.int32)
            names[at] = number
            self.levels.append(names)
            at = at[at + 2 * size <= end[at]]
            at = at[names[at + size] >= 0]
            codes = names[at] * np.int64(len(words) + 1) + names[at + size]
            size *= 2

    def distances(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Words to the next and to the previous equal gram; 0 if there is none."""
        names = self.levels[level]
        at = np.flatnonzero(names >= 0)
        at = at[np.argsort(names[at], kind="stable")]
        same = names[at[1:]] == names[at[:-1]]
        ahead, behind = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
        ahead[at[:-1][same]] = behind[at[1:][same]] = np.diff(at)[same]
        return ahead, behind

    def extent(self, at: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch around ``at``, within [low, high), whose words
        equal those a period on: its start and end."""
        right, left = at.copy(), at.copy()  # words of [left, right) equal those a period on
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], 1 << level
            fits = np.flatnonzero(right + period + size <= high)
            x = right[fits]
            right[fits[(names[x] >= 0) & (names[x] == names[x + period[fits]])]] += size
            fits = np.flatnonzero(left - size >= low)
            x = left[fits] - size
            left[fits[(names[x] >= 0) & (names[x] == names[x + period[fits]])]] -= size
        return left, right + period


class Grammar:
    """Re-Pair over the documents of a batch at once; documents share no symbols.

    ``low``, ``middle``, ``high``: each nonterminal's expansion and the border in
    it, at one place where it was derived; ``rule`` and ``start``: all places."""

    def __init__(self, words: np.ndarray, document: np.ndarray) -> None:
        n = len(words)
        symbols, at, owner = words.astype(np.int64), np.arange(n + 1), document
        size, rules = int(words.max()) + 1 if n else 0, 0
        low, middle, high, rule, start = [], [], [], [], []
        live = np.arange(max(n - 1, 0))
        while len(live):
            live = live[owner[live] == owner[live + 1]]
            number, count = _ranks(symbols[live] * np.int64(size) + symbols[live + 1])
            weight = np.zeros(len(symbols) + 1, np.int64)  # the pair at each place; [-1] stands left of the first
            often = count[number] > 1
            weight[live[often]] = count[number[often]] * np.int64(len(count)) + number[often]
            best = np.flatnonzero((weight[:-1] > 0) & (weight[:-1] >= np.roll(weight, 1)[:-1]) & (weight[:-1] >= weight[1:]))
            # of places in a row with the same pair (three equal symbols), every other one
            head = np.concatenate([[True], (np.diff(best) > 1) | (weight[best[1:]] != weight[best[:-1]])]) if len(best) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(head, np.arange(len(best)), 0)) if len(best) else best
            best = best[(np.arange(len(best)) - first) % 2 == 0]
            pair, many = _ranks(weight[best])
            twice = many[pair] > 1
            best, pair = best[twice], np.cumsum(many > 1)[pair[twice]] - 1
            if not len(best):
                break
            new = int(pair.max()) + 1
            one = np.empty(new, np.int64)
            one[pair[::-1]] = best[::-1]
            low.append(at[one])
            middle.append(at[one + 1])
            high.append(at[one + 2])
            rule.append(rules + pair)
            start.append(at[best])
            symbols[best] = size + pair
            stays = np.ones(len(symbols), bool)
            stays[best + 1] = False
            touched = np.zeros(len(symbols), bool)
            touched[live[often]] = touched[best] = True
            touched[best[best > 0] - 1] = True  # a pair with a new symbol on its right
            touched[np.maximum(best - 2, 0)] |= ~stays[np.maximum(best - 1, 0)]
            symbols, owner, touched = symbols[stays], owner[stays], touched[stays]
            at = at[np.concatenate([stays, [True]])]
            live = np.flatnonzero(touched[:-1])
            size, rules = size + new, rules + new
        empty = [np.zeros(0, np.int64)]
        self.low, self.middle, self.high = (np.concatenate(x or empty) for x in (low, middle, high))
        self.rule, self.start = (np.concatenate(x or empty) for x in (rule, start))
        inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        self.borders, self.border_owner = at[inner], owner[inner]


def crossing_runs(grams: Grams, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs within [low, high) that cross ``middle``: index, start, end and
    period of each (some of them more than once)."""
    found = []
    for level in range(len(grams.levels)):
        size = 1 << level
        wide = np.flatnonzero(high - low >= max(LEAST_LENGTH, LEAST_EXPONENT * (size // 2 + 1)))
        if not len(wide):
            break
        ahead, behind = grams.distances(level)
        for offset in {0, size, size // 2}:
            at = middle[wide] - offset
            inside = np.flatnonzero((at >= low[wide]) & (at + size <= high[wide]))
            which, at = wide[inside], at[inside]
            for period, back in ((ahead[at], 0), (behind[at], 1)):
                fits = (period > size // 2) & (period <= size)
                i, q = which[fits], period[fits].astype(np.int64)
                x = at[fits] - back * q
                fits = (x >= low[i]) & (x + q + size <= high[i])
                i, q, x = i[fits], q[fits], x[fits]
                start, end = grams.extent(x, q, low[i], high[i])
                fits = (end - start >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * q)) & (start < middle[i]) & (end > middle[i])
                found.append((i[fits], start[fits], end[fits], q[fits]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that share at least that many words, as one;
    sorted by start, then period."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[0], np.diff(period) != 0]))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far)
    head = np.concatenate([[True], (start[1:] + group[1:] * far + period[1:] > reach[:-1])])
    first = np.flatnonzero(head)
    start, end, period = start[first], np.maximum.reduceat(end, first), period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents of ``sizes`` words laid one behind the other:
    start, end (places in ``words``) and period, by start, then period.
    ``words``: ids, equal for equal words."""
    document = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    own, _ = _ranks(document * np.int64(int(words.max()) + 1 if len(words) else 1) + words)
    grams, grammar = Grams(own, ends[document]), Grammar(own, document)
    long = np.flatnonzero(grammar.high - grammar.low >= LEAST_LENGTH)
    i, start, end, period = crossing_runs(grams, grammar.low[long], grammar.middle[long], grammar.high[long])
    i = long[i]
    # once for each place where the nonterminal was derived
    order = np.argsort(grammar.rule, kind="stable")
    places, count = grammar.start[order], np.bincount(grammar.rule, minlength=len(grammar.low))
    before = np.concatenate([[0], np.cumsum(count)])
    each = np.repeat(np.arange(len(i)), count[i])
    place = places[before[i][each] + np.arange(len(each)) - np.repeat(np.cumsum(count[i]) - count[i], count[i])]
    shift = place - grammar.low[i][each]
    owner = grammar.border_owner
    _, top_start, top_end, top_period = crossing_runs(grams, ends[owner] - sizes[owner], grammar.borders, ends[owner])
    return merged(np.concatenate([start[each] + shift, top_start]), np.concatenate([end[each] + shift, top_end]),
                  np.concatenate([period[each], top_period]))


def periodic_runs(df: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then
    period) and collapsed (the words without what a run holds after its first
    period, joined by one space) of each row's whole text.

    A run is a stretch of consecutive words with smallest period q (words q
    apart are identical) and length >= max(6, 4 q) that no neighbouring word
    extends.  Words are what lies between ASCII white space.  ``rewrite`` may
    replace a document's words first.

    Null and empty texts have no words, no runs and an empty collapsed text;
    repeated rows give repeated rows; an empty table gives an empty one; other
    columns aren't read.  A task's memory follows its longest text."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            texts = [t.split() for t in utf8(batch)]
            if rewrite:
                texts = [rewrite(d, t) for d, t in zip(ids.to_pylist(), texts)]
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices
            start, end, period = find_runs(flat.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            begins = np.cumsum(sizes) - sizes
            owner = np.searchsorted(begins + sizes, start, side="right")
            upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
            collapsed = [b" ".join(t) for t in texts] if not len(start) else []
            for d, t in enumerate(texts if len(start) else []):
                runs = slice(upto[d], upto[d + 1])
                if upto[d] < upto[d + 1]:
                    gone = np.zeros(len(t) + 1, np.int64)
                    np.add.at(gone, start[runs] + period[runs] - begins[d], 1)
                    np.add.at(gone, end[runs] - begins[d], -1)
                    t = [w for w, g in zip(t, np.cumsum(gone).tolist()) if not g]
                collapsed.append(b" ".join(t))
            found = pa.StructArray.from_arrays([pa.array(start - begins[owner], pa.int64()), pa.array(end - start, pa.int64()),
                                                pa.array(period, pa.int64())], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), found),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
    return map_texts(df.select("doc_id", "text"), each, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def run_digests(runs: DataFrame) -> DataFrame:
    """One row per document from ``periodic_runs``: the number of runs, the
    longest one (ties: smallest start, then period; nulls if there is none), and
    digests of all runs and of the collapsed text."""
    # arrays of structs compare field by field: the greatest length, then the least start and period
    order = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (runs.withColumn("_longest", order).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.back")).alias("start"),
        F.col("_longest.length").alias("length"), (-F.col("_longest.short")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.short").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
