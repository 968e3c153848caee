"""Near-dedup by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its word shingles.  Two sets of
Jaccard similarity t or more share a value among the |A| - ceil(t |A|) + 1
least of each, in any common order, and ``SHARED`` values if both keep
``SHARED`` - 1 more.  So a sketch keeps that many least hash values, and every
link is found through the inverted lists of retained values:

1. Equal sets become one.  Values found in many sketches come last in the order
   (any common order will do), so a passage that many documents hold makes no
   long lists; sets with much of that get their sketch from the whole set.
2. Inverted lists of up to ``LIST_MAX`` sets give the overlaps of sketches.
   Pairs whose overlap is too small for similarity t are dropped: a proven
   bound.  For the others the merged sketches, up to the last value that both
   keep, are a sketch of the union, and the share of it that is in both
   estimates the similarity.  An estimate may be wrong, so it routes: of the
   pairs that look similar each set's best one is verified first, all others
   after that, if their ends aren't connected yet.
3. Pairs are verified on the full sets of whole texts.
4. Sets on longer lists (large groups of near copies) are ordered anew, rare
   values first, within that group of sets.  In rounds every set is verified
   against one pivot of its lists; what that connects needs no more checks, so
   a group of near copies costs a check for each copy.  On lists that still hold
   several components, sets of different ones meet in blocks: positions bound
   their similarity, and the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import SPACE, map_texts, released, scramble, shuffle_parts, small, stored, utf8, word_hashes

WORDS = 5
#: Percent.
SIMILARITY = 85
SHARED = 8
#: Values that a sketch keeps as well, to take the places of frequent ones.
SPARE = 32
#: A value in more sketches than this is frequent; at most FREQUENT_MAX are
#: moved back (the most frequent; the others make longer lists).
FREQUENT, FREQUENT_MAX = 32, 1 << 20
LIST_MAX = 256
BLOCK = 256
#: Counters that order the values of large groups.
COUNTERS, COUNTER_PARTS = 1 << 20, 64
#: Rounds of checks against pivots in large groups, at most; blocks do the rest.
PIVOT_ROUNDS = 2
#: A pair looks similar if its estimate is below the similarity by this at most.
MARGIN = 0.05

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes, as int64."""
    hashes, counts = word_hashes([t.lower() for t in texts], SPACE)[:2]
    if len(hashes) >= words:
        rolled = np.zeros(len(hashes) - words + 1, np.uint64)
        for k in range(words):
            rolled = (rolled + hashes[k:len(hashes) - words + 1 + k]) * _MULTIPLIER
            rolled ^= rolled >> np.uint64(32)
        rolled = scramble(rolled).view(np.int64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rolled[at:at + n - words + 1]))
        elif n:
            whole = np.frombuffer(hashes[at:at + n].tobytes(), np.uint8)
            out.append(np.array([xxhash.xxh3_64_intdigest(whole, seed=n)], np.uint64).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
        at += n
    return out


def set_id(values: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64)))


def first_shared(n: int, similarity: int) -> int:
    """Values of which at least one is shared with any set similar enough."""
    return n + (-similarity * n) // 100 + 1


def _sketch(words: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(utf8(batch), words)
            heads = [s[:first_shared(len(s), similarity) + SHARED - 1 + SPARE] if len(s) else s for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                                   pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*heads, np.empty(0, np.int64)])))],
                                  names=["doc_id", "mark", "n", "set_id", "head"])
    return run


def _retained(values: np.ndarray, n: int, late: np.ndarray, similarity: int) -> np.ndarray | None:
    """The values a set keeps when ``late`` come last; None if ``values``, the
    least of its ``n``, are too few to tell."""
    keep = min(n, first_shared(n, similarity) + SHARED - 1)
    at = np.searchsorted(late, values)
    moved = late[np.minimum(at, len(late) - 1)] == values if len(late) else np.zeros(len(values), bool)
    early = values[~moved]
    if len(early) < keep and len(values) < n:
        return None
    return np.concatenate([early, values[moved]])[:keep]


def _postings(late, similarity: int, complete: bool):
    """Sketches -> rows (v, set_id, n, at: its place in the sketch, from 1), or
    the set_ids that need the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("head").offsets.to_numpy()
            flat = batch.column("head").values.to_numpy()
            ids, sizes = batch.column("set_id").to_numpy(), batch.column("n").to_numpy()
            kept = [_retained(flat[ends[i]:ends[i + 1]], int(sizes[i]), late.value, similarity) for i in range(len(ids))]
            if not complete:
                yield pa.record_batch([pa.array([int(ids[i]) for i, k in enumerate(kept) if k is None], pa.int64())], names=["set_id"])
                continue
            lengths = [0 if k is None else len(k) for k in kept]
            if sum(lengths):
                yield pa.record_batch([pa.array(np.concatenate([k for k in kept if k is not None])),
                                       pa.array(np.repeat(ids, lengths)), pa.array(np.repeat(sizes, lengths)),
                                       pa.array(np.concatenate([np.arange(1, m + 1) for m in lengths]), pa.int32())],
                                      names=["v", "set_id", "n", "at"])
    return run


def _postings_of_texts(late, words: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(utf8(batch), words):
                if len(s):
                    kept = _retained(s, len(s), late.value, similarity)
                    yield pa.record_batch([pa.array(kept), pa.array(np.full(len(kept), set_id(s))),
                                           pa.array(np.full(len(kept), len(s))), pa.array(np.arange(1, len(kept) + 1), pa.int32())],
                                          names=["v", "set_id", "n", "at"])
    return run


def _list_pairs(similarity: int):
    """Rows (v, set_id, n, at) sorted by v, whole lists in a task -> (a, b, need, at_a, at_b)."""
    def pairs(v: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.concatenate([start, [len(v)]]))
        for m in np.unique(size[size > 1]).tolist():
            left, right = np.triu_indices(m, 1)
            first = start[size == m]
            step = max(1, 500_000 // len(left))
            for i in range(0, len(first), step):
                x = (first[i:i + step, None] + left).ravel()
                y = (first[i:i + step, None] + right).ravel()
                least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                ok = (100 * least >= similarity * most) & (ids[x] != ids[y])
                x, y, most = x[ok], y[ok], most[ok]
                if len(x):
                    x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
                    yield pa.record_batch([pa.array(ids[x]), pa.array(ids[y]),
                                           pa.array(np.minimum(SHARED, -(-similarity * most // 100)).astype(np.int32)),
                                           pa.array(at[x]), pa.array(at[y])], names=["a", "b", "need", "at_a", "at_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)]
        for batch in batches:
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on
            yield from pairs(*(x[:cut] for x in now)) if cut else ()
            held = [x[cut:] for x in now]
        if len(held[0]):
            yield from pairs(*held)
    return run


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _verify(words: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (shingle_sets(utf8(batch, c), words) for c in ("text_a", "text_b"))
            ok = pa.array([_similar(x, y, similarity) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)
    return run


def connected(links: DataFrame) -> DataFrame:
    """Rows (a, b) -> (node, root): root is the least node that is reachable.
    Large-star and small-star steps in turn, until nothing changes."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("w"))
        if large:
            both = both.union(edges.select(F.col("b"), F.col("a")))
        else:
            both = both.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w"))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter(F.col("w") > F.col("u")).select(F.col("w").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("w").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
        return out.filter("a <> b").distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()

    edges = stored(links.select("a", "b").distinct(), "edges")
    before = mark(edges)
    while before[0]:
        edges = stored(star(star(edges, True), False), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b"), F.col("b"))).distinct()


def _texts(docs: DataFrame, reps: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(set_id, text) of the sets in ``ids`` (column set_id), stored."""
    wanted = small(stored(reps.join(ids, "set_id", "left_semi").select("set_id", "doc_id").distinct(), "wanted"))
    found = docs.select("doc_id", "text").join(wanted, "doc_id").select("set_id", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows may share a doc_id and differ in text
            sets = shingle_sets(utf8(batch), words)
            ok = [len(s) > 0 and set_id(s) == i for s, i in zip(sets, batch.column("set_id").to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))
    return stored(map_texts(found, same, "set_id long, text string").dropDuplicates(["set_id"]), "set-texts")


def _checked(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    a = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    return stored(map_texts(pairs.select("a", "b").join(a, "a").join(b, "b"), _verify(words, similarity),
                            "a long, b long", "text_a"), "links")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose ends ``links`` don't connect."""
    roots = small(stored(connected(links), "roots"))
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).drop("_ra", "_rb"))


def _block_links(similarity: int):
    """Whole blocks (v, i, j), sorted, of rows (.., set_id, comp, at, side, values)
    -> links that connect their sets across components."""
    def links(group: list[tuple[int, int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
        ids, comp = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        at, side = np.array([g[2] for g in group]), np.array([g[3] for g in group])
        sets = [g[4] for g in group]
        n = np.array([len(s) for s in sets])
        most = np.minimum((n - at)[:, None], n - at)  # values that can be shared from here on
        bound = 100 * most >= similarity * (n[:, None] + n - most)
        pick = np.triu(bound, 1) & (comp[:, None] != comp)
        if side.max() > 0:
            pick &= side[:, None] != side
        x, y = np.nonzero(pick)
        order = np.argsort(-(most[x, y] / (n[x] + n[y] - most[x, y])), kind="stable")
        first: dict[int, int] = {}
        above, out = [first.setdefault(c, k) for k, c in enumerate(comp.tolist())], []

        def root(k):
            while above[k] != k:
                above[k] = above[above[k]]
                k = above[k]
            return k

        for k in order.tolist():
            i, j = int(x[k]), int(y[k])
            if root(i) != root(j) and _similar(sets[i], sets[j], similarity):
                above[root(i)] = root(j)
                out.append((int(ids[i]), int(ids[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def done():
            found = links(group) if len(group) > 1 else []
            if found:
                yield pa.record_batch([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], names=["a", "b"])

        for batch in batches:
            for v, i, j, s, comp, at, side, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (v, i, j) != key:
                    yield from done()
                    key, group = (v, i, j), []
                group.append((s, comp, at, side, np.frombuffer(values, np.int64)))
        yield from done()
    return run


def _counter(values: np.ndarray) -> np.ndarray:
    return (scramble(values.view(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64)


def _group_links(texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links that connect the sets of ``texts``, by sketches with rare values first."""
    spark, wide = texts.sparkSession, COUNTERS // COUNTER_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts, packed: (part of the counters, places, times)."""
        own = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for values in shingle_sets(utf8(batch), words):
                np.add.at(own, _counter(values), 1)
        for part in range(COUNTER_PARTS):
            mine = own[part * wide:(part + 1) * wide]
            places = np.flatnonzero(mine)
            if len(places):
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([places.astype("<i4").tobytes()]),
                                       pa.array([mine[places].astype("<i8").tobytes()])], names=["part", "places", "times"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, places, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = parts.setdefault(part, np.zeros(wide, np.int64))
                whole[np.frombuffer(places, "<i4")] += np.frombuffer(times, "<i8")
        for part, whole in parts.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([whole.tobytes()])], names=["part", "times"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, places = [], []
            for values in shingle_sets(utf8(batch), words):
                times = sent.value[_counter(values)]
                first = np.lexsort((values, times))[:first_shared(len(values), similarity)]
                at = np.flatnonzero(times[first] > 1)
                heads.append(values[first[at]])
                places.append(at)
            yield pa.record_batch([batch.column("set_id"), pa.array(heads, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))],
                                  names=["set_id", "vs", "ats"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("set_id"), pa.array([s.tobytes() for s in shingle_sets(utf8(batch), words)], pa.binary())],
                                  names=["set_id", "values"])

    # Any order is right: hashed counters of fixed size stand for the values' counts.
    counted = (map_texts(texts, count, "part int, places binary, times binary").repartition(COUNTER_PARTS, "part")
               .mapInArrow(released(add), "part int, times binary"))
    counters = np.zeros(COUNTERS, np.int64)
    for row in counted.collect():  # COUNTER_PARTS rows, COUNTERS numbers
        counters[row.part * wide:(row.part + 1) * wide] = np.frombuffer(row.times, np.int64)
    sent = spark.sparkContext.broadcast(counters)
    heads = stored(map_texts(texts, order, "set_id long, vs array<long>, ats array<long>"), "group-heads")
    links, pieces = _pivot_links(heads, texts, words, similarity)
    dealt = _dealt(pieces)
    full = map_texts(texts, whole, "set_id long, values binary")
    ready = (dealt.join(full, "set_id").select("v", "i", "j", "set_id", "comp", "at", "side", "values")
             .repartition(shuffle_parts(spark), "v", "i", "j").sortWithinPartitions("v", "i", "j"))
    across = ready.mapInArrow(released(_block_links(similarity)), "a long, b long")
    return stored(links.union(across).distinct(), "group-links")


def _open_lists(heads: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows (v, set_id, at, comp) of the lists that hold sets of several
    components.  ``heads``: a row for each set, its values and their places."""
    if roots is None:
        named = heads.withColumn("comp", F.col("set_id"))
    else:
        named = (heads.join(small(roots.select(F.col("node").alias("set_id"), "root")), "set_id", "left")
                 .withColumn("comp", F.coalesce("root", "set_id")))
    rows = (named.select("set_id", "comp", F.explode(F.arrays_zip("vs", "ats")).alias("head"))
            .select(F.col("head.vs").alias("v"), "set_id", F.col("head.ats").alias("at"), "comp"))
    several = rows.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("v")
    return rows.join(several, "v", "left_semi")


def _pivot_links(heads: DataFrame, texts: DataFrame, words: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Links found by checking each set against a pivot, in rounds, and the rows
    of the lists on which several components are left.

    A list's pivot is its set that comes first in the round's hashed order; a set
    takes the pivot that most of its lists have, if that is of another component."""
    spark = heads.sparkSession
    links, roots = spark.createDataFrame([], "a long, b long"), None
    pieces = stored(_open_lists(heads, roots), "group-open")
    for turn in range(PIVOT_ROUNDS):
        first = pieces.groupBy("v").agg(F.min_by(F.struct("set_id", "comp"), F.xxhash64("set_id", F.lit(turn))).alias("p"))
        tried = stored(pieces.join(first, "v").filter(F.col("comp") != F.col("p.comp"))
                       .groupBy(F.col("set_id").alias("a"), F.col("p.set_id").alias("b")).agg(F.count(F.lit(1)).alias("m"))
                       .groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b")), "group-tried")
        found = _checked(tried, texts, words, similarity)
        if found.isEmpty():
            break
        links = stored(links.union(found), "group-found")
        roots = stored(connected(links), "group-roots")
        pieces = stored(_open_lists(heads, roots), "group-open")
        if pieces.isEmpty():
            break
    return links, pieces


def _dealt(pieces: DataFrame) -> DataFrame:
    """Rows (v, i, j, set_id, comp, at, side) of the blocks in which sets of
    different components meet.  The sets of a list's largest component are cut
    into parts, and each part meets all other sets (i = -1, j the part); these meet
    each other in pairs of parts (i, j)."""
    counts = pieces.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("m"))
    lists = stored(counts.groupBy("v").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("all"))
                   .select("v", F.col("most.comp").alias("main"), F.ceil(F.col("most.m") / BLOCK).cast("int").alias("main_parts"),
                           F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most.m")) / BLOCK)).cast("int").alias("parts")), "group-blocks")
    rows = pieces.join(small(lists), "v")
    hashed = F.xxhash64("set_id")
    main, rest = rows.filter("comp = main"), rows.filter("comp <> main")
    of_main = main.select("v", F.lit(-1).alias("i"), F.pmod(hashed, F.col("main_parts")).cast("int").alias("j"), "set_id", "comp", "at",
                          F.lit(1).alias("side"))
    to_main = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("main_parts") - 1))).select(
        "v", F.lit(-1).alias("i"), "j", "set_id", "comp", "at", F.lit(2).alias("side"))
    own = F.pmod(hashed, F.col("parts")).cast("int")
    others = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_id", "comp", "at",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    return of_main.unionByName(to_main).unionByName(others)


def union_estimate(shared, at_a, at_b) -> F.Column:
    """The similarity of two sets by the sketch of their union: merged, the
    sketches up to their last common value (places ``at_a`` and ``at_b``) are the
    union's at_a + at_b - shared least values, ``shared`` of them in both sets."""
    return shared / (at_a + at_b - shared)


def near_links(docs: DataFrame, sketches: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (a, b) of set_ids that connect all similar sets.  ``sketches``:
    doc_id, n, set_id, head; one row for each set, or equal ones."""
    spark = docs.sparkSession
    held = F.expr(f"slice(head, 1, CAST(n - ceil({similarity} * n / 100) + 1 AS INT))")
    often = (sketches.select(F.explode(held).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("m"))
             .filter(F.col("m") > FREQUENT).orderBy(F.desc("m"), "v").limit(FREQUENT_MAX).select("v"))
    late = np.sort(often.toArrow().column("v").to_numpy())  # FREQUENT_MAX values at most
    sent = spark.sparkContext.broadcast(late)

    columns = sketches.select("set_id", "n", "head")
    lacking = stored(columns.mapInArrow(released(_postings(sent, similarity, False)), "set_id long"), "lacking")
    row = "v long, set_id long, n long, at int"
    postings = stored(columns.mapInArrow(released(_postings(sent, similarity, True)), row).unionByName(
        map_texts(_texts(docs, sketches, lacking, words), _postings_of_texts(sent, words, similarity), row)), "postings")
    lists = stored(postings.groupBy("v").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > LIST_MAX), "long-lists")
    short = postings.join(small(lists), "v", "left_anti")
    in_lists = (short.repartition(shuffle_parts(spark), "v").sortWithinPartitions("v")
                .mapInArrow(released(_list_pairs(similarity)), "a long, b long, need int, at_a int, at_b int"))
    pairs = stored(in_lists.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.max("need").alias("need"),
                                                  F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
                   .filter("m >= need").select("a", "b", union_estimate(F.col("m"), F.col("at_a"), F.col("at_b")).alias("like")), "pairs")
    grouped = stored(postings.join(small(lists), "v", "left_semi").select("set_id").distinct(), "grouped")
    texts = _texts(docs, sketches, pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(grouped), words)

    likely = pairs.filter(F.col("like") >= similarity / 100 - MARGIN)
    best = (likely.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b"))
            .union(likely.groupBy("b").agg(F.max_by("a", F.struct("like", "a")).alias("a")).select("a", "b")).distinct())
    links = _checked(best, texts, words, similarity)
    of_groups = _group_links(texts.join(small(grouped), "set_id", "left_semi"), words, similarity)
    links = links.union(of_groups)
    rest = _apart(pairs.join(best, ["a", "b"], "left_anti"), links)
    return links.union(_checked(stored(rest, "rest"), texts, words, similarity))


def _components(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Rows (doc_id, mark, n, component): mark is a hash of the text, component
    null where a set is linked with nothing and has no copies."""
    sketches = stored(map_texts(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), _sketch(words, similarity),
                                "doc_id long, mark long, n long, set_id long, head array<bigint>"), "sketches")
    some = sketches.filter("n > 0")
    classes = stored(some.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
                     .filter("c > 1"), "classes")
    copies = stored(some.select("set_id", "doc_id").join(small(classes), "set_id").filter("doc_id <> least")
                    .select("set_id", "doc_id"), "copies")
    reps = some.join(small(copies), ["set_id", "doc_id"], "left_anti")
    roots = stored(connected(near_links(docs, reps, words, similarity)), "roots")
    # The least doc_id of each component, then of each set that is linked or has copies.
    least = (some.select("set_id", "doc_id").join(small(roots), F.col("set_id") == F.col("node"))
             .groupBy("root").agg(F.min("doc_id").alias("component")))
    named = stored(roots.join(least, "root").select(F.col("node").alias("set_id"), "component")
                   .unionByName(classes.join(roots, F.col("set_id") == F.col("node"), "left_anti")
                                .select("set_id", F.col("least").alias("component"))), "components")
    return sketches.select("doc_id", "mark", "n", "set_id").join(small(named), "set_id", "left").drop("set_id")


def _kept() -> F.Column:
    return F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True))


def near_dedup(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles,
    component_id, kept.

    Rows are linked when 100 * intersection >= ``similarity`` * union of their
    sets of ``words``-word shingles; the component is the least doc_id that
    links lead to.  Shorter texts are one shingle; texts without words, null
    texts included, have an empty set and are linked with nothing.  Rows that
    repeat a doc_id and text share the verdict; rows that share a doc_id only
    are linked by their own texts.  Rows with a null doc_id are kept.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    return _components(docs, words, similarity).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), _kept().alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row for each component of ``near_dedup``: that of the
    least doc_id.  Of rows that repeat a doc_id and text any one stays; all
    rows with a null doc_id stay."""
    found = stored(_components(docs, words, similarity).select("doc_id", "mark", _kept().alias("kept")), "near-verdicts")
    gone = stored(found.filter("NOT kept").select("doc_id", "mark").distinct(), "near-gone")
    again = stored(found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id", "mark")
                   .agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id", "mark"), "near-again")
    key = ["doc_id", "mark"]  # beside the user's columns, which are one struct
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.struct(*[F.col(f"`{c}`").alias(f"{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    stay = rows.join(small(gone), key, "left_anti")
    if not again.isEmpty():
        once = stay.join(small(again), key, "left_semi").dropDuplicates(key)
        stay = stay.join(small(again), key, "left_anti").unionByName(once)
    return stay.select(*[F.col(f"row.`{i}`").alias(c) for i, c in enumerate(docs.columns)])
