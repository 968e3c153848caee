"""Line dedup through sharded minimal perfect hashes.

1. Documents send (line hash, doc_id) of their distinct long lines; Spark counts
   the documents of a line and finds its largest doc_id (combined before the
   shuffle, so a line in a third of all documents is no hot key).
2. The lines found often enough are dealt to shards by their hash.  Each shard
   builds a minimal perfect hash over its lines, which numbers them 0 to n-1,
   and three arrays under these numbers: fingerprint, count, owner's doc_id.
3. Documents probe the arrays: no join of lines.  Shards are broadcast in waves
   of at most ``WAVE_BYTES``; with more than one wave the documents' marks are
   stored between waves.

A line is known by 128 bits of hash: 64 place it in its shard, 64 are its
fingerprint.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import map_texts, released, stored, utf8

MIN_POINTS = 40
MIN_DOCS = 5
SHARD_KEYS = 100_000
WAVE_BYTES = 64 << 20
#: Bits of a level of the perfect hash for each key that it places.
GAMMA = 2
LEVELS = 40


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: on each level the keys
    that fall alone on a bit keep it, the others go on; a key's number is the
    count of set bits before its own."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # bits, set bits before each byte, first number
        first = 0
        for seed in range(LEVELS):
            if not len(keys):
                break
            size = max(64, -(-GAMMA * len(keys) // 8) * 8)
            at = (_mix(keys, seed + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])[:-1].astype(np.uint32)
            self.levels.append((bits, before, first))
            first += int(alone.sum())
            keys = keys[~alone[at]]
        self.rest, self.rest_first = np.sort(keys), first

    def state(self) -> dict:
        return vars(self)

    @classmethod
    def of(cls, state: dict) -> PerfectHash:
        table = cls(np.empty(0, np.uint64))
        vars(table).update(state)
        return table

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``; -1, or any number, for keys not built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, (bits, before, first) in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(keys[left], seed + 1) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            held = bits[byte]
            on = (held >> (np.uint8(7) - bit)) & np.uint8(1) == 1
            lower = np.bitwise_count(held[on] >> (np.uint8(8) - bit[on]).astype(np.uint16)).astype(np.int64)
            out[left[on]] = first + before[byte[on]] + lower
            left = left[~on]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            on = self.rest[at] == keys[left]
            out[left[on]] = self.rest_first + at[on]
        return out


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(keys, 77) % np.uint64(shards)).astype(np.int64)


def _build_shards(shards: int):
    """Rows (h1, h2, n, owner) of whole shards -> (shard, n_keys, blob)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # about SHARD_KEYS rows of 40 bytes
        if not held:
            return
        got = pa.Table.from_batches(held)
        h1, h2, n, owner = (got.column(c).to_numpy() for c in ("h1", "h2", "n", "owner"))
        keys = h1.view(np.uint64)
        shard = _shard_of(keys, shards)
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            at = keys[mine]
            # Two lines with one h1 keep one place; the other is found by its own second table.
            _, once = np.unique(at, return_index=True)
            twice = np.setdiff1d(np.arange(len(at)), once)
            parts = []
            for chosen in (mine[once], mine[twice]):
                if len(chosen):
                    table = PerfectHash(keys[chosen])
                    order = np.empty(len(chosen), np.int64)
                    order[table.number(keys[chosen])] = chosen
                    parts.append((table.state(), h2[order], n[order].astype(np.uint32), owner[order]))
            yield pa.record_batch([pa.array([int(s)], pa.int64()), pa.array([len(mine)], pa.int64()),
                                   pa.array([pickle.dumps(parts)], pa.binary())], names=["shard", "n_keys", "blob"])
    return run


def _keys(text: bytes, min_points: int) -> tuple[list[bytes], list[int], bytes]:
    """The lines, the numbers of those with long keys, and 16 bytes of hash of
    each such key."""
    lines = text.split(b"\n")
    at, marks = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_points:
            key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
            if len(key) >= min_points and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_points):
                at.append(i)
                marks.append(xxhash.xxh3_128_digest(key))
    return lines, at, b"".join(marks)


def _send_keys(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            marks, owners = [], []
            for doc_id, text in zip(ids, utf8(batch), strict=True):
                found = _keys(text, min_points)[2]
                if found:
                    own = {found[i:i + 16] for i in range(0, len(found), 16)}
                    marks.extend(own)
                    owners.extend([doc_id] * len(own))
            if marks:
                both = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(owners, pa.int64())],
                                      names=["h1", "h2", "doc_id"])
    return run


def _probe(hashes: np.ndarray, shards: int, tables: dict[int, list]) -> tuple[np.ndarray, np.ndarray]:
    """For (n, 2) hashes: which are frequent lines of these shards, and their owners."""
    keys = np.ascontiguousarray(hashes[:, 0]).view(np.uint64)
    hit, owner = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    shard = _shard_of(keys, shards)
    for s, parts in tables.items():
        mine = np.flatnonzero(shard == s)
        for table, prints, _, owners in parts:
            if len(mine):
                number = table.number(keys[mine])
                ok = number >= 0
                ok[ok] = prints[number[ok]] == hashes[mine[ok], 1]
                hit[mine[ok]] = True
                owner[mine[ok]] = owners[number[ok]]
                mine = mine[~ok]
    return hit, owner


def _mark(wave, shards: int, min_points: int, last: bool, with_text: bool):
    """Documents with the marks of earlier waves (column drops: one byte for
    each long line, or null) -> the same with this wave's marks, or the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: [(PerfectHash.of(t), *arrays) for t, *arrays in pickle.loads(b)] for s, b in wave.value}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            drops = batch.column("drops").to_pylist()
            found = [_keys(t, min_points) for t in utf8(batch)]
            counts = [len(at) for _, at, _ in found]
            hashes = np.frombuffer(b"".join(h for *_, h in found), np.int64).reshape(-1, 2)
            hit, owner = _probe(hashes, shards, tables)
            holder = np.repeat(np.array([-1 if i is None else i for i in ids], np.int64), counts)
            nameless = np.repeat(np.array([i is None for i in ids], bool), counts)
            gone = hit & ((holder != owner) | nameless)
            ends = np.cumsum(counts)
            marks = []
            for k, (end, n, old) in enumerate(zip(ends, counts, drops, strict=True)):
                now = gone[end - n:end].astype(np.uint8)
                marks.append(now | np.frombuffer(old, np.uint8) if old is not None else now)
            if not last:
                yield pa.record_batch([batch.column("doc_id"), batch.column("text"),
                                       pa.array([m.tobytes() for m in marks], pa.binary())],
                                      names=["doc_id", "text", "drops"])
                continue
            n_lines, n_dropped, sha, kept_text = [], [], [], []
            for (lines, at, _), mark in zip(found, marks, strict=True):
                out = {at[j] for j in np.flatnonzero(mark)}
                kept = b"\n".join(x for i, x in enumerate(lines) if i not in out) if out else b"\n".join(lines)
                n_lines.append(len(lines))
                n_dropped.append(len(out))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept if with_text else None)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_lines, pa.int64()),
                                   pa.array(n_dropped, pa.int64()), pa.array(sha),
                                   pa.array(kept_text, pa.binary()).cast(pa.string())],
                                  names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])
    return run


def line_index(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS,
               shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The stored shards (shard, n_keys, blob) of lines in ``min_docs``
    documents or more, and the number of shards."""
    sent = map_texts(docs.select("doc_id", "text"), _send_keys(min_points), "h1 long, h2 long, doc_id long")
    often = stored(sent.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner"))
                   .filter(F.col("n") >= min_docs)
                   .withColumn("owner", F.coalesce("owner", F.lit(-1).cast("long"))), "lines")
    shards = max(1, -(-often.count() // shard_keys))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _shard_of(batch.column("h1").to_numpy().view(np.uint64), shards)
            yield pa.record_batch([*batch.columns, pa.array(s)], names=[*batch.schema.names, "shard"])

    placed = often.mapInArrow(released(place), "h1 long, h2 long, n long, owner long, shard long")
    built = (placed.repartition(shards, "shard").mapInArrow(released(_build_shards(shards)), "shard long, n_keys long, blob binary"))
    return stored(built, "line-shards"), shards


def line_dedup(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS,
               wave_bytes: int = WAVE_BYTES, shard_keys: int = SHARD_KEYS, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_lines,
    n_dropped, kept_sha256, kept_text (null unless ``with_text``).

    A line's key is the line stripped of ASCII white space with A-Z lowered.
    Keys of ``min_points`` code points or more found in ``min_docs`` rows or
    more lose all their lines, but for those in the largest doc_id that holds
    it.  Null text counts as empty: one empty line.  Rows that repeat a doc_id
    count as documents and are treated alike; a row with a null doc_id owns no
    line.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    index, shards = line_index(docs, min_points, min_docs, shard_keys)
    waves: list[list[int]] = [[]]
    held = 0
    # One row of sizes for each SHARD_KEYS lines.
    for shard, size in index.select("shard", F.length("blob")).orderBy("shard").toLocalIterator():
        if waves[-1] and held + size > wave_bytes:
            waves.append([])
            held = 0
        waves[-1].append(shard)
        held += size
    marked = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("drops"))
    for i, wave in enumerate(waves):
        blobs = [(r.shard, bytes(r.blob)) for r in index.filter(F.col("shard").isin(wave)).collect()] if wave else []
        sent = spark.sparkContext.broadcast(blobs)  # at most wave_bytes, or one shard
        last = i == len(waves) - 1
        marked = map_texts(marked, _mark(sent, shards, min_points, last, with_text),
                           "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string" if last
                           else "doc_id long, text string, drops binary")
        if not last:
            marked = stored(marked, "line-marks")
    return marked
