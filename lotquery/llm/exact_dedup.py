"""Exact dedup with a cuckoo-filter index.

A document's key is the SHA-256 of its text.  Index shards (one task each,
by key) hold the live keys in a cuckoo filter: a lookup compares 16-bit
fingerprints in two buckets; a hit is verified against the full key stored in
that bucket's slot.  The live entry of a key names the largest doc_id seen and
the group's size.  A larger doc_id takes over by deleting the old entry and
inserting the new one.  An insertion that finds no room after
``MAX_KICKS`` moves doubles the table and inserts all stored keys again.

Each scan task first runs an index of its own over its rows, so a key that
holds a third of all rows reaches its shard as a few partial entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import released, shuffle_parts, stored

SLOTS = 4
MAX_KICKS = 200
#: Live keys that a scan task's own index may hold before it is sent on.
LOCAL_KEYS = 200_000
#: A key is hot above this share of the rows: at most HOT_SHARE keys are hot.
HOT_SHARE = 1_000
ENTRY = "digest binary, keep_id long, group_size long"


class CuckooIndex:
    """Cuckoo filter over digests, with the stored key and value of each slot."""

    def __init__(self, buckets: int = 256):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1  # a power of two, less one
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)
        self.size = 0

    def _print(self, key: bytes) -> int:
        return (int.from_bytes(key[8:10], "little") | 1) & 0xFFFF

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[:8], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> int:
        """The slot of a live key, or -1.  Fingerprint hits are verified."""
        mark, home = self._print(key), self._home(key)
        for bucket in (home, self._other(home, mark)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value) -> None:
        """Insert a key that is not live."""
        mark = self._print(key)
        bucket = self._home(key)
        for place in (bucket, self._other(bucket, mark)):
            for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self._put(slot, mark, key, value)
                    return
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            held = self.prints[slot], self.keys[slot], self.values[slot]
            self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
            mark, key, value = held
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self._put(slot, mark, key, value)
                    return
        self._grow()
        self.insert(key, value)

    def _put(self, slot: int, mark: int, key: bytes, value) -> None:
        self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
        self.size += 1

    def _grow(self) -> None:
        live = list(self.items())
        self._clear(2 * (self.mask + 1))
        for key, value in live:
            self.insert(key, value)

    def delete(self, key: bytes) -> bool:
        """Remove a live key; False if it isn't live."""
        slot = self.find(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, self.values[i]) for i, k in enumerate(self.keys) if k is not None)

    def add(self, key: bytes, doc_id: int, count: int) -> None:
        """Count documents of a key; the largest doc_id owns the live entry."""
        slot = self.find(key)
        if slot < 0:
            self.insert(key, (doc_id, count))
            return
        owner, held = self.values[slot]
        if _later(doc_id, owner):
            self.delete(key)
            self.insert(key, (doc_id, held + count))
        else:
            self.values[slot] = (owner, held + count)


def _later(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a > b)


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    live = list(index.items())
    for i in range(0, len(live), 20_000):
        part = live[i:i + 20_000]
        yield pa.record_batch([pa.array([k for k, _ in part], pa.binary()),
                               pa.array([v[0] for _, v in part], pa.int64()),
                               pa.array([v[1] for _, v in part], pa.int64())],
                              names=["digest", "keep_id", "group_size"])


def _index(limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for key, doc_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index.add(key, doc_id, n)
            if limit and index.size > limit:
                yield from _entries(index)
                index = CuckooIndex()
        yield from _entries(index)
    return run


def live_entries(rows: DataFrame) -> DataFrame:
    """Rows (digest, keep_id, group_size), partial or single -> one live entry
    for each digest."""
    parts = rows.select("digest", "keep_id", "group_size").mapInArrow(released(_index(LOCAL_KEYS)), ENTRY)
    return parts.repartition(shuffle_parts(rows.sparkSession), "digest").mapInArrow(released(_index(None)), ENTRY)


def retract(live: DataFrame, gone: DataFrame) -> DataFrame:
    """Live entries without the digests of ``gone`` (column digest): each shard
    rebuilds its index from its stored entries and deletes the keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out = CuckooIndex(), set()
        for batch in batches:
            for key, doc_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n is None:
                    out.add(key)
                else:
                    index.add(key, doc_id, n)
        for key in out:
            index.delete(key)
        yield from _entries(index)
    marks = gone.select("digest", F.lit(None).cast("long").alias("keep_id"),
                        F.lit(None).cast("long").alias("group_size")).distinct()
    both = live.select("digest", "keep_id", "group_size").unionByName(marks)
    return both.repartition(shuffle_parts(live.sparkSession), "digest").mapInArrow(released(run), ENTRY)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, keep_id,
    group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the
    row with the largest doc_id stays; rows that repeat a doc_id and its text
    count each in ``group_size`` and share the verdict.  A null doc_id is
    smaller than any other.  An empty table gives an empty result.  Other
    columns are ignored.
    """
    digests = stored(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")),
                     "digests")
    live = stored(live_entries(digests.select("digest", F.col("doc_id").alias("keep_id"),
                                              F.lit(1).cast("long").alias("group_size"))), "live")
    total = digests.count()
    hot = F.broadcast(live.filter(F.col("group_size") > F.lit(total) / F.lit(HOT_SHARE) + 100))  # at most HOT_SHARE rows
    found = (digests.join(hot, "digest").select("doc_id", "digest", "keep_id", "group_size")
             .unionByName(digests.join(hot, "digest", "left_anti").join(live, "digest")
                          .select("doc_id", "digest", "keep_id", "group_size")))
    return found.select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))
