"""Sharding by best-fit-decreasing bin packing.

Groups (equal texts) never part.  Items, sorted by size, enter the bin with the
least remaining capacity that still holds them, found in a balanced tree of
remaining capacities; a new bin opens when none does.  ``pack`` minimises the
bins of a fixed capacity; for a fixed number of bins, ``pack_into`` searches
the least capacity at which best fit decreasing needs no more bins.

At scale the driver sees a bounded number of items: a group above 1/(bins *
LARGE) of all bytes is an item of its own (there are at most bins * LARGE such
groups); the others are counted by size class, FINE classes for each doubling.
Equal items fill the tightest bin until it holds no more, then the next, so a
class of any number of groups is packed in a step for each bin; Spark ranks the
groups inside their class and deals them to the bins by rank.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import stored

LARGE = 500
#: Size classes for each doubling of the size: groups of a class are within 1.1 percent.
FINE = 64
ROW_BYTES = 8
#: Rows that number their slots together, about.
SLOT_ROWS = 50_000


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key, rank):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class CapacityTree:
    """Treap of (remaining capacity, bin): balanced by random ranks."""

    def __init__(self):
        self.root, self.rng = None, random.Random(0)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, _Node(key, self.rng.random())), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with remaining >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        least = high
        while least.left:
            least = least.left
        _, rest = self._split(high, (least.key[0], least.key[1] + 1))
        self.root = self._join(low, rest)
        return least.key

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low.rank > high.rank:
            low.right = self._join(low.right, high)
            return low
        high.left = self._join(low, high.left)
        return high


def pack_runs(items: list[tuple[int, object, int]], capacity: int) -> tuple[dict[object, list[tuple[int, int]]], int]:
    """(size, name, count) runs of equal items into bins of ``capacity``: for each
    name the bins taken and how many items each, and the number of bins.  An item
    above the capacity fills a bin alone."""
    tree, where, bins = CapacityTree(), {}, 0
    for size, name, count in sorted(items, key=lambda x: (-x[0], x[1])):
        taken = where.setdefault(name, [])
        while count:
            found = tree.take_tightest(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            n = min(count, max(1, found[0] // size))  # while it holds them, it stays the tightest
            tree.add((found[0] - n * size, found[1]))
            taken.append((found[1], n))
            count -= n
    return where, bins


def pack(items: list[tuple[int, object]], capacity: int) -> tuple[dict, int]:
    """(size, name) items into bins of ``capacity``: the bin of each name, and
    the number of bins."""
    where, bins = pack_runs([(size, name, 1) for size, name in items], capacity)
    return {name: taken[0][0] for name, taken in where.items()}, bins


def pack_runs_into(items: list[tuple[int, object, int]], bins: int) -> dict[object, list[tuple[int, int]]]:
    """Runs of equal items into bins 0 to ``bins`` - 1, at the least capacity for
    which best fit decreasing opens no more.  Items that fill a bin alone keep it
    and the others share the rest."""
    whole = sorted(items, key=lambda x: (-x[0], x[1]))
    alone: dict = {}
    total = sum(s * n for s, _, n in whole)
    while whole and whole[0][2] == 1 and bins - len(alone) > 1 and whole[0][0] * (bins - len(alone)) > total:
        size, name, _ = whole.pop(0)
        total -= size
        alone[name] = [(len(alone), 1)]
    left = bins - len(alone)
    low = max(-(-total // left), whole[0][0] if whole else 0)
    high = 2 * low + 1  # best fit decreasing is within 11/9 of the least number of bins, plus one
    while pack_runs(whole, high)[1] > left:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        if pack_runs(whole, middle)[1] <= left:
            high = middle
        else:
            low = middle + 1
    packed = pack_runs(whole, high)[0]
    return alone | {name: [(b + len(alone), n) for b, n in taken] for name, taken in packed.items()}


def pack_into(items: list[tuple[int, object]], bins: int) -> dict:
    """(size, name) items into bins 0 to ``bins`` - 1: the bin of each name."""
    return {name: taken[0][0] for name, taken in pack_runs_into([(size, name, 1) for size, name in items], bins).items()}


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, size,
    text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes (null: none) plus 8.  Rows of equal texts
    share a shard; null counts as an empty text.  A group above an even share
    has a shard to itself.  Slots number a shard's rows from 0 without gaps;
    rows that agree in all columns are interchangeable.  An empty table gives
    an empty result.  Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_group")), "shard-rows")
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = total // (shards * LARGE) + 1
    key = ["_group", "text_crc32"]
    groups = stored(rows.groupBy(*key).agg(F.sum("size").alias("bytes"))
                    .withColumn("_class", F.when(F.col("bytes") < least, F.floor(F.log2("bytes") * FINE).cast("int"))), "shard-groups")
    items = [(r.bytes, (1, bytes(r._group).hex() + f"{r.text_crc32:08x}"), 1) for r in groups.filter("_class IS NULL").toLocalIterator()]
    counts = groups.filter("_class IS NOT NULL").groupBy("_class").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    classes = counts.collect()  # FINE rows at most for each doubling
    items += [(-(-r.bytes // r.n), (0, r._class), r.n) for r in classes]
    where = pack_runs_into(items, shards) if items else {}
    own, ranges = [], []
    for (large, name), taken in where.items():
        upto = 0
        for shard, n in taken:
            own += [(name, shard)] * large
            ranges += [(name, upto, upto + n, shard)] * (not large)
            upto += n
    spark = docs.sparkSession
    # At most shards * LARGE rows, and shards rows for each class.
    own = spark.createDataFrame(own, "_name string, shard int")
    ranges = spark.createDataFrame(ranges, "_class int, _from long, _to long, shard int")
    name = F.concat(F.lower(F.hex("_group")), F.lower(F.lpad(F.hex("text_crc32"), 8, "0")))
    ranked = number_slots(groups.filter("_class IS NOT NULL"), "_class", sum(r.n for r in classes) // SLOT_ROWS + 1, key, "_rank")
    inside = ((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    dealt = (ranked.join(F.broadcast(ranges), "_class").filter(inside).select(*key, "shard")
             .unionByName(groups.filter("_class IS NULL").withColumn("_name", name).join(F.broadcast(own), "_name").select(*key, "shard")))
    placed = rows.join(dealt, key).select("doc_id", "size", "text_crc32", "shard")
    return number_slots(placed, "shard", n_rows // (shards * SLOT_ROWS) + 1).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def number_slots(rows: DataFrame, bin_column: str, blocks: int, by: list[str] | None = None, name: str = "slot") -> DataFrame:
    """Column ``name``: rows of each bin numbered from 0, in blocks by the hash of
    the columns ``by``, so that no task numbers a whole bin."""
    by = by or ["doc_id", "size", "text_crc32"]
    cut = rows.withColumn("_block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int"))
    starts = (cut.groupBy(bin_column, "_block").agg(F.count(F.lit(1)).alias("_n"))
              .selectExpr(bin_column, "_block", f"sum(_n) OVER (PARTITION BY {bin_column} ORDER BY _block) - _n AS _start"))
    inner = cut.selectExpr("*", f"row_number() OVER (PARTITION BY {bin_column}, _block ORDER BY {', '.join(by)}) - 1 AS _at")
    return (inner.join(starts, [bin_column, "_block"])
            .withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_block", "_start", "_at"))
