"""Token-ID output through an adaptive context-mixing range coder.

Documents are tokenised in ascending doc_id order, an end id after each, and
cut into blocks of whole documents.  A block is independent: its model starts
anew, and it carries a CRC-32 of its ids and one of its bytes.

A block's ids are dealt to lanes, which are coded in step with numpy, each by a
range coder of its own under one model of the block.  The probability of an id
mixes three predictions: the id last seen after the two ids before (order 2),
after the id before (order 1), and the ids' counts so far (order 0).  The
weights of orders 2 and 1 are their hit rates so far, kept for each pair of
confidences; order 0 gets the rest.  The decoder repeats the model's steps.

Spark writes the blocks as rows of a Parquet table: (part, block, n_tokens, blob).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotquery.llm.bpe import Tokens
from lotquery.llm.common import map_texts, released, shuffle_parts, stored, utf8
from lotquery.session import scratch_path

END_ID = 2
BLOCK_IDS = 1 << 20
LANES, LANE_IDS = 4096, 256
MAGIC = b"LQCM\x01"
HEADER = "<5sxxxQIIIII"  # magic, ids, documents, lanes, vocabulary, CRC of ids, CRC of the rest

#: Probabilities are parts of 2^24; order 0 counts in parts of 2^20.
TOTAL_BITS, COUNT_BITS = 24, 20
TOTAL, COUNTS = 1 << TOTAL_BITS, 1 << COUNT_BITS
TOP = np.uint64(1 << 32)
TABLE_BITS = 18
U = np.uint64


#: What an entry gains for its confidence, after misses and after hits; a miss without confidence brings a new id.
GAINS = np.array([-(c + 1 >> 1) for c in range(8)] + [c < 7 for c in range(8)], np.int64).astype(np.uint32)


class Model:
    """The mixed prediction of a block, for all lanes at a step."""

    def __init__(self, vocabulary: int, lanes: int):
        self.size = vocabulary
        self.seen = np.zeros(vocabulary, np.int64)
        self.order2 = np.zeros(1 << TABLE_BITS, np.uint32)  # id * 8 + confidence
        self.order1 = np.zeros(vocabulary, np.uint32)
        self.before1 = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)
        # For confidences of both orders and whether they agree: tries, hits of order 2, hits of order 1.
        self.tries = np.full(128, 4, np.int64)
        self.hits2 = np.ones(128, np.int64)
        self.hits1 = np.ones(128, np.int64)
        self.outcomes = np.zeros(512, np.int64)  # since they were last counted: context, hit of order 2, hit of order 1
        self.steps, self.due, self.held = 0, 8, []
        self._count()
        self._weigh()

    def _count(self) -> None:
        free = COUNTS - self.size
        freq = 1 + self.seen * free // max(1, int(self.seen.sum()))
        if not self.seen.any():
            freq += free // self.size
        freq[int(self.seen.argmax())] += COUNTS - int(freq.sum())
        self.below = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
        self.slot = None

    def _weigh(self) -> None:
        most = TOTAL - COUNTS  # order 0 keeps one part of COUNTS for each of its counts
        w2 = self.hits2 * most // self.tries
        w1 = self.hits1 * most // self.tries
        w1[1::2] = 0  # where both orders agree
        self.weight2, self.weight21 = w2.astype(np.uint64), (w2 + w1).astype(np.uint64)

    def look(self, lanes: int) -> None:
        """Predictions for the next id of the first ``lanes`` lanes."""
        one, two = self.before1[:lanes], self.before2[:lanes]
        self.place = (one * 0x9E3779B1 + two * 0x85EBCA6B >> 7) & ((1 << TABLE_BITS) - 1)
        self.entry2, self.entry1 = self.order2[self.place], self.order1[one]
        self.sure2, self.sure1 = self.entry2 & 7, self.entry1 & 7
        self.id2, self.id1 = self.entry2 >> 3, self.entry1 >> 3
        context = self.sure2 << 4
        context |= self.sure1 << 1
        context |= self.id1 == self.id2
        self.context = context.astype(np.int64)
        self.w2, self.w21 = self.weight2[self.context], self.weight21[self.context]
        self.w0 = U(TOTAL) - self.w21

    def _order0(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, top = self.below[ids], self.below[ids + 1]
        low *= self.w0
        low >>= U(COUNT_BITS)
        top *= self.w0
        top >>= U(COUNT_BITS)
        top -= low
        return low, top

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each id's part: order 2 lies first, then order 1,
        then order 0 (where a predicted id's part stays unused)."""
        now = ids.astype(np.uint32)
        low, size = self._order0(ids)
        low += self.w21
        by1 = np.flatnonzero(self.id1 == now)
        w2, w21 = self.w2[by1], self.w21[by1]
        some = w21 > w2
        if not some.all():
            by1, w2, w21 = by1[some], w2[some], w21[some]
        low[by1], size[by1] = w2, w21 - w2
        by2 = np.flatnonzero(self.id2 == now)
        w2 = self.w2[by2]
        some = w2 > 0
        if not some.all():
            by2, w2 = by2[some], w2[some]
        low[by2], size[by2] = 0, w2
        return low, size

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose parts hold ``at``, and the parts."""
        if self.slot is None:
            kind = np.uint16 if self.size <= 1 << 16 else np.uint32
            self.slot = np.repeat(np.arange(self.size, dtype=kind), np.diff(self.below.astype(np.int64)))
        by21 = np.flatnonzero(at < self.w21)
        rest = (at - self.w21).astype(np.int64)
        rest[by21] = 0
        # Below 2^45 by below 2^25: the double nearest to the quotient has its whole part.
        rest += 1
        rest <<= COUNT_BITS
        rest -= 1
        ids = self.slot[(rest / self.w0.astype(np.int64)).astype(np.int64)].astype(np.int64)
        low, size = self._order0(ids)
        low += self.w21
        w2 = self.w2[by21]
        first = at[by21] < w2
        ids[by21] = np.where(first, self.id2[by21], self.id1[by21])
        low[by21] = np.where(first, U(0), w2)
        size[by21] = np.where(first, w2, self.w21[by21] - w2)
        return ids, low, size

    def learn(self, ids: np.ndarray) -> None:
        now = ids.astype(np.uint32)
        hit2, hit1 = self.id2 == now, self.id1 == now
        fresh = now << 3 | 1
        n = len(ids)
        for table, place, entry, sure, hit in ((self.order2, self.place, self.entry2, self.sure2, hit2),
                                               (self.order1, self.before1[:n], self.entry1, self.sure1, hit1)):
            kept = entry + GAINS[hit.view(np.uint8) << 3 | sure.astype(np.uint8)]
            table[place] = np.where(sure > 0, kept, fresh)
        self.before2 = np.concatenate([self.before1[:n], self.before2[n:]])
        self.before1 = np.concatenate([ids, self.before1[n:]])
        self.held.append(ids)
        self.outcomes += np.bincount(self.context << 2 | (hit2.view(np.uint8) << 1 | hit1), minlength=512)
        self.steps += 1
        if self.steps == self.due:
            self.seen += np.bincount(np.concatenate(self.held), minlength=self.size)
            neither, only1, only2, both = self.outcomes.reshape(128, 4).T
            self.tries += neither + only1 + only2 + both
            self.hits2 += only2 + both
            self.hits1 += only1
            self.outcomes[:] = 0
            self._count()
            self._weigh()
            self.held, self.due = [], self.due + min(128, self.due)


def _lanes(n: int) -> np.ndarray:
    """The ids of each lane, longest first: contiguous runs of a block."""
    lanes = max(1, min(LANES, -(-n // LANE_IDS)))
    return np.full(lanes, n // lanes) + (np.arange(lanes) < n % lanes)


def encode_ids(ids: np.ndarray, vocabulary: int) -> bytes:
    """Lanes' word counts and words, all as little-endian 32-bit integers."""
    lengths = _lanes(len(ids))
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    lanes, steps = len(lengths), int(lengths[0]) if len(ids) else 0
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words = np.zeros((steps + 4, lanes), np.uint64)  # a column for each lane; the first row takes a carry that never comes
    flat, put = words.reshape(-1), np.arange(lanes, 2 * lanes)
    model = Model(vocabulary, lanes)
    for t in range(steps):
        n = lanes if t < lengths[-1] else int(np.count_nonzero(lengths > t))  # fewer in the last step only
        now = ids[start[:n] + t]
        model.look(n)
        cum, freq = model.interval(now)
        model.learn(now)
        part = span[:n] >> U(TOTAL_BITS)
        cum *= part
        cum += low[:n]
        over = np.flatnonzero(cum < low[:n])
        flat[put[over] - lanes] += U(1)
        freq *= part
        out = np.flatnonzero(freq < TOP)
        at, added = put[out], cum[out]
        flat[at] = added >> U(32)
        put[out] = at + lanes
        cum[out] = added << U(32)
        freq[out] <<= U(32)
        low[:n], span[:n] = cum, freq
    for shift in (U(32), U(0)):
        flat[put] = low >> shift & U(0xFFFFFFFF)
        put += lanes
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> U(32)
    counts = put // lanes - 1
    kept = np.arange(len(words) - 1) < counts[:, None]
    return counts.astype("<u4").tobytes() + words[1:].astype("<u4").T[kept].tobytes()


def decode_ids(data: bytes, n: int, vocabulary: int) -> np.ndarray:
    lengths = _lanes(n)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    lanes, steps = len(lengths), int(lengths[0]) if n else 0
    counts = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u4", offset=4 * lanes), np.zeros(4, np.uint32)])
    take = np.concatenate([[0], np.cumsum(counts)])[:-1]
    code = words[take].astype(np.uint64) << U(32) | words[take + 1]
    take = take + 2
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    ids = np.zeros(n, np.int64)
    model = Model(vocabulary, lanes)
    for t in range(steps):
        k = lanes if t < lengths[-1] else int(np.count_nonzero(lengths > t))
        model.look(k)
        part = span[:k] >> U(TOTAL_BITS)
        now, cum, freq = model.find(np.minimum(code[:k] // part, U(TOTAL - 1)))
        model.learn(now)
        ids[start[:k] + t] = now
        cum *= part
        rest = code[:k] - cum
        freq *= part
        out = np.flatnonzero(freq < TOP)
        at = take[out]
        rest[out] = rest[out] << U(32) | words[np.minimum(at, len(words) - 1)]
        freq[out] <<= U(32)
        take[out] = at + 1
        code[:k], span[:k] = rest, freq
    return ids


def encode_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """A self-contained block.  A null doc_id is kept as the least 64-bit integer."""
    names = np.array([-2 ** 63 if d is None else d for d in doc_ids], "<i8")
    rest = names.tobytes() + lengths.astype("<i8").tobytes() + encode_ids(ids, vocabulary)
    return struct.pack(HEADER, MAGIC, len(ids), len(names), len(_lanes(len(ids))), vocabulary,
                       zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)) + rest


def decode_block(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their lengths, and all ids; a damaged block raises ValueError."""
    magic, n, docs, _, vocabulary, crc_ids, crc_rest = struct.unpack_from(HEADER, blob)
    rest = blob[struct.calcsize(HEADER):]
    if magic != MAGIC or zlib.crc32(rest) != crc_rest:
        raise ValueError("damaged block of token ids")
    names = [None if d == -2 ** 63 else d for d in np.frombuffer(rest, "<i8", docs).tolist()]
    lengths = np.frombuffer(rest, "<i8", docs, 8 * docs)
    ids = decode_ids(rest[16 * docs:], n, vocabulary)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("damaged block of token ids")
    return names, lengths, ids


_COMPILED: dict[int, Tokens] = {}


def _tokens(definition: str) -> Tokens:
    """The compiled tokenizer, kept by the Python worker for later tasks."""
    key = hash(definition)
    if key not in _COMPILED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _COMPILED.clear()
        _COMPILED[key] = Tokens(definition)
    return _COMPILED[key]


def _write(definition, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size, block = None, [], 0, 0

        def done():
            lengths = np.array([len(x) + 1 for _, x in held], np.int64)
            ends = np.array([end_id], np.uint32)
            ids = np.concatenate([y for _, x in held for y in (x, ends)]).astype(np.int64)
            blob = encode_block([d for d, _ in held], lengths, ids, max(made.size, end_id + 1))
            return pa.record_batch([pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())],
                                   names=["block", "n_tokens", "blob"])

        for batch in batches:
            made = made or _tokens(definition.value)
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), made.of(utf8(batch)), strict=True):
                if held and size + len(own) + 1 > block_ids:
                    yield done()
                    held, size, block = [], 0, block + 1
                held.append((doc_id, own))
                size += len(own) + 1
        if held:
            yield done()
    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Tokenise ``docs`` with the tokenizers file ``tokenizer`` and write blocks
    at ``path``, in ascending (part, block, place in block) order of doc_id."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:  # on the driver; a vocabulary of fixed size
        sent = spark.sparkContext.broadcast(file.read())
    ordered = (docs.select("doc_id", "text").repartitionByRange(shuffle_parts(spark), "doc_id")
               .sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    blocks = map_texts(ordered, _write(sent, end_id, block_ids), "block int, n_tokens long, blob binary")
    blocks.select(F.spark_partition_id().alias("part"), "block", "n_tokens", "blob").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the blocks at ``path``: doc_id, start (ids before it),
    n_tokens, ids_crc32, and ids if asked for."""
    blocks = spark.read.schema("part int, block int, n_tokens long, blob binary").parquet(path)
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).selectExpr("part", "sum(_n) OVER (ORDER BY part) - _n AS _part_start")
    starts = (sizes.selectExpr("part", "block", "sum(n_tokens) OVER (PARTITION BY part ORDER BY block) - n_tokens AS _block_start")
              .join(parts, "part").selectExpr("part", "block", "_part_start + _block_start AS first"))
    starts = stored(starts, "block-starts")  # a row for each block, which holds about BLOCK_IDS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(batch.column("first").to_pylist(), batch.column("blob"), strict=True):
                names, lengths, ids = decode_block(blob.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array(first + begins), pa.array(lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select("part", "block", "blob").join(starts, ["part", "block"]).select("first", "blob").mapInArrow(released(run), schema)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text, ...) as token ids and read them back: one
    row per row: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty: the end id alone.  Rows that repeat a doc_id
    stand side by side, in the order of their texts' CRC; null doc_ids first.
    An empty table gives an empty result.  Other columns are ignored.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
