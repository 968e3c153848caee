"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lotquery.session import ensure_session_conf, scratch_path

#: Whole texts of one Arrow batch are cut into pieces of at most this many
#: bytes (one text at least), so a worker holds the words of one piece only.
PIECE_BYTES = 1 << 20
#: Rows that Spark sends to a Python worker at a time, in the registered queries and the pipeline.
BATCH_ROWS = 2_000
#: Rows of a table that is broadcast, at most; else Spark shuffles.
SMALL = 1_000_000

#: Bytes that are no part of a word: ASCII white space, or all but a-z, 0-9 and beyond ASCII.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NO_WORD = np.ones(256, bool)
NO_WORD[48:58] = NO_WORD[97:123] = NO_WORD[128:] = False


def prepare(spark: SparkSession) -> None:
    """Session settings of the registered queries and the pipeline.  The operators
    themselves leave the session as it is."""
    ensure_session_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: it is
    computed once, and a lost executor rereads files instead of lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most PIECE_BYTES of ``column`` each."""
    sizes = batch.column(column).cast(pa.binary())
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(sizes).to_pylist()):
        held += n or 0
        if held > PIECE_BYTES and i > start:
            yield batch.slice(start, i - start)
            start, held = i, n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each row's text; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def released(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``each`` for ``mapInArrow``, after which the Python worker, which Spark
    keeps for other tasks, gives its free memory back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            import ctypes
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)
    return run


def map_texts(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType, column: str = "text") -> DataFrame:
    """``mapInArrow`` over bounded pieces of ``df``'s batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  used by pieces()
        yield from each(p for b in batches for p in pieces(b, column))
    return df.mapInArrow(released(run), schema)


def ship(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object with its class, for ``opened`` inside tasks."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(sent: Broadcast):
    return pickle.loads(sent.value)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame) -> DataFrame:
    """A stored table, with a broadcast hint if its rows are few enough."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (runs of bytes outside ``gap``,
    which holds the newline), each text's number of words, and the words'
    first bytes and ends within their texts."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    edge = np.diff(np.concatenate([[True], gap[raw], [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, start, side="right")
    counts = np.bincount(text, minlength=len(texts))
    if not len(start):
        return np.empty(0, np.uint64), counts, start, stop
    length = stop - start
    offset = np.concatenate([[0], np.cumsum(length)])[:-1]
    within = np.arange(length.sum(), dtype=np.int32) - np.repeat(offset.astype(np.int32), length)
    powers = np.cumprod(np.concatenate([[1], np.full(int(length.max()) - 1, 0x100000001B3, np.uint64)]).astype(np.uint64))
    mixed = (raw[np.repeat(start - offset, length) + np.arange(len(within))].astype(np.uint64) + np.uint64(1)) * powers[within]
    hashes = scramble(np.add.reduceat(mixed, offset) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = np.concatenate([[0], ends])[text]
    return hashes, counts, start - base, stop - base
