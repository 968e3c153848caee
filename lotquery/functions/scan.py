"""Skew-proof ordered scans.

A window ``partitionBy(key).orderBy(t)`` sends every row of one key to one
task.  When one key (a busy zone, one slot, one vehicle type) holds a third of
all rows, that task holds a third of the data.  The helpers here compute the
same results in two levels:

1. split each key's ordered rows into *blocks* (a coarse, order-preserving
   bucket such as the day of the timestamp);
2. run the window inside ``(key, block)`` - bounded by the block width - and
   carry the state across blocks with a window over the tiny per-block table
   (one row per key and block).

The block expression must be non-decreasing in the order columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLK = "_lq_blk"
#: Accuracy of the quantiles that cut blocks, at most (the size of the sketch grows with it).
MAX_ACCURACY = 1_000_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store an intermediate that a plan reads several times as Parquet below the
    shared ``spark.checkpoint.dir``: computed once, read with column pruning, and
    a lost executor re-reads files instead of recomputing the lineage."""
    from lotquery.session import scratch_path
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def day_block(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("day", c)


BlockOf = Callable[[DataFrame], DataFrame]


def quantile_block(df: DataFrame, value: Column, blocks: int | None = None) -> BlockOf:
    """Blocks that follow row counts, not values: a row's block is the number of
    approximate quantiles of ``value`` in ``df`` that lie below its own value.
    As many blocks as shuffle partitions, however dense or sparse the values
    are; nulls are in block 0.  The quantiles are one scalar subquery; a row looks
    at every w-th of them and then at the w that its value lies among, w being
    about the root of their number.  Returns a function that adds the block column."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n <= 1:
        return lambda d: d.withColumn(_BLK, F.lit(0))
    wide = max(1, round(n ** 0.5))
    parts = F.array(*[F.lit(i / n) for i in range(1, n)])
    fine = F.coalesce(F.percentile_approx(value.cast("double"), parts, min(10 * n, MAX_ACCURACY)), F.array().cast("array<double>"))
    bounds = df.agg(fine.alias("fine")).select(F.struct(
        "fine", F.filter("fine", lambda b, i: (i + 1) % wide == 0).alias("coarse"))).scalar()

    def add(d: DataFrame) -> DataFrame:
        d = d.withColumns({"_lq_bounds": bounds, "_lq_value": value.cast("double")})
        below = lambda array: F.size(F.filter(array, lambda b: b < F.col("_lq_value")))
        d = d.withColumn("_lq_group", below(F.col("_lq_bounds.coarse")) * wide)
        found = F.col("_lq_group") + below(F.slice(F.col("_lq_bounds.fine"), F.col("_lq_group") + 1, F.lit(wide)))
        return (d.withColumn(_BLK, F.when(F.col("_lq_value").isNull(), 0).otherwise(found))
                .drop("_lq_bounds", "_lq_value", "_lq_group"))
    return add


_COMBINE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}


def ordered_scan(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], block: Column | BlockOf,
                 position: str | None = None, runs: Sequence[tuple[str, str, str, bool]] = (),
                 prev_cols: Sequence[str] = (), prev_prefix: str = "prev_",
                 next_cols: Sequence[str] = (), next_prefix: str = "next_") -> DataFrame:
    """One pass computing, per row in ``order_cols`` order within ``keys``:

    * ``position``: 1-based row number;
    * ``runs``: (name, 'sum' | 'min' | 'max', column, inclusive): the running
      value up to the row, or up to the row before it;
    * ``prev_*`` / ``next_*``: values of ``prev_cols`` / ``next_cols`` from the
      previous / next row (null at the ends of a key).

    One aggregate builds the per-(key, block) table (row count, totals, first
    and last row); one window over that small table carries offsets and edge
    rows across blocks; one join and one window inside (key, block) finish."""
    d = df.withColumn(_BLK, block) if isinstance(block, Column) else block(df)
    order_key = F.struct(*[F.col(c) for c in order_cols])
    aggs = [F.count(F.lit(1)).alias("_lq_n")]
    aggs += [getattr(F, fn)(col).alias(f"_lq_t_{name}") for name, fn, col, _ in runs]
    if prev_cols:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in prev_cols]), order_key).alias("_lq_last"))
    if next_cols:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in next_cols]), order_key).alias("_lq_first"))
    blocks = d.groupBy(*keys, _BLK).agg(*aggs)
    across = Window.partitionBy(*keys).orderBy(_BLK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = [*keys, _BLK]
    if position is not None:
        carry.append(F.coalesce(F.sum("_lq_n").over(before), F.lit(0)).alias("_lq_noff"))
    carry += [getattr(F, fn)(f"_lq_t_{name}").over(before).alias(f"_lq_c_{name}") for name, fn, _, _ in runs]
    if prev_cols:
        carry.append(F.lag("_lq_last").over(across).alias("_lq_pc"))
    if next_cols:
        carry.append(F.lead("_lq_first").over(across).alias("_lq_nc"))
    out = d.join(blocks.select(*carry), [*keys, _BLK])
    inner = Window.partitionBy(*keys, _BLK).orderBy(*order_cols)
    if position is not None:
        out = out.withColumn(position, (F.col("_lq_noff") + F.row_number().over(inner)).cast("bigint"))
    for name, fn, col, inclusive in runs:
        rows = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        out = out.withColumn(name, _COMBINE[fn](F.col(f"_lq_c_{name}"), getattr(F, fn)(col).over(rows)))
    if prev_cols:
        near = F.lag(F.struct(*[F.col(c) for c in prev_cols])).over(inner)
        out = out.withColumn("_lq_pv", F.coalesce(near, F.col("_lq_pc")))
        for c in prev_cols:
            out = out.withColumn(f"{prev_prefix}{c}", F.col("_lq_pv")[c])
    if next_cols:
        near = F.lead(F.struct(*[F.col(c) for c in next_cols])).over(inner)
        out = out.withColumn("_lq_nv", F.coalesce(near, F.col("_lq_nc")))
        for c in next_cols:
            out = out.withColumn(f"{next_prefix}{c}", F.col("_lq_nv")[c])
    return out.drop(_BLK, "_lq_noff", "_lq_pc", "_lq_nc", "_lq_pv", "_lq_nv", *(f"_lq_c_{r[0]}" for r in runs))


def neighbor(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], block: Column,
             cols: Sequence[str], direction: str = "prev", prefix: str = "prev_") -> DataFrame:
    """Values of ``cols`` from the previous (``lag``) or next (``lead``) row in
    order within each key; null at the first / last row of a key."""
    if direction == "prev":
        return ordered_scan(df, keys, order_cols, block, prev_cols=cols, prev_prefix=prefix)
    if direction == "next":
        return ordered_scan(df, keys, order_cols, block, next_cols=cols, next_prefix=prefix)
    raise ValueError(f"direction must be 'prev' or 'next', not {direction!r}")


def left_join_spread(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Left join on ``key`` (positive ids) in which left rows without a key are
    spread over negative keys by ``by``, so they don't meet in one task."""
    spread = F.coalesce(F.col(key), -1 - F.pmod(F.xxhash64(by), F.lit(1 << 40)))
    return (left.withColumn("_lq_key", spread).join(right.withColumnRenamed(key, "_lq_key"), "_lq_key", "left")
            .drop("_lq_key"))
