"""Structured Streaming operators R1-R6.

Sources are file streams with explicit schemas (``readStream.parquet``).
State is the engine's own (aggregations, joins, keyed state with timers) or a
stored table with a version for each batch.
Sinks are Parquet folders under the shared checkpoint folder, written by the
built-in file sink or by ``foreachBatch`` as versions keyed on the batch id (a
retried batch overwrites its own version, so results are exactly-once); the
last two versions are kept.  Nothing is collected to the driver.  Event times are TIMESTAMP_NTZ at rest; the
watermark needs TIMESTAMP, so event time is cast on the way in (session zone
UTC, an identity round trip) and back on the way out.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lotquery.functions import exprs as X
from lotquery.functions.scan import day_block, ordered_scan, quantile_block
from lotquery.operators.dashboard import grid_cells, grid_json, grid_members
from lotquery.operators.windows import is_allowed
from lotquery.sources.derive import DERIVATIONS
from lotquery.sources.sinks import delete_folder, files, folders
from lotquery.sources.tables import SCHEMAS

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The driver's ``events`` file(s) as a stream."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(sf_dir)


def derived_stream(spark: SparkSession, name: str, events: DataFrame, **batch_tables: DataFrame) -> DataFrame:
    """Apply one fixture derivation (``pk_slot_event`` ...) to an event stream;
    other inputs (e.g. ``pk_vehicle``) join as static tables."""
    return spark.sql(DERIVATIONS[name], events=events, **batch_tables)


def table_stream(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A canonical table written as Parquet under ``path``, read as a stream."""
    return spark.readStream.schema(SCHEMAS[table]).parquet(path)


def as_event_time(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def _ntz(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


_STARTING = threading.Lock()


#: State with timers lives in the store that supports them.
KEYED_STATE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def start(writer, spark: SparkSession, state_partitions: int | None = None, conf: dict[str, str] | None = None) -> StreamingQuery:
    """Start a stream.  ``state_partitions`` fixes the number of state-store /
    shuffle partitions of its stateful operators; a query clones the session
    configuration when it starts, so this and ``conf`` are applied only around
    ``start()``, by one starter at a time, and restored at once."""
    wanted = {**(conf or {}), **({"spark.sql.shuffle.partitions": str(state_partitions)} if state_partitions else {})}
    with _STARTING:
        before = {k: spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            spark.conf.set(k, v)
        try:
            return writer.start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def default_state_partitions(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def run(query: StreamingQuery, timeout_s: int | None = None) -> None:
    query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise query.exception()


KEPT_VERSIONS = 2


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions under ``root``, oldest first."""
    found = [f for f in folders(spark, root) if f.startswith("batch=")]
    return sorted(int(f.removeprefix("batch=")) for f in found)


def _version(spark: SparkSession, root: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{root}/batch={number}")


def _previous(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """The newest version before ``batch_id``, or None before the first.  A
    version that can't be read is an error."""
    before = [n for n in _versions(spark, root) if n < batch_id]
    return _version(spark, root, before[-1]) if before else None


def _write_version(df: DataFrame, root: str, batch_id: int) -> None:
    """Write version ``batch_id`` and drop all but the last KEPT_VERSIONS."""
    df.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    for old in [n for n in _versions(df.sparkSession, root) if n <= batch_id][:-KEPT_VERSIONS]:
        delete_folder(df.sparkSession, f"{root}/batch={old}")


def _merge_periods(keys: list[str], time: str, unit: str, root: str):
    """A ``foreachBatch`` writer that keeps the current row of each key in a
    table partitioned by the ``unit`` (day, month) of the column ``time``: only
    the periods that a batch has rows of are rewritten, however long the history is.

    A batch first stores its merged periods apart (``batch=N``), then replaces
    them in ``current``.  A batch that runs again after they were stored replaces
    them from there, so a failure half way loses nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{root}/batch={batch_id}"
        new = batch.withColumn("period", F.date_trunc(unit, time).cast("date"))
        schema = new.schema
        if "_SUCCESS" not in files(spark, f"{staged}/merged"):
            new.write.mode("overwrite").parquet(f"{staged}/new")
            new = spark.read.schema(schema).parquet(f"{staged}/new")
            now = new
            if folders(spark, f"{root}/current"):
                held = (spark.read.schema(schema).parquet(f"{root}/current")
                        .join(new.select("period").distinct(), "period", "left_semi")
                        .join(new.select(*keys), keys, "left_anti"))
                now = new.unionByName(held)
            now.write.mode("overwrite").parquet(f"{staged}/merged")
        (spark.read.schema(schema).parquet(f"{staged}/merged").repartition("period").write.mode("overwrite")
         .partitionBy("period").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/current"))
        for old in [n for n in _versions(spark, root) if n < batch_id]:
            delete_folder(spark, f"{root}/batch={old}")
    return write


def _current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, period date").parquet(f"{root}/current").drop("period")


def latest_version(spark: SparkSession, root: str) -> DataFrame:
    versions = _versions(spark, root)
    if not versions:
        raise RuntimeError(f"nothing was published under {root}")
    return _version(spark, root, versions[-1])


# ------------------------------------------------------------------ R1

def live_slot_grid(slot_events: DataFrame, parking_slot: DataFrame, root: str,
                   trigger: dict | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """Keep the latest status per slot of the grid (streaming ``max_by``
    state) and publish the whole grid after every batch.  The table's snapshot
    is published before the first event."""
    members = grid_members(parking_slot)
    latest = (slot_events.join(members.select("slot_id"), "slot_id", "left_semi").groupBy("slot_id").agg(
        F.max_by("status", F.struct("event_time", "event_id")).alias("event_status")))
    spark = slot_events.sparkSession

    def publish(batch: DataFrame, batch_id: int) -> None:
        now = (members.join(batch, "slot_id", "left")
               .select("slot_id", "row", "col", F.coalesce("event_status", "status").alias("status")))
        _write_version(grid_cells(now), f"{root}/grid", batch_id)
        # The published message: the whole grid as compact JSON text (one row).
        cells = _version(batch.sparkSession, f"{root}/grid", batch_id)
        _write_version(grid_json(cells).select("grid_json"), f"{root}/grid_json", batch_id)

    if not _versions(spark, f"{root}/grid"):
        publish(spark.createDataFrame([], "slot_id long, event_status string"), -1)
    return start(latest.writeStream.outputMode("complete").foreachBatch(publish)
                 .option("checkpointLocation", f"{root}/_checkpoint")
                 .trigger(**(trigger or {"processingTime": "30 seconds"})), spark, state_partitions)


# ------------------------------------------------------------------ R2

def live_volumes(parking_log: DataFrame, root: str, trigger: dict | None = None, mode: str = "append",
                 watermark: str = "1 day", state_partitions: int | None = None) -> StreamingQuery:
    """R2: entries and exits per hour, window state bounded by the watermark.
    ``append`` writes each hour once the watermark passes it (file sink);
    ``update`` keeps a current table, hours still open included, to which each
    batch brings the hours whose count changed (``volumes_table``);
    ``complete`` rewrites the full table every batch."""
    counts = (parking_log.select("action", as_event_time("action_time").alias("t"))
              .withWatermark("t", watermark)
              .groupBy(F.window("t", "1 hour"), "action").agg(F.count(F.lit(1)).alias("n"))
              .select(_ntz(F.col("window.start")).alias("window_start"), "action", "n"))
    w = counts.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint") \
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
    spark = parking_log.sparkSession
    if mode == "update":
        return start(w.foreachBatch(_merge_periods(["window_start", "action"], "window_start", "month", root)), spark, state_partitions)
    if mode == "complete":
        return start(w.foreachBatch(lambda df, bid: _write_version(df, f"{root}/whole", bid)), spark, state_partitions)
    return start(w.format("parquet").option("path", f"{root}/out"), spark, state_partitions)


def volumes_table(spark: SparkSession, root: str) -> DataFrame:
    """Current hourly counts of an ``update`` or ``complete`` R2 run."""
    if _versions(spark, f"{root}/whole"):
        return latest_version(spark, f"{root}/whole")
    return _current(spark, root, "window_start timestamp_ntz, action string, n long")


# ------------------------------------------------------------------ R3

ALERT_SCHEMA = ("event_id long, slot_id long, event_time timestamp_ntz, from_status string, to_status string, "
                "kind string")


def check_moves(events: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One batch of R3: (alerts, last event of each slot).  ``held`` has the
    last event of each slot before the batch.  Events older than it are ``late``
    and don't move it; the rest follow it in order, and a move outside the
    allowed table is ``illegal``.  A slot's events are scanned in blocks of
    about equal row counts, so no task holds a hot slot whole.  Events without
    a slot are left out."""
    events = events.filter(F.col("slot_id").isNotNull()).select("event_id", "slot_id", "event_time", "status")
    if held is None:
        held = events.limit(0)
    last = F.struct("event_time", "event_id")
    known = held.select("slot_id", F.struct("event_time", "event_id").alias("_lq_last"), F.col("status").alias("_lq_status"))
    marked = events.join(known, "slot_id", "left")
    is_late = F.coalesce(F.col("_lq_last") > last, F.lit(False))
    late = marked.filter(is_late).select("event_id", "slot_id", "event_time", F.col("_lq_status").alias("from_status"),
                                         F.col("status").alias("to_status"), F.lit("late").alias("kind"))
    ordered = (marked.filter(~is_late).select("event_id", "slot_id", "event_time", "status", F.lit(False).alias("old"))
               .unionByName(held.join(events.select("slot_id").distinct(), "slot_id", "left_semi").withColumn("old", F.lit(True))))
    scanned = ordered_scan(ordered, ["slot_id"], ["event_time", "event_id"],
                           quantile_block(events, X.micros("event_time")), prev_cols=["event_id", "status"])
    illegal = (scanned.filter(~F.col("old") & F.col("prev_event_id").isNotNull() & ~is_allowed(F.col("prev_status"), F.col("status")))
               .select("event_id", "slot_id", "event_time", F.col("prev_status").alias("from_status"),
                       F.col("status").alias("to_status"), F.lit("illegal").alias("kind")))
    row = F.struct("event_time", "event_id", "status")
    now = (held.unionByName(events).groupBy("slot_id").agg(F.max_by(row, last).alias("r"))
           .select(F.col("r.event_id").alias("event_id"), "slot_id", F.col("r.event_time").alias("event_time"), F.col("r.status").alias("status")))
    return late.unionByName(illegal), now


def live_transition_check(slot_events: DataFrame, root: str, trigger: dict | None = None,
                          state_partitions: int | None = None) -> StreamingQuery:
    """W2 on a stream.  Each micro-batch is checked as a whole by
    ``check_moves`` against a stored table with the last event of each slot (one
    row a slot, a version for each batch).  Alerts are a folder for each batch;
    a batch that runs again reads the same states and overwrites its own folders.
    Limit a source's files or offsets per trigger to bound a batch."""
    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = f"{root}/events"  # read several times below, and the source must not be read again
        batch.write.mode("overwrite").parquet(stored)
        alerts, last = check_moves(spark.read.parquet(stored), _previous(spark, f"{root}/last", batch_id))
        alerts.write.mode("overwrite").parquet(f"{root}/alerts/batch={batch_id}")
        _write_version(last, f"{root}/last", batch_id)

    wanted = slot_events.select("event_id", "slot_id", "event_time", "status")
    return start(wanted.writeStream.foreachBatch(check).option("checkpointLocation", f"{root}/_checkpoint")
                 .trigger(**(trigger or {"processingTime": "30 seconds"})), slot_events.sparkSession, state_partitions)


def transition_alerts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root}/alerts")


# ------------------------------------------------------------------ R4

class Stays(StatefulProcessor):
    """State of a bucket of tickets: entries without an exit so far, and exits
    whose entry may yet come.  Times are microseconds.  A bucket is read and
    written whole, so its tickets cost one call, not one each; what is open at
    a time is bounded by the slots and the watermark's delay."""

    def __init__(self, longest: int) -> None:
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ticket_id long, t long, entry boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _held(self):
        import pandas as pd

        rows = list(self.rows.get()) if self.rows.exists() else []
        return pd.DataFrame(rows, columns=["ticket_id", "t", "entry"]).astype({"ticket_id": "int64", "t": "int64", "entry": "bool"})

    def _hold(self, frame) -> None:
        """Store the rows, and call back once the watermark (in milliseconds) has passed the first of their ends."""
        ends = (frame["t"] + self.longest * frame["entry"]) // 1000 + 1
        before = self.timer.get()[0] if self.timer.exists() else None
        if frame.empty:
            self.rows.clear()
            self.timer.clear()
        else:
            self.rows.put(list(frame.itertuples(index=False, name=None)))
        first = None if frame.empty else int(ends.min())
        if before is not None and before != first:
            self.handle.deleteTimer(before)
        if first is not None and before != first:
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        both = pd.concat([self._held(), *(r[["ticket_id", "t", "entry"]] for r in rows)]).drop_duplicates().sort_values("t")
        entries, exits = both[both["entry"]], both[~both["entry"]]
        pair = dict(on="t", by="ticket_id", tolerance=self.longest)
        left = pd.merge_asof(entries, exits.assign(met=True), direction="forward", suffixes=("", "_x"), **pair)
        used = pd.merge_asof(exits, entries.assign(met=True), direction="backward", suffixes=("", "_e"), **pair)
        wait = used["met"].isna() & (used["t"] // 1000 >= timerValues.getCurrentWatermarkInMs())
        self._hold(pd.concat([left[left["met"].isna()], used[wait]])[["ticket_id", "t", "entry"]])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        over = (held["t"] + self.longest * held["entry"]) // 1000 < timerValues.getCurrentWatermarkInMs()
        self.timer.clear()  # it has fired
        self._hold(held[~over])
        alerts = held[over & held["entry"]]
        if len(alerts):
            yield alerts[["ticket_id", "t"]]

    def close(self) -> None:
        pass


def overstay_alerts(parking_log: DataFrame, root: str, max_minutes: int, trigger: dict | None = None,
                    delay: str = "1 hour", state_partitions: int | None = None, buckets: int | None = None) -> StreamingQuery:
    """A session opened with no exit within ``max_minutes`` -> one alert;
    an exit in time clears it, in whatever order the two arrive.  Keyed state with
    event-time timers at the open sessions' deadlines: when the watermark
    passes one, the alert is written and the state is dropped.  Tickets are
    keyed in ``buckets`` by their hash (default 8 for each state partition; like
    those it stays as it is for the life of a checkpoint).  Rows without ticket,
    time or action are left out."""
    spark = parking_log.sparkSession
    count = buckets or 8 * int(state_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    events = (parking_log.filter(F.col("action").isin("entry", "exit") & F.col("ticket_id").isNotNull() & F.col("action_time").isNotNull())
              .select(F.pmod(F.xxhash64("ticket_id"), F.lit(count)).alias("bucket"), "ticket_id", (F.col("action") == "entry").alias("entry"),
                      as_event_time("action_time").alias("time"), X.micros("action_time").alias("t"))
              .withWatermark("time", delay))
    late = events.groupBy("bucket").transformWithStateInPandas(
        Stays(max_minutes * 60_000_000), "ticket_id long, t long", "append", "EventTime")
    alerts = late.select("ticket_id", _ntz(F.timestamp_micros("t")).alias("entry_time"),
                         _ntz(F.timestamp_micros(F.col("t") + max_minutes * 60_000_000)).alias("deadline"), F.lit("overstay").alias("kind"))
    return start(alerts.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
                 .option("checkpointLocation", f"{root}/_checkpoint")
                 .trigger(**(trigger or {"processingTime": "30 seconds"})), spark, state_partitions, KEYED_STATE)


# ------------------------------------------------------------------ R5

def reservation_expiry(reservations: DataFrame, arrivals: DataFrame, root: str, piece_hours: int = 24,
                       trigger: dict | None = None, delay: str = "1 hour",
                       state_partitions: int | None = None) -> StreamingQuery:
    """Confirmed reservations joined to arrivals of the same vehicle inside
    [from, to), however long.  A reservation is cut into pieces of
    ``piece_hours`` at most; a piece with the watermark on its end leaves the
    join's state once the watermark passes it, and an arrival ``piece_hours``
    later.  ``reservation_outcomes`` decides per reservation."""
    hours = F.ceil(F.timestamp_diff("SECOND", F.col("r_from"), F.col("r_to")) / 3600)
    pieces = F.greatest(F.lit(1), F.ceil(hours / piece_hours)).cast("int")
    r = (reservations.filter(F.col("state") == "confirmed")
         .select("reservation_id", "slot_id", F.col("vehicle_id").alias("r_vehicle"),
                 as_event_time("from_time").alias("r_from"), as_event_time("to_time").alias("r_to"))
         .withColumn("pieces", pieces)
         .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
         .withColumn("p_from", F.timestamp_add("HOUR", F.col("piece") * piece_hours, F.col("r_from")))
         .withColumn("p_to", F.least(F.timestamp_add("HOUR", (F.col("piece") + 1) * piece_hours, F.col("r_from")), F.col("r_to")))
         .withWatermark("p_to", delay))
    a = (arrivals.select("arrival_id", F.col("vehicle_id").alias("a_vehicle"),
                         as_event_time("arrival_time").alias("a_time"))
         .withWatermark("a_time", delay))
    cond = F.expr("r_vehicle = a_vehicle AND a_time >= p_from AND a_time < p_to AND "
                  f"p_to <= a_time + INTERVAL {int(piece_hours)} HOURS")
    out = r.join(a, cond, "leftOuter").select(
        "reservation_id", "slot_id", F.col("r_vehicle").alias("vehicle_id"), _ntz("r_from").alias("from_time"),
        _ntz("r_to").alias("to_time"), "pieces", "piece", _ntz("p_to").alias("piece_to"), "arrival_id")
    return start(out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/pieces")
                 .option("checkpointLocation", f"{root}/_checkpoint")
                 .trigger(**(trigger or {"processingTime": "30 seconds"})), reservations.sparkSession,
                 state_partitions)


PIECES_SCHEMA = ("reservation_id long, slot_id long, vehicle_id long, from_time timestamp_ntz, to_time timestamp_ntz, "
                 "pieces int, piece int, piece_to timestamp_ntz, arrival_id long")


def reservation_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Outcomes of an R5 run: a ``fulfilled`` row for each arrival in a
    reservation, an ``expired`` row (its slot goes back to Empty) where all
    pieces ended without one; none while a reservation is open."""
    rows = spark.read.schema(PIECES_SCHEMA).parquet(f"{root}/pieces")
    own = ["reservation_id", "slot_id", "vehicle_id", "from_time", "to_time"]
    met = rows.filter(F.col("arrival_id").isNotNull()).select(
        *own, "arrival_id", F.lit("fulfilled").alias("outcome"), F.lit(None).cast("string").alias("slot_status"))
    expired = (rows.groupBy(*own, "pieces").agg(F.count(F.when(F.col("arrival_id").isNull(), 1)).alias("ended"))
               .filter(F.col("ended") == F.col("pieces"))
               .select(*own, F.lit(None).cast("bigint").alias("arrival_id"), F.lit("expired").alias("outcome"),
                       F.lit("Empty").alias("slot_status")))
    return met.unionByName(expired)


CHANGES_SCHEMA = "event_id long, event_time timestamp_ntz, slot_id long, status string"


def live_expiries(spark: SparkSession, reservations_root: str, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Follows a running R5 (its ``root``) and writes a status change for each
    reservation that expires: its slot is Empty from the reservation's end on.

    A reservation has expired once all its pieces ended without an arrival.  The
    pieces ended so far of reservations still open are a stored table, a version
    for each batch; a row goes once every piece of its time has been told."""
    own = ["reservation_id", "slot_id", "to_time", "pieces"]

    def decide(batch: DataFrame, batch_id: int) -> None:
        held = _previous(spark, f"{root}/open", batch_id)
        ended = batch.filter(F.col("arrival_id").isNull()).select(*own, F.lit(1).cast("bigint").alias("ended"))
        now = (ended if held is None else held.unionByName(ended)).groupBy(*own).agg(F.sum("ended").alias("ended"))
        told = batch.filter(F.col("arrival_id").isNull()).agg(F.max("piece_to")).scalar()
        expired = now.filter(F.col("ended") == F.col("pieces")).select(
            (-1 - F.col("reservation_id")).alias("event_id"), F.col("to_time").alias("event_time"), "slot_id", F.lit("Empty").alias("status"))
        expired.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")
        _write_version(now.filter((F.col("ended") < F.col("pieces")) & (told.isNull() | (F.col("to_time") >= told))), f"{root}/open", batch_id)

    pieces = spark.readStream.schema(PIECES_SCHEMA).parquet(f"{reservations_root}/pieces")
    return start(pieces.writeStream.foreachBatch(decide).option("checkpointLocation", f"{root}/_checkpoint")
                 .trigger(**(trigger or {"processingTime": "30 seconds"})), spark)


def status_changes(slot_events: DataFrame, expiries_root: str) -> DataFrame:
    """One stream of status changes: the slots' own events and the expiries that
    ``live_expiries`` writes.  R1 on it takes the last writer by event time, at
    equal times the slot's own event (an expiry's event_id is negative)."""
    expired = (slot_events.sparkSession.readStream.schema(CHANGES_SCHEMA).option("recursiveFileLookup", "true")
               .parquet(f"{expiries_root}/changes"))
    return slot_events.select("event_id", "event_time", "slot_id", "status").unionByName(expired)


# ------------------------------------------------------------------ R6

def lockout_windows(auth_events: DataFrame, n: int, minutes: int, slide_minutes: int | None = None,
                    watermark: str | None = None) -> DataFrame:
    """Failed logins per actor and window with at least ``n`` failures; works on
    a batch table (the batch twin) and on a stream (give ``watermark`` so the
    window state is evicted once the watermark passes the window end)."""
    ev = auth_events.filter(F.col("action") == "login_failed").withColumn("_lq_t", as_event_time("event_time"))
    if watermark:
        ev = ev.withWatermark("_lq_t", watermark)
    size = f"{minutes} minutes"
    win = F.window("_lq_t", size) if slide_minutes is None else F.window("_lq_t", size, f"{slide_minutes} minutes")
    return (ev.groupBy("staff_id", win.alias("w")).agg(F.count(F.lit(1)).alias("failures"))
            .filter(F.col("failures") >= n)
            .select("staff_id", _ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"),
                    "failures"))


def lockout_bursts(windows: DataFrame) -> DataFrame:
    """Sliding windows over the limit (``lockout_windows``) as one alert for each
    burst: an actor's windows that overlap, from the first one's start to the
    last one's end, with their number and the greatest count."""
    order, day = ["window_start"], day_block("window_start")
    known = windows.filter(F.col("staff_id").isNotNull())
    reached = ordered_scan(known, ["staff_id"], order, day, runs=[("reach", "max", "window_end", False)])
    first = F.when(F.col("window_start") < F.col("reach"), 0).otherwise(1)
    bursts = ordered_scan(reached.withColumn("first", first), ["staff_id"], order, day, runs=[("burst", "sum", "first", True)])
    return (bursts.groupBy("staff_id", "burst").agg(
        F.min("window_start").alias("burst_start"), F.max("window_end").alias("burst_end"),
        F.count(F.lit(1)).alias("windows"), F.max("failures").alias("most_failures")).drop("burst"))


def lockout_alerts(auth_events: DataFrame, root: str, n: int = 5, minutes: int = 15,
                   trigger: dict | None = None, state_partitions: int | None = None,
                   watermark: str = "1 hour", slide_minutes: int | None = None) -> StreamingQuery:
    """Actors with ``n`` or more failed logins in a tumbling window, or in a
    sliding one with ``slide_minutes`` (``lockout_bursts`` of the table merges
    windows that overlap).
    Update mode with a watermark: each batch brings the windows whose count
    changed to the table of current alerts (``lockout_table``), and window state
    is dropped once the watermark passes the window, so state stays bounded
    however long the service runs."""
    alerts = lockout_windows(auth_events, n, minutes, slide_minutes, watermark)
    return start(alerts.writeStream.outputMode("update")
                 .foreachBatch(_merge_periods(["staff_id", "window_start", "window_end"], "window_start", "day", root))
                 .option("checkpointLocation", f"{root}/_checkpoint")
                 .trigger(**(trigger or {"processingTime": "30 seconds"})), auth_events.sparkSession,
                 state_partitions)


def lockout_table(spark: SparkSession, root: str) -> DataFrame:
    """Current alerts: the last count of each (actor, window)."""
    return _current(spark, root, "staff_id long, window_start timestamp_ntz, window_end timestamp_ntz, failures long")
