"""Batch = stream checks, with the events split into several files so state
crosses micro-batches."""

import os
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lotquery.operators import dashboard as dash, windows as win
from lotquery.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_events():
    """The events file cut by time into 4 files, so maxFilesPerTrigger=1 gives 4 batches."""
    folder = tempfile.mkdtemp(prefix="lotquery-split-")
    table = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    n = table.num_rows
    for i in range(4):
        pq.write_table(table.slice(i * n // 4, (i + 1) * n // 4 - i * n // 4), f"{folder}/events_{i}.parquet")
    return folder


def test_live_grid_equals_batch_over_batches(spark, small_tables, split_events):
    root = tempfile.mkdtemp(prefix="lotquery-r1-")
    ev = live.derived_stream(spark, "pk_slot_event", live.event_stream(spark, split_events, 1))
    live.run(live.live_slot_grid(ev, small_tables.parking_slot, root, {"availableNow": True}))
    got = sorted(map(tuple, live.latest_version(spark, f"{root}/grid").select("row", "col", "occ").collect()))
    latest = win.latest_slot_status(small_tables.slot_event, small_tables.parking_slot)
    slots = small_tables.parking_slot.drop("status").join(latest.select("slot_id", "status"), "slot_id")
    want = sorted(map(tuple, dash.slot_grid(slots).collect()))
    assert got == want
    assert live._versions(spark, f"{root}/grid") == [2, 3]  # older versions are gone
    text = live.latest_version(spark, f"{root}/grid_json").first()["grid_json"]
    assert text == dash.grid_json(dash.slot_grid(slots)).first()["grid_json"]


def test_transition_check_multi_batch_equals_batch(spark, small_tables, split_events):
    root = tempfile.mkdtemp(prefix="lotquery-r3-")
    ev = live.derived_stream(spark, "pk_slot_event", live.event_stream(spark, split_events, 1))
    live.run(live.live_transition_check(ev, root, {"availableNow": True}))
    got = live.transition_alerts(spark, root)
    assert got.filter(F.col("kind") == "late").count() == 0  # files are in time order
    want = win.slot_transitions(small_tables.slot_event).filter(~F.col("is_legal"))
    assert sorted(r["event_id"] for r in got.select("event_id").collect()) == \
        sorted(r["event_id"] for r in want.select("event_id").collect())


def test_late_events_do_not_move_state(spark):
    import datetime as dt

    import pyarrow as pa

    root = tempfile.mkdtemp(prefix="lotquery-late-")
    src = tempfile.mkdtemp(prefix="lotquery-late-src-")
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    schema = "event_id long, event_time timestamp_ntz, slot_id long, status string"

    def write(name, rows):
        cols = list(zip(*rows))
        table = pa.table({"event_id": pa.array(cols[0], pa.int64()), "event_time": pa.array(cols[1], pa.timestamp("us")),
                          "slot_id": pa.array(cols[2], pa.int64()), "status": pa.array(cols[3], pa.string())})
        pq.write_table(table, f"{src}/{name}.parquet")

    write("a", [(1, t0, 1, "Occupied"), (2, t0 + dt.timedelta(hours=1), 1, "Empty")])
    stream = spark.readStream.schema(schema).parquet(src)
    live.run(live.live_transition_check(stream, root, {"availableNow": True}))
    write("b", [(3, t0 + dt.timedelta(minutes=30), 1, "Locked"), (4, t0 + dt.timedelta(hours=2), 1, "Reserved"),
                (5, t0 + dt.timedelta(hours=3), 1, "Maintenance")])
    stream = spark.readStream.schema(schema).parquet(src)
    live.run(live.live_transition_check(stream, root, {"availableNow": True}))
    got = {(r["event_id"], r["kind"], r["from_status"], r["to_status"])
           for r in live.transition_alerts(spark, root).collect()}
    assert (3, "late", "Empty", "Locked") in got
    assert (5, "illegal", "Reserved", "Maintenance") in got
    assert not any(k[0] == 4 for k in got)  # Empty -> Reserved is allowed


def test_lockout_stream_equals_batch_twin(spark, small_tables):
    root = tempfile.mkdtemp(prefix="lotquery-r6-")
    auth = live.derived_stream(spark, "pk_auth_event", live.event_stream(spark, SF))
    live.run(live.lockout_alerts(auth, root, 2, 15, {"availableNow": True}))
    got = sorted(map(tuple, live.lockout_table(spark, root).select(
        "staff_id", "window_start", "window_end", "failures").collect()))
    want = sorted(map(tuple, live.lockout_windows(small_tables.auth_event, 2, 15).collect()))
    assert got == want


def test_lockout_update_mode_over_batches_equals_batch_twin(spark, small_tables, split_events):
    root = tempfile.mkdtemp(prefix="lotquery-r6b-")
    auth = live.derived_stream(spark, "pk_auth_event", live.event_stream(spark, split_events, 1))
    live.run(live.lockout_alerts(auth, root, 1, 15, {"availableNow": True}))
    got = sorted(map(tuple, live.lockout_table(spark, root).select(
        "staff_id", "window_start", "window_end", "failures").collect()))
    want = sorted(map(tuple, live.lockout_windows(small_tables.auth_event, 1, 15).collect()))
    assert got and got == want


def test_reservation_expiry_multi_batch_equals_single_batch(spark, small_tables, split_events):
    """Join state carried across 4 micro-batches gives the same fulfilled /
    expired rows as one batch (files are in time order, so nothing is late and
    the final watermark is the same)."""
    def run_once(folder, per_trigger):
        root = tempfile.mkdtemp(prefix="lotquery-r5-")
        res = live.derived_stream(spark, "pk_reservation", live.event_stream(spark, folder, per_trigger))
        arr = live.derived_stream(spark, "pk_arrivals", live.event_stream(spark, folder, per_trigger),
                                  pk_vehicle=small_tables.vehicle)
        live.run(live.reservation_expiry(res, arr, root, trigger={"availableNow": True}))
        return sorted(map(tuple, live.reservation_outcomes(spark, root).collect()), key=repr)

    many = run_once(split_events, 1)
    one = run_once(SF, None)
    assert many and many == one
    assert {r[-2:] for r in many} == {("fulfilled", None), ("expired", "Empty")}


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_long_reservations_match_batch_booking(spark):
    """Reservations of several pieces, also with the piece as the state bound:
    fulfilled exactly where J10 books an arrival, expired at their own end."""
    import datetime as dt

    from lotquery.operators.booking import arrival_booking

    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    res = [(1, 1, 1, at(0), at(72), "confirmed"), (2, 2, 2, at(0), at(72), "confirmed"), (3, 3, 3, at(5), at(6), "confirmed"),
           (4, 4, 4, at(0), at(240), "confirmed"), (5, 5, 5, at(1), at(50), "canceled")]
    arr = [(10, at(30), 1, "p", 1), (11, at(71), 1, "p", 1), (12, at(72), 2, "p", 1), (13, at(5), 3, "p", 1),
           (14, at(100), 9, "p", 1), (15, at(60), 5, "p", 1)]
    rs = "reservation_id long, slot_id long, vehicle_id long, from_time timestamp_ntz, to_time timestamp_ntz, state string"
    ars = "arrival_id long, arrival_time timestamp_ntz, vehicle_id long, license_plate string, vehicle_type_id int"
    for hours in (24, 1000):
        base = tempfile.mkdtemp(prefix="lotquery-r5long-")
        _write(spark, f"{base}/res", res, rs)
        _write(spark, f"{base}/arr", arr, ars)
        live.run(live.reservation_expiry(spark.readStream.schema(rs).parquet(f"{base}/res"),
                                         spark.readStream.schema(ars).parquet(f"{base}/arr"), f"{base}/run", hours,
                                         {"availableNow": True}))
        got = {(r.reservation_id, r.arrival_id, r.outcome, r.slot_status) for r in live.reservation_outcomes(spark, f"{base}/run").collect()}
        assert got == {(1, 10, "fulfilled", None), (1, 11, "fulfilled", None), (3, 13, "fulfilled", None),
                       (2, None, "expired", "Empty")}  # 4 is still open
    booked = {r.reservation_id for r in arrival_booking(spark.createDataFrame(arr, ars), spark.createDataFrame(res, rs)).collect()}
    assert booked - {None} == {1, 3}


def test_volumes_over_batches_equal_batch_counts(spark, small_tables):
    log = small_tables.parking_log.filter("action_time IS NOT NULL").orderBy("action_time")
    base = tempfile.mkdtemp(prefix="lotquery-r2-")
    days = [r.d for r in log.selectExpr("date_trunc('year', action_time) AS d").distinct().orderBy("d").collect()]
    root = f"{base}/run"
    for d in days:  # a batch for each year, in time order
        log.filter(F.date_trunc("year", "action_time") == F.lit(d)).coalesce(1).write.mode("append").parquet(f"{base}/log")
        live.run(live.live_volumes(live.table_stream(spark, f"{base}/log", "parking_log"), root, {"availableNow": True}, mode="update"))
    got = sorted(map(tuple, live.volumes_table(spark, root).collect()))
    want = log.groupBy(F.date_trunc("hour", "action_time").alias("w"), "action").agg(F.count("*").alias("n"))
    assert len(days) > 2 and got == sorted(map(tuple, want.collect()))
    assert len(live._versions(spark, root)) == 1


def test_overstay_over_batches(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    schema = "log_id long, ticket_id long, staff_id long, action string, action_time timestamp_ntz"
    base = tempfile.mkdtemp(prefix="lotquery-r4-")
    batches = [[(1, 1, 1, "entry", 0), (2, 2, 1, "entry", 1)], [(3, 2, 1, "exit", 40), (4, 3, 1, "entry", 50)],
               [(5, 1, 1, "exit", 300), (6, 4, 1, "entry", 400), (7, 4, 1, "exit", 410)], [(8, 5, 1, "entry", 900), (9, 5, 1, "exit", 901)]]
    for rows in batches:
        _write(spark, f"{base}/log", [(*r[:4], t0 + dt.timedelta(minutes=r[4])) for r in rows], schema)
        live.run(live.overstay_alerts(spark.readStream.schema(schema).parquet(f"{base}/log"), f"{base}/run", 60, {"availableNow": True}))
    assert sorted(r.ticket_id for r in spark.read.parquet(f"{base}/run/out").collect()) == [1, 3]


def test_grid_is_published_before_any_event(spark, small_tables):
    root = tempfile.mkdtemp(prefix="lotquery-r1b-")
    none = f"{root}/none"
    spark.createDataFrame([], "event_id long, event_time timestamp_ntz, slot_id long, status string").write.parquet(none)
    stream = spark.readStream.schema("event_id long, event_time timestamp_ntz, slot_id long, status string").parquet(none)
    live.run(live.live_slot_grid(stream, small_tables.parking_slot, f"{root}/run", {"availableNow": True}))
    got = sorted(map(tuple, live.latest_version(spark, f"{root}/run/grid").select("row", "col", "occ").collect()))
    assert got == sorted(map(tuple, dash.slot_grid(small_tables.parking_slot).collect()))


def test_an_unreadable_version_fails_the_batch(spark):
    root = tempfile.mkdtemp(prefix="lotquery-bad-")
    live._write_version(spark.range(3), f"{root}/current", 0)
    for name in os.listdir(f"{root}/current/batch=0"):
        if name.endswith(".parquet"):
            with open(f"{root}/current/batch=0/{name}", "wb") as file:
                file.write(b"no parquet")
    with pytest.raises(Exception):
        live._previous(spark, f"{root}/current", 1).collect()
    assert live._previous(spark, f"{root}/nothing", 5) is None


def _hours(spark, first, last, n):
    return spark.range(first, last).select("id", F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("t"), F.lit(n).alias("n"))


def test_merge_rewrites_touched_periods_only(spark):
    root = f"{tempfile.mkdtemp(prefix='lotquery-merge-')}"
    write = live._merge_periods(["id"], "t", "day", root)
    table = lambda: sorted((r.id, r.n) for r in live._current(spark, root, "id long, t timestamp_ntz, n int").collect())

    def stored():
        return {f: sorted(os.listdir(f"{root}/current/{f}")) for f in os.listdir(f"{root}/current") if f.startswith("period=")}
    write(_hours(spark, 0, 24 * 10, 0), 0)
    before = stored()
    assert len(before) == 10
    for _ in range(2):  # a batch that runs again gives the same
        write(_hours(spark, 24 * 9 + 20, 24 * 10 + 5, 1), 1)
        assert table() == [(i, int(i >= 24 * 9 + 20)) for i in range(24 * 10 + 5)]
    after = stored()
    assert {f for f in before if before[f] == after[f]} == set(sorted(before)[:9]) and len(after) == 11
    assert live._versions(spark, root) == [1]


def test_a_batch_that_failed_half_way_loses_nothing(spark):
    """After the merged periods were stored, one of them is gone from the table."""
    import shutil

    root = f"{tempfile.mkdtemp(prefix='lotquery-merge-')}"
    write = live._merge_periods(["id"], "t", "day", root)
    write(_hours(spark, 0, 24, 0), 0)
    write(_hours(spark, 20, 30, 1), 1)
    shutil.rmtree(f"{root}/current/period=1970-01-01")
    write(_hours(spark, 20, 30, 1), 1)
    assert live._current(spark, root, "id long, t timestamp_ntz, n int").count() == 30


def test_a_hot_slot_is_not_in_one_task(spark):
    """Half of all events belong to one slot: its rows are scanned in blocks."""
    events = spark.range(40_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50 + 2).alias("slot_id"),
        F.timestamp_seconds(F.col("id") / 8).cast("timestamp_ntz").alias("event_time"),  # little more than an hour
        F.element_at(F.array(*[F.lit(x) for x in ("Empty", "Occupied", "Locked")]), (F.col("id") % 7 % 3 + 1).cast("int")).alias("status"))
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
           "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        alerts, last = live.check_moves(events, None)
        per_task = [r["count"] for r in alerts.groupBy(F.spark_partition_id()).count().collect()]
        want = win.slot_transitions(events).filter(~F.col("is_legal"))
        assert sum(per_task) == want.count() > 8_000
        hot = want.filter("slot_id = 1").count()
        assert max(per_task) < hot / 3
        assert last.count() == events.select("slot_id").distinct().count()
        got = alerts.select("event_id", "slot_id", "event_time", "from_status", "to_status")
        assert got.exceptAll(want.drop("is_legal")).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


LOG = "log_id long, ticket_id long, staff_id long, action string, action_time timestamp_ntz"


def _overstays(spark, base, batches, longest=60):
    """Alerts of R4 after each batch of (ticket, action, minute) rows."""
    import datetime as dt

    t0, seen = dt.datetime(2024, 1, 1), []
    for k, rows in enumerate(batches):
        _write(spark, f"{base}/log", [(100 * k + i, r[0], 1, r[1], t0 + dt.timedelta(minutes=r[2])) for i, r in enumerate(rows)], LOG)
        live.run(live.overstay_alerts(spark.readStream.schema(LOG).parquet(f"{base}/log"), f"{base}/run", longest, {"availableNow": True}))
        seen.append(sorted(r.ticket_id for r in spark.read.parquet(f"{base}/run/out").collect()))
    return seen


def test_overstay_exit_that_comes_late_clears_the_session(spark):
    """Ticket 1's exit is told after later events and after its own deadline in
    event time, but before the watermark passed it; ticket 2's exit is told
    before its entry; ticket 3 leaves too late; ticket 4 never leaves."""
    base = tempfile.mkdtemp(prefix="lotquery-r4b-")
    seen = _overstays(spark, base, [
        [(1, "entry", 0), (2, "exit", 30), (3, "entry", 2), (9, "entry", 100), (9, "exit", 101)],
        [(1, "exit", 50), (2, "entry", 41), (4, "entry", 70), (3, "exit", 90)],
        [(2, "exit", 45), (8, "entry", 150), (8, "exit", 160)],
        [(7, "entry", 1000), (7, "exit", 1001)]])
    assert seen == [[], [], [3], [3, 4]]


def test_overstay_state_is_empty_after_the_last_session(spark):
    base = tempfile.mkdtemp(prefix="lotquery-r4c-")
    _overstays(spark, base, [[(1, "entry", 0), (2, "entry", 1), (2, "exit", 5), (3, "exit", 9)], [(5, "entry", 1000), (5, "exit", 1001)]])
    # the source's end moves the watermark past everything but ticket 5, whose two rows met in one batch
    for name in ("rows", "timer"):
        state = spark.read.format("statestore").option("stateVarName", name).load(f"{base}/run/_checkpoint")
        assert state.count() == 0


def test_expired_reservation_frees_its_slot_in_the_grid(spark):
    """R5's expiries and the slots' own events in one stream, over batches."""
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    base = tempfile.mkdtemp(prefix="lotquery-r15-")
    rs = "reservation_id long, slot_id long, vehicle_id long, from_time timestamp_ntz, to_time timestamp_ntz, state string"
    ars = "arrival_id long, arrival_time timestamp_ntz, vehicle_id long, license_plate string, vehicle_type_id int"
    slots = spark.createDataFrame([(1, 1, "A-01", "Sedan", "Empty"), (2, 1, "A-02", "Sedan", "Empty"), (3, 1, "A-03", "Sedan", "Empty"),
                                   (4, 1, "A-04", "Sedan", "Occupied")], "slot_id long, area_id int, slot_code string, slot_type string, status string")
    batches = [  # slot 1: expires after 40 hours; slot 2: its car comes; slot 3: occupied again after its expiry
        ([(1, 1, 1, at(0), at(40), "confirmed"), (2, 2, 2, at(0), at(40), "confirmed"), (3, 3, 3, at(0), at(2), "confirmed")],
         [(10, at(1), 99, "p", 1)],
         [(1, at(0), 1, "Occupied"), (2, at(0), 2, "Occupied"), (3, at(0), 3, "Occupied")]),
        ([(4, 9, 9, at(30), at(31), "confirmed")], [(11, at(26), 2, "p", 1)], [(4, at(30), 3, "Occupied")]),
        ([(5, 9, 9, at(100), at(101), "confirmed")], [(12, at(100), 98, "p", 1)], [(5, at(100), 9, "Empty")]),
    ]
    once, grids = {"availableNow": True}, []
    for res, arr, events in batches:
        _write(spark, f"{base}/res", res, rs)
        _write(spark, f"{base}/arr", arr, ars)
        _write(spark, f"{base}/events", events, live.CHANGES_SCHEMA)
        live.run(live.reservation_expiry(spark.readStream.schema(rs).parquet(f"{base}/res"),
                                         spark.readStream.schema(ars).parquet(f"{base}/arr"), f"{base}/r5", 24, once))
        live.run(live.live_expiries(spark, f"{base}/r5", f"{base}/expiries", once))
        changes = live.status_changes(spark.readStream.schema(live.CHANGES_SCHEMA).parquet(f"{base}/events"), f"{base}/expiries")
        live.run(live.live_slot_grid(changes, slots, f"{base}/r1", once))
        grid = live.latest_version(spark, f"{base}/r1/grid").filter("row = 0")
        grids.append([r.occ for r in grid.orderBy("col").collect()][:4])
    assert grids[0] == [1, 1, 1, 1] and grids[1][0] == 1
    assert grids[2] == [0, 1, 1, 1]


def test_lockout_bursts_stream_equals_batch(spark, small_tables, split_events):
    root = tempfile.mkdtemp(prefix="lotquery-r6c-")
    auth = live.derived_stream(spark, "pk_auth_event", live.event_stream(spark, split_events, 1))
    live.run(live.lockout_alerts(auth, root, 1, 60, {"availableNow": True}, slide_minutes=20))
    got = sorted(map(tuple, live.lockout_bursts(live.lockout_table(spark, root)).collect()))
    windows = live.lockout_windows(small_tables.auth_event, 1, 60, 20)
    assert got == sorted(map(tuple, live.lockout_bursts(windows).collect()))
    rows = sorted(map(tuple, windows.collect()))
    want = []
    for staff, start, end, failures in rows:  # brute force
        if want and want[-1][0] == staff and start < want[-1][2]:
            want[-1] = (staff, want[-1][1], max(end, want[-1][2]), want[-1][3] + 1, max(failures, want[-1][4]))
        else:
            want.append((staff, start, end, 1, failures))
    assert got == want and any(r[3] > 1 for r in got)
