"""Commits of concurrent writers, partition-wise reports and deletion, and the
sweep of J10 against brute force."""

import datetime as dt
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from lotquery.operators import booking
from lotquery.sources import sinks

REQUESTS = ("request_id long, full_name string, phone string, email string, address string, license_plate string, "
            "vehicle_type_text string")


def requests(spark, first, plates):
    return spark.createDataFrame([(first + i, f"name {first + i}", None, None, None, p, "1") for i, p in enumerate(plates)], REQUESTS)


def base(spark):
    return (spark.createDataFrame([(1,), (2,)], "customer_id long"),
            spark.createDataFrame([(7, "10A-000.00")], "vehicle_id long, license_plate string"),
            spark.createDataFrame([(1, "Sedan")], "vehicle_type_id int, type_name string"))


def test_two_batches_at_once_get_distinct_keys_and_unique_plates(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "reg")
    plates = [f"1{i}B-000.0{i}" for i in range(6)]
    meet, met, conflicts = threading.Barrier(2, timeout=120), threading.local(), []
    real = sinks.newest_commit

    def together(*args):  # both have seen the same state before either commits
        number = real(*args)
        if not getattr(met, "once", False):
            met.once = True
            meet.wait()
        return number
    monkeypatch.setattr(booking, "newest_commit", together)
    monkeypatch.setattr(booking, "commit_staged", lambda *a: _counted(conflicts, *a))
    failed = []

    def work(first, wanted):
        try:
            booking.register_batch(spark, requests(spark, first, wanted), *base(spark), root)
        except Exception as error:
            failed.append(error)
    threads = [threading.Thread(target=work, args=a) for a in ((100, plates[:4] + ["10A-000.00"]), (200, plates[2:]))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not failed and len(conflicts) == 1
    vehicles = sinks.read_committed(spark, root, "new_vehicle").collect()
    customers = sinks.read_committed(spark, root, "new_customer").collect()
    assert sorted(v.license_plate for v in vehicles) == plates
    assert sorted(v.vehicle_id for v in vehicles) == list(range(8, 14))
    assert sorted(c.customer_id for c in customers) == sorted(v.customer_id for v in vehicles) == list(range(3, 9))
    rejects = sinks.read_committed(spark, root, "rejects").collect()
    assert sorted(r.outcome for r in rejects) == ["duplicate_plate"] * 3
    assert len([f for f in os.listdir(root) if f.startswith("batch-")]) == 2  # what lost is gone


def _counted(conflicts, *args):
    try:
        return sinks.commit_staged(*args)
    except sinks.CommitConflict as error:
        conflicts.append(error)
        raise


def test_one_of_many_writers_makes_a_commit(spark, tmp_path):
    os.makedirs(tmp_path / "c")
    path, won = str(tmp_path / "c" / "000.json"), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if sinks._publish(spark, path, str(i)) else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and open(path).read() == str(won[0]) and os.listdir(tmp_path / "c") == ["000.json"]


def test_commits_are_read_in_order(spark, tmp_path):
    root = str(tmp_path / "st")
    assert sinks.commits(spark, root) == [] and sinks.read_committed(spark, root, "a") is None
    for n in (1, 2, 3):
        sinks.commit_staged(spark, {"a": spark.range(n)}, root, after=n - 1)
    with pytest.raises(sinks.CommitConflict):
        sinks.commit_staged(spark, {"a": spark.range(9)}, root, after=2)
    assert sinks.read_staged(spark, root)["a"].count() == 3
    assert sinks.read_committed(spark, root, "a").count() == 6 and sinks.read_committed(spark, root, "a", 2).count() == 3


def test_report_of_one_day_replaces_that_day(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = lambda n, *days: spark.createDataFrame([(d, n) for d in days], "d string, n int")
    sinks.export_report(rows(1, "2024-01-01", "2024-01-02", "2024-01-03"), path, "d")
    before = {d: os.listdir(f"{path}/{d}") for d in os.listdir(path) if d.startswith("d=")}
    sinks.export_report(rows(2, "2024-01-02", "2024-01-04"), path, "d")
    got = sorted((str(r.d), r.n) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 1), ("2024-01-04", 2)]
    assert all(os.listdir(f"{path}/d=2024-01-0{i}") == before[f"d=2024-01-0{i}"] for i in (1, 3))
    sinks.export_report(rows(3, "2024-01-02"), path, "d", replace="all")
    assert [r.n for r in spark.read.parquet(path).collect()] == [3]


def test_purge_drops_folders_and_rewrites_one_month(spark, small_tables, tmp_path):
    from lotquery.operators.audit import retention_filter
    log = small_tables.parking_log.unionByName(small_tables.parking_log.limit(3).withColumn("action_time", F.lit(None).cast("timestamp_ntz")))
    tables = type("T", (), {"parking_log": log, "names": lambda self: ["parking_log"]})()
    root = str(tmp_path / "canon")
    sinks.write_canonical_tables(spark, tables, root)
    path = f"{root}/parking_log"
    files = lambda: {(m, f) for m in os.listdir(path) if m.startswith("month=") for f in os.listdir(f"{path}/{m}") if f.endswith(".parquet")}
    before = files()
    kept, _ = retention_filter(log, "action_time", 900, "2001-08-05 00:00:00")  # the cut-off lies in 1999-02
    done = sinks.purge_expired(spark, path, "action_time", 900, "2001-08-05 00:00:00")
    assert done["rewritten"] == ["month=1999-02-01"] and len(done["dropped"]) > 12 and max(done["dropped"]) == "month=1999-01-01"
    after = files()
    assert {m for m, _ in before - after} == {*done["dropped"], "month=1999-02-01"}
    assert {m for m, _ in after - before} == {"month=1999-02-01"}  # all other files are the same ones
    got = spark.read.parquet(path)
    assert sorted(r.log_id for r in got.collect()) == sorted(r.log_id for r in kept.collect())
    assert got.filter("action_time IS NULL").count() == 3
    assert sinks.purge_expired(spark, path, "action_time", 900, "2001-08-05 00:00:00") == {"dropped": [], "rewritten": ["month=1999-02-01"]}
    month = spark.read.parquet(path).filter(F.col("month") == F.lit("1999-02-01").cast("date"))
    assert "PartitionFilters: [isnotnull(month" in month._jdf.queryExecution().toString()


def test_arrival_booking_against_brute_force(spark):
    dice, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    res, arr = [], []
    for i in range(400):
        a = dice.randrange(100)
        res.append((i, dice.randrange(8) or None, at(a), at(a + dice.choice((-1, 0, 1, 2, 5, 30, 100_000))), dice.choice(("confirmed", "canceled"))))
        arr.append((i, dice.randrange(9) or None, at(dice.randrange(130)) if i % 50 else None))
    reservation = spark.createDataFrame(res, "reservation_id long, vehicle_id long, from_time timestamp_ntz, to_time timestamp_ntz, state string")
    arrivals = spark.createDataFrame(arr, "arrival_id long, vehicle_id long, arrival_time timestamp_ntz")
    got = {r.arrival_id: r.reservation_id for r in booking.arrival_booking(arrivals, reservation).collect()}
    want = {}
    for i, v, t in arr:
        fits = [(r[2], r[0]) for r in res if r[4] == "confirmed" and t and v and r[1] == v and r[2] <= t < r[3]]
        want[i] = min(fits)[1] if fits else None
    assert got == want and None in want.values() and len(set(want.values())) > 10


def test_a_long_reservation_is_one_row(spark):
    """Ten years make as many rows as an hour: no plan node multiplies rows."""
    one = spark.createDataFrame([(1, 1, dt.datetime(2010, 1, 1), dt.datetime(2020, 1, 1), "confirmed")],
                                "reservation_id long, vehicle_id long, from_time timestamp_ntz, to_time timestamp_ntz, state string")
    came = spark.createDataFrame([(5, 1, dt.datetime(2019, 12, 31)), (6, 1, dt.datetime(2020, 1, 1))],
                                 "arrival_id long, vehicle_id long, arrival_time timestamp_ntz")
    out = booking.arrival_booking(came, one)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.arrival_id: r.is_booked for r in out.collect()} == {5: True, 6: False}


def test_blocks_follow_quantiles(spark):
    """The two-level search gives the number of quantiles below a value."""
    from lotquery.functions.scan import quantile_block
    rows = spark.range(1000).withColumn("v", F.col("id") * F.col("id"))
    for n in (2, 3, 10, 37):
        got = quantile_block(rows, F.col("v"), n)(rows.unionByName(spark.createDataFrame([(-1, None)], "id long, v long"))).collect()
        bounds = rows.agg(F.percentile_approx(F.col("v").cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0]
        assert all(r["_lq_blk"] == (0 if r["v"] is None else sum(b < r["v"] for b in bounds)) for r in got)
        assert max(r["_lq_blk"] for r in got) == n - 1


def test_lowest_bookable_slots_against_brute_force(spark):
    dice, t0 = random.Random(8), dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    slots = [(i, 1, f"A-{i}", ("Sedan", "SUV")[i % 2], "Maintenance" if i % 11 == 0 else "Empty") for i in range(1, 40)]
    res, asked = [], []
    for i in range(500):
        a = dice.randrange(200)
        res.append((i, dice.randrange(1, 30), 1, at(a), at(a + dice.choice((0, 1, 3, 20))), dice.choice(("confirmed", "confirmed", "canceled"))))
        a = dice.randrange(210)
        asked.append((i, 1 + i % 3, at(a), at(a + dice.choice((1, 2, 30)))))
    frames = (spark.createDataFrame(asked, "request_id long, vehicle_type_id int, from_time timestamp_ntz, to_time timestamp_ntz"),
              spark.createDataFrame(slots, "slot_id long, area_id int, slot_code string, slot_type string, status string"),
              spark.createDataFrame([("Sedan", 1), ("SUV", 2)], "slot_type string, vehicle_type_id int"),
              spark.createDataFrame(res, "reservation_id long, slot_id long, vehicle_id long, from_time timestamp_ntz, to_time timestamp_ntz, state string"))
    kind = {"Sedan": 1, "SUV": 2}
    want = set()
    for i, v, a, b in asked:
        free = [s[0] for s in slots if kind[s[3]] == v and s[4] == "Empty"
                and not any(r[1] == s[0] and r[5] == "confirmed" and r[3] < r[4] and a < r[4] and r[3] < b for r in res)]
        want |= {(i, c, x) for c, x in enumerate(sorted(free)[:4], 1)}
    got = {(r.request_id, r.choice, r.slot_id) for r in booking.bookable_slot_list(*frames, k=4).collect()}
    assert got == want
    first = {r.request_id: r.first_slot_id for r in booking.bookable_slots(*frames).collect()}
    assert {(i, s) for i, c, s in got if c == 1} == {(i, s) for i, s in first.items() if s is not None}


def test_search_index_reads_the_term_s_folders(spark, small_tables, tmp_path):
    from lotquery.operators import audit
    path = str(tmp_path / "index")
    audit.build_search_index(small_tables.vehicle, small_tables.parking_slot, path, 32)
    for term in ("A-0", "12a", "7.2", "10A-000.00", "zzz", "000"):
        want = sorted(map(tuple, audit.search(small_tables.vehicle, small_tables.parking_slot, term).collect()))
        found = audit.search_indexed(spark, path, term, 32)
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "bucket" in filters and "(gram" in pushed
    with pytest.raises(ValueError):
        audit.search_indexed(spark, path, "A-", 32)


def test_queries_without_an_optional_library(monkeypatch):
    """A library that only the further operators need is missing: all others stay."""
    import sys

    import __spark_entry__ as entry
    before = set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("lotquery.") and "llm" in m or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    left = set(entry.queries())
    assert left and not any(n.startswith("op") and n[2].isdigit() for n in left) and left <= before
    assert set(entry.oracle_sql()) <= left
