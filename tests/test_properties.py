"""Property tests: decoding rules, fee shape, registration outcome partition,
and the two-level scans against plain windows."""

import datetime as dt
import random
import re
from decimal import Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from lotquery.functions import scan
from lotquery.operators import booking, dashboard as dash, pricing


def java_decode(code):
    """Literal re-statement of the reference's socket decoding rules."""
    if code is None:
        return None
    parts = code.split("-")
    while parts and parts[-1] == "":
        parts.pop()  # Java String.split drops trailing empty strings
    if len(parts) < 2:
        return None
    first = parts[0].strip(" \t\n\r\x0b\x0c\x00")
    first = "".join(ch for ch in parts[0]).lstrip("".join(chr(i) for i in range(33))).rstrip(
        "".join(chr(i) for i in range(33)))
    row_char = "A" if first == "" else first[0]
    row = ord(row_char.upper()) - ord("A")
    digits = re.sub(r"[^0-9]", "", parts[1])
    if digits == "":
        return None
    col = int(digits) - 1
    if col > 2**31 - 2:
        return None
    return row, col


CODES = st.one_of(st.none(), st.text(alphabet="AbC-01 9x", max_size=8),
                  st.builds(lambda a, b: f"{a}-{b}", st.sampled_from(["A", "b", " c", "", "E", "Z"]),
                            st.sampled_from(["01", "5", "x3", "", "005", "99999999999"])))


@settings(max_examples=15, deadline=None)
@given(st.lists(CODES, min_size=40, max_size=80))
def test_decode_matches_java_rules(spark, codes):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "slot_id long, slot_code string")
    r, c = dash.decode_slot_code()
    got = {x["slot_id"]: (None if x["r"] is None else (x["r"], x["c"]))
           for x in df.select("slot_id", r.alias("r"), c.alias("c")).collect()}
    for i, code in enumerate(codes):
        assert got[i] == java_decode(code), (code, got[i])


def test_fee_monotone_and_capped(spark):
    """Fee grows with hours, and each further 24 h adds at most the daily cap."""
    as_of = dt.datetime(2026, 5, 6, 12, 0, 0)
    from lotquery.sources.tables import seed_tables
    s = seed_tables(spark, as_of)
    entry = dt.datetime(2026, 5, 4, 7, 0, 0)  # Monday inside the weekday band
    rows = [(h, 1, None, None, 1, entry, None, f"Q{h}", "completed", entry + dt.timedelta(hours=h), 1)
            for h in range(1, 80)]
    tickets = spark.createDataFrame(rows, s.ticket.schema)
    fees = pricing.parking_fee(tickets, s.vehicle, s.vehicle_type, s.pricing_rules, s.holidays, as_of)
    got = sorted((r["hours"], float(r["fee"])) for r in fees.collect())
    values = [f for _, f in got]
    assert all(b >= a for a, b in zip(values, values[1:]))
    assert got[0] == (1, 15000.0) and got[23][1] == 120000.0
    assert all(values[i + 24] - values[i] <= 120000.0 for i in range(len(values) - 24))


def test_registration_outcomes_partition_requests(small_tables):
    out = booking.register_drivers(small_tables.registration_requests, small_tables.customer,
                                   small_tables.vehicle, small_tables.vehicle_type)
    n = small_tables.registration_requests.count()
    assert out.count() == n and out.select("request_id").distinct().count() == n
    parts = booking.registration_outputs(out)
    assert parts["new_customer"].count() + parts["rejects"].count() == n
    assert parts["new_customer"].count() == parts["new_vehicle"].count()
    kinds = {r["outcome"] for r in out.select("outcome").distinct().collect()}
    assert {"registered", "bad_plate", "duplicate_plate", "missing_name", "unknown_vehicle_type"} <= kinds


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = 1 if rnd.random() < 0.4 else rnd.randint(2, 20)  # one hot key
        rows.append((i, key, base + dt.timedelta(seconds=rnd.randint(0, 5 * 86400)), rnd.randint(-3, 5)))
    return spark.createDataFrame(rows, "id long, k long, t timestamp_ntz, v long")


def test_two_level_scans_match_plain_windows(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.row_number().over(w).alias("pos"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                     F.lag("id").over(w).alias("prev_id"), F.lead("t").over(w).alias("next_t"))
    for block in (scan.day_block("t"), scan.quantile_block(df, F.unix_micros(F.col("t").cast("timestamp")), 9)):
        got = scan.ordered_scan(df, ["k"], ["t", "id"], block, "pos", [("run", "sum", "v", True)], ["id"], "prev_", ["t"], "next_")
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_running_minimum_and_maximum_match_plain_windows(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("least"),
                     F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("most"))
    got = scan.ordered_scan(df, ["k"], ["t", "id"], scan.day_block("t"),
                            runs=[("least", "min", "v", True), ("most", "max", "v", False)]).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_revenue_report_dimensions_add_up(small_tables):
    """Every dimension choice rolls up to the same grand total."""
    from lotquery.operators import reports
    totals = set()
    for dims in [(), ("shift",), ("staff_id", "gate_id"), ("type_name", "shift")]:
        r = reports.revenue_report(small_tables.payment, small_tables.ticket, small_tables.vehicle,
                                   small_tables.vehicle_type, "week", dims)
        top = r.filter(F.col("level") == (1 << (len(dims) + 1)) - 1).collect()
        assert len(top) == 1
        totals.add(round(top[0]["net_revenue"], 2))
    assert len(totals) == 1


def test_occupancy_profile_is_additive_and_non_negative(small_tables):
    """Time-weighted averages add up: a floor's average equals the sum of its
    zones' averages, and every vehicle-type split sums to the same total."""
    from lotquery.operators import windows as win
    t = small_tables
    as_of = "2001-08-05 00:00:00"
    zones = win.occupancy_profile(t.ticket, t.parking_slot, as_of)
    floors = win.occupancy_profile(t.ticket, t.parking_slot, as_of, by="floor_id", parking_area=t.parking_area)
    types = win.occupancy_profile(t.ticket, t.parking_slot, as_of, by="vehicle_type_id", vehicle=t.vehicle)
    assert zones.filter((F.col("avg_occupancy") < 0) | (F.col("peak") < 0)).count() == 0
    area_floor = {r["area_id"]: r["floor_id"] for r in t.parking_area.collect()}
    by_floor = {}
    for r in zones.collect():
        key = (area_floor[r["area_id"]], r["band"])
        by_floor[key] = by_floor.get(key, 0.0) + r["avg_occupancy"]
    got = {(r["floor_id"], r["band"]): r["avg_occupancy"] for r in floors.collect()}
    assert got.keys() == by_floor.keys()
    assert all(abs(got[k] - by_floor[k]) < 0.01 for k in got)
    total_z = sum(r["avg_occupancy"] for r in zones.collect())
    total_t = sum(r["avg_occupancy"] for r in types.collect())
    assert abs(total_z - total_t) < 0.05


def test_two_level_window_partitions_by_block(spark):
    """The row-level window of an ordered scan is partitioned by (key, block),
    never by the key alone, so one hot key is spread over many tasks."""
    df = _skewed(spark)
    out = scan.ordered_scan(df, ["k"], ["t", "id"], scan.day_block("t"),
                            runs=[("running", "sum", "v", True)], prev_cols=["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    specs = re.findall(r"\+- Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    assert len(specs) >= 3, plan
    for partition, order in specs:
        if order.startswith("_lq_blk"):
            continue  # the per-(key, block) table, one row per block
        assert "_lq_blk" in partition, (partition, order)


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_bookable_slots_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    statuses = ["Empty", "Occupied", "Reserved", "Maintenance", "Locked"]
    types = ["Sedan", "SUV", "Motorbike"]
    slots = [(i, 1, f"A-{i}", rnd.choice(types), rnd.choice(statuses)) for i in range(1, rnd.randint(2, 40))]
    res = []
    for r in range(rnd.randint(0, 60)):
        start = base + dt.timedelta(hours=rnd.randint(0, 30))
        res.append((r, rnd.choice(slots)[0], 1, start, start + dt.timedelta(hours=rnd.randint(1, 6)),
                    rnd.choice(["confirmed", "canceled"])))
    reqs = []
    for q in range(rnd.randint(1, 15)):
        start = base + dt.timedelta(hours=rnd.randint(0, 30), minutes=rnd.randint(0, 59))
        reqs.append((q, rnd.randint(1, 3), start, start + dt.timedelta(hours=2)))
    from lotquery.sources.tables import SCHEMAS
    slot_df = spark.createDataFrame(slots, SCHEMAS["parking_slot"])
    res_df = spark.createDataFrame(res, SCHEMAS["reservation"])
    req_df = spark.createDataFrame(reqs, SCHEMAS["booking_requests"])
    map_df = spark.createDataFrame([("Sedan", 1), ("SUV", 2), ("Motorbike", 3)], SCHEMAS["slot_type_map"])
    got = {r["request_id"]: (r["candidates"], r["blocked"], r["bookable"], r["first_slot_id"])
           for r in booking.bookable_slots(req_df, slot_df, map_df, res_df).collect()}
    type_of = {"Sedan": 1, "SUV": 2, "Motorbike": 3}
    for q, vt, f, t in reqs:
        compat = sorted(s[0] for s in slots if type_of[s[3]] == vt and s[4] not in ("Maintenance", "Locked"))
        blocked = {r[1] for r in res if r[5] == "confirmed" and r[1] in compat and f < r[4] and r[3] < t}
        free = [s for s in compat if s not in blocked]
        assert got[q] == (len(compat), len(blocked), len(compat) - len(blocked), free[0] if free else None), q


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_assign_slots_matches_brute_force(spark, seed):
    """W4 against a direct Python statement of the allocation rule."""
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    types = ["Sedan", "SUV", "Motorbike"]
    slots = [(i, rnd.randint(1, 4), f"A-{i}", rnd.choice(types), rnd.choice(["Empty", "Empty", "Occupied", "Reserved"]))
             for i in range(1, rnd.randint(2, 50))]
    arrivals = [(a, base + dt.timedelta(minutes=rnd.randint(0, 300)), a, None, rnd.randint(1, 3))
                for a in range(rnd.randint(1, 40))]
    from lotquery.sources.tables import SCHEMAS
    got = {r["arrival_id"]: r["slot_id"] for r in booking.assign_slots(
        spark.createDataFrame(arrivals, SCHEMAS["arrivals"]), spark.createDataFrame(slots, SCHEMAS["parking_slot"]),
        spark.createDataFrame([("Sedan", 1), ("SUV", 2), ("Motorbike", 3)], SCHEMAS["slot_type_map"])).collect()}
    type_of = {"Sedan": 1, "SUV": 2, "Motorbike": 3}
    total = {z: sum(1 for s in slots if s[1] == z) for z in {s[1] for s in slots}}
    occ = {z: sum(1 for s in slots if s[1] == z and s[4] == "Occupied") for z in total}
    for vt in (1, 2, 3):
        free = sorted((s for s in slots if s[4] == "Empty" and type_of[s[3]] == vt), key=lambda s: s[0])
        keyed, seen = [], {}
        for s in free:
            seen[s[1]] = seen.get(s[1], 0) + 1
            keyed.append(((occ[s[1]] + seen[s[1]]) / total[s[1]], s[0]))
        order = [sid for _, sid in sorted(keyed)]
        queue = sorted((a for a in arrivals if a[4] == vt), key=lambda a: (a[1], a[0]))
        for i, a in enumerate(queue):
            assert got[a[0]] == (order[i] if i < len(order) else None), (vt, a)


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_arrival_booking_matches_brute_force(spark, seed):
    """J10 (bucketed by vehicle and day) against a direct scan of all reservations."""
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    res = []
    for r in range(rnd.randint(0, 40)):
        start = base + dt.timedelta(hours=rnd.randint(0, 100), minutes=rnd.randint(0, 59))
        res.append((r, 1, rnd.randint(1, 4), start, start + dt.timedelta(hours=rnd.randint(1, 30)),
                    rnd.choice(["confirmed", "confirmed", "canceled"])))
    arrivals = [(a, base + dt.timedelta(hours=rnd.randint(0, 130), minutes=rnd.randint(0, 59)), rnd.randint(1, 4),
                 None, 1) for a in range(rnd.randint(1, 30))]
    from lotquery.sources.tables import SCHEMAS
    got = {r["arrival_id"]: r["reservation_id"] for r in booking.arrival_booking(
        spark.createDataFrame(arrivals, SCHEMAS["arrivals"]), spark.createDataFrame(res, SCHEMAS["reservation"])).collect()}
    for a_id, t, v, _, _ in arrivals:
        hits = sorted((r[3], r[0]) for r in res if r[2] == v and r[5] == "confirmed" and r[3] <= t < r[4])
        assert got[a_id] == (hits[0][1] if hits else None), a_id


def test_occupancy_average_never_exceeds_peak(small_tables):
    """In every band the time-weighted average is at most the peak level, and both are >= 0."""
    from lotquery.operators import windows as win
    t = small_tables
    for by, extra in (("area_id", {}), ("floor_id", {"parking_area": t.parking_area}),
                      ("vehicle_type_id", {"vehicle": t.vehicle})):
        prof = win.occupancy_profile(t.ticket, t.parking_slot, "2001-08-05 00:00:00", by=by, **extra)
        bad = prof.filter((F.col("avg_occupancy") > F.col("peak") + 1e-4) | (F.col("avg_occupancy") < 0)
                          | (F.col("peak") < 0))
        assert bad.count() == 0, by
        assert prof.filter(F.col("peak") > 0).count() > 0


def test_many_rules_in_one_group(spark):
    """Thousands of rules of one (type, day type): the latest effective date,
    then the highest id, wins; a hot group is no list."""
    ntz = dt.datetime
    rules = [(i, 1, 0, 86400, "Weekday", Decimal(10), Decimal(1), Decimal(100), True, dt.date(2020, 1, 1) + dt.timedelta(days=i % 700),
              dt.date(9999, 12, 31)) for i in range(5_000)]
    rules = spark.createDataFrame(rules, "rule_id long, vehicle_type_id int, start_sec int, end_sec int, day_type string, "
                                  "first_hour_price decimal(18,2), next_hour_price decimal(18,2), max_daily_price decimal(18,2), "
                                  "is_active boolean, effective_from date, effective_to date")
    entries = [ntz(2020, 1, 1, 8), ntz(2020, 2, 3, 9), ntz(2021, 3, 1, 10), ntz(2030, 1, 1, 1), ntz(2019, 12, 31, 9)]
    tickets = spark.createDataFrame([(i, 1, e, None, "active") for i, e in enumerate(entries)],
                                    "ticket_id long, vehicle_id long, entry_time timestamp_ntz, check_out_time timestamp_ntz, status string")
    vehicles = spark.createDataFrame([(1, 1)], "vehicle_id long, vehicle_type_id int")
    holidays = spark.createDataFrame([], "holiday date")
    got = {r.ticket_id: r.rule_id for r in pricing.match_pricing_rule(tickets, vehicles, rules, holidays).collect()}
    for i, e in enumerate(entries):
        fits = [(r % 700, r) for r in range(5_000) if dt.date(2020, 1, 1) + dt.timedelta(days=r % 700) <= e.date()]
        assert got[i] == (max(fits)[1] if fits and e.weekday() < 5 else None)


def test_free_slots_against_brute_force(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    slots = [(i, rng.choice(["Sedan", "SUV"]), rng.choice(["Empty", "Empty", "Locked"])) for i in range(1, 25)]
    held = []
    for i in range(160):  # one slot holds a third of all
        start = rng.randint(0, 90)
        held.append((i, 3 if rng.random() < 0.33 else rng.randint(1, 24), at(start), at(start + rng.randint(1, 9)),
                     rng.choice(["confirmed", "confirmed", "canceled"])))
    asked = [(i, rng.choice([1, 2, 9]), at(s), at(s + rng.randint(1, 6))) for i, s in enumerate(rng.choices(range(95), k=80))]
    got = {r.request_id: tuple(r)[2:] for r in booking.bookable_slots(
        spark.createDataFrame(asked, "request_id long, vehicle_type_id int, from_time timestamp_ntz, to_time timestamp_ntz"),
        spark.createDataFrame(slots, "slot_id long, slot_type string, status string"),
        spark.createDataFrame([("Sedan", 1), ("SUV", 2)], "slot_type string, vehicle_type_id int"),
        spark.createDataFrame(held, "reservation_id long, slot_id long, from_time timestamp_ntz, to_time timestamp_ntz, state string"),
    ).collect()}
    for i, kind, a, b in asked:
        fit = [s for s, k, status in slots if {"Sedan": 1, "SUV": 2}[k] == kind and status != "Locked"]
        taken = {s for _, s, x, y, state in held if state == "confirmed" and a < y and x < b}
        free = [s for s in fit if s not in taken]
        assert got[i] == (len(fit), len(fit) - len(free), len(free), min(free, default=None))


def test_occupancy_profile_against_a_minute_grid(spark):
    """W5 against a count of parked vehicles in every minute (whole minutes only)."""
    from lotquery.operators import windows as win
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    as_of = t0 + dt.timedelta(days=4, hours=7)
    stays = []
    for i in range(60):
        a = rng.randint(0, 5_500)
        stays.append((i, i, rng.randint(1, 4), t0 + dt.timedelta(minutes=a),
                      None if rng.random() < 0.1 else t0 + dt.timedelta(minutes=a + rng.choice([1, 30, 90, 2_000]))))
    tickets = spark.createDataFrame(stays, "ticket_id long, vehicle_id long, slot_id long, entry_time timestamp_ntz, "
                                    "check_out_time timestamp_ntz")
    slots = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "slot_id long, area_id int")
    got = {(r.area_id, r.band): (r.avg_occupancy, r.peak) for r in win.occupancy_profile(tickets, slots, str(as_of)).collect()}
    minutes = int((as_of - t0).total_seconds() // 60)
    for area in (1, 2):
        level = [0] * minutes
        for _, _, slot, a, b in stays:
            if (slot + 1) // 2 == area:
                stop = min(as_of, b or as_of)
                for m in range(int((a - t0).total_seconds() // 60), int((stop - t0).total_seconds() // 60)):
                    level[m] += 1
        for band in range(24):
            own = [n for m, n in enumerate(level) if m // 60 % 24 == band]
            average, peak = got[area, band]
            assert abs(average - sum(own) / len(own)) <= 5.1e-5 and peak == max(own)


def test_large_amounts_do_not_overflow(spark):
    from lotquery.operators import reports
    rows = [(1, dt.datetime(2024, 1, 1, 9), Decimal("1000000000000000.00")), (2, dt.datetime(2024, 1, 2, 9), Decimal("3000000000000001.00")),
            (3, dt.datetime(2024, 1, 4, 9), Decimal("5.00"))]
    pay = spark.createDataFrame(rows, "payment_id long, payment_time timestamp_ntz, amount decimal(18,2)")
    got = {r.day.day: (r.revenue, r.prev_revenue, r.pct_change) for r in reports.revenue_delta(pay).collect()}
    assert got == {1: (1e15, None, None), 2: (3000000000000001.0, 1e15, 200.0), 3: (0.0, 3000000000000001.0, -100.0), 4: (5.0, 0.0, None)}
    wide = spark.createDataFrame([(4 * 10 ** 17, 3)], "a long, b long")
    assert wide.select(reports.ratio_half_up(F.col("a"), F.col("b"), 2).alias("x")).first().x == 133333333333333333.33


def test_left_join_spread_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(i, None if i % 3 else i % 4 + 1) for i in range(60)], "id long, slot_id long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "slot_id long, code string")
    got = scan.left_join_spread(left, right, "slot_id", "id")
    want = left.join(right, "slot_id", "left").select("id", "slot_id", "code")
    assert sorted(map(repr, got.select("id", "slot_id", "code").collect())) == sorted(map(repr, want.collect()))
