"""Report operators: page contracts (A5-A8, W1, T1) and documented reports
(J5, A10-A15, U1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotquery.functions import exprs as X
from lotquery.functions.scan import cut_lineage, left_join_spread
from lotquery.sources.tables import ParkingTables

# Fixed slot status vocabulary (schema words plus Locked).
STATUS_COLUMNS = ("Empty", "Occupied", "Reserved", "Maintenance", "Locked")


def ratio_half_up(num: Column, den: Column, scale: int) -> Column:
    """``round(num / den, scale)`` half away from zero in decimal arithmetic;
    null when ``den`` is not above 0."""
    ratio = num.cast("decimal(20,2)") / F.when(den > 0, den).cast("decimal(20,2)")
    return F.round(ratio, scale).cast("double")


def zone_summary(parking_slot: DataFrame, parking_area: DataFrame) -> DataFrame:
    """A5: per zone total, occupied, percent (half-up, 0 when empty) and the
    page's label: Full >= 80, Busy >= 40, else Open."""
    per = parking_slot.groupBy("area_id").agg(F.count(F.lit(1)).alias("total"),
                                              X.count_when(F.col("status") == "Occupied").alias("occupied"))
    areas = parking_area.select("area_id", "area_code")
    z = areas.join(per, "area_id", "left").select(
        "area_id", "area_code", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("occupied", F.lit(0)).cast("bigint").alias("occupied"))
    pct = X.percent(F.col("occupied"), F.col("total"))
    label = F.when(pct >= 80, "Full").when(pct >= 40, "Busy").otherwise("Open")
    return z.select("area_id", "area_code", "total", "occupied", pct.alias("pct"), label.alias("label"))


def floor_occupancy(parking_slot: DataFrame, parking_area: DataFrame) -> DataFrame:
    """Occupied / total and percent per floor plus a grand-total row."""
    areas = parking_area.select("area_id", "floor_id")
    s = parking_slot.select("area_id", "status").join(areas, "area_id", "left")
    r = s.rollup("floor_id").agg(F.count(F.lit(1)).alias("total"),
                                 X.count_when(F.col("status") == "Occupied").alias("occupied"),
                                 F.grouping("floor_id").alias("g"))
    return r.select("floor_id", (F.col("g") == 1).alias("is_total"), "occupied", "total",
                    X.percent(F.col("occupied"), F.col("total")).alias("pct"))


def vehicle_type_share(ticket: DataFrame, vehicle: DataFrame, vehicle_type: DataFrame) -> DataFrame:
    """Active sessions per vehicle type and share of all active sessions
    (percent, 2 decimals).  The share's denominator comes from the small
    per-type table, never from a window over the sessions."""
    per = (ticket.filter(F.col("status") == "active").select("vehicle_id")
           .join(vehicle.select("vehicle_id", "vehicle_type_id"), "vehicle_id")
           .groupBy("vehicle_type_id").agg(F.count(F.lit(1)).alias("n")))
    types = vehicle_type.select("vehicle_type_id", "type_name")
    z = types.join(per, "vehicle_type_id", "left").select(
        "vehicle_type_id", "type_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("active_sessions"))
    # The denominator is a window over the per-type table (one row per vehicle
    # type: bounded by the type dimension), so the session join runs once.
    total = F.sum("active_sessions").over(Window.partitionBy())
    return z.select("vehicle_type_id", "type_name", "active_sessions",
                    F.coalesce(ratio_half_up(F.col("active_sessions") * 100, total, 2), F.lit(0.0)).alias("share_pct"))


def slot_status_breakdown(parking_slot: DataFrame, parking_area: DataFrame) -> DataFrame:
    """Slots per zone by status, one column per status of the fixed list."""
    p = parking_slot.groupBy("area_id").pivot("status", list(STATUS_COLUMNS)).agg(F.count(F.lit(1)))
    areas = parking_area.select("area_id", "area_code")
    return areas.join(p, "area_id", "left").select(
        "area_id", "area_code", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s.lower())
                                  for s in STATUS_COLUMNS])


REVENUE_DIMS = ("type_name", "shift", "staff_id", "gate_id")


def revenue_report(payment: DataFrame, ticket: DataFrame, vehicle: DataFrame, vehicle_type: DataFrame,
                   grain: str = "month", dims: tuple[str, ...] = ("type_name",)) -> DataFrame:
    """A10: net paid revenue (``final_amount`` of 'paid' payments) and payment
    count per period (``grain``: day / week / month) and the chosen dimensions
    (``type_name``, ``shift`` of check-out, ``staff_id`` who checked out,
    ``gate_id``), with subtotals: ``rollup(period, *dims)``, ``level`` =
    grouping id.  Only the ticket / vehicle columns a dimension needs are read."""
    unknown = set(dims) - set(REVENUE_DIMS)
    if unknown:
        raise ValueError(f"unknown revenue dimensions: {sorted(unknown)}")
    paid = payment.filter(F.col("status") == "paid").select("ticket_id", "final_amount", "payment_time")
    need = {"type_name": ["vehicle_id"], "shift": ["check_out_time"], "staff_id": ["check_out_by"],
            "gate_id": ["gate_id"]}
    tcols = sorted({c for d in dims for c in need[d]})
    typed = paid.join(ticket.select("ticket_id", *tcols), "ticket_id") if tcols else paid
    if "type_name" in dims:
        typed = (typed.join(vehicle.select("vehicle_id", "vehicle_type_id"), "vehicle_id")
                 .join(vehicle_type.select("vehicle_type_id", "type_name"),
                       "vehicle_type_id", "left"))
    dim_cols = {"type_name": F.col("type_name"), "shift": shift_of("check_out_time")[1].alias("shift"),
                "staff_id": F.col("check_out_by").alias("staff_id"), "gate_id": F.col("gate_id")}
    period = F.date_trunc(grain, "payment_time").alias("period")
    r = typed.rollup(period, *[dim_cols[d] for d in dims]).agg(
        F.sum("final_amount").alias("net"), F.count(F.lit(1)).alias("payments"), F.grouping_id().alias("level"))
    return r.select("period", *dims, F.col("net").cast("double").alias("net_revenue"),
                    F.col("payments").cast("bigint").alias("payments"), F.col("level").cast("int").alias("level"))


def shift_of(ts: str) -> tuple[Column, Column]:
    """Shift decision: 06-14 morning, 14-22 evening, 22-06 night; the business
    day of a shift starts at 06:00 (so 02:00 belongs to the previous night)."""
    h = F.hour(ts)
    shift = F.when((h >= 6) & (h < 14), "morning").when((h >= 14) & (h < 22), "evening").otherwise("night")
    day = F.date_trunc("day", F.col(ts) - F.expr("INTERVAL 6 HOURS"))
    return day, shift


def payments_per_ticket(payment: DataFrame) -> DataFrame:
    """Per ticket: final amounts split by status (partial aggregation)."""
    def part(status: str) -> Column:
        return F.sum(F.when(F.col("status") == status, F.col("final_amount")))
    return payment.groupBy("ticket_id").agg(part("paid").alias("paid"), part("refunded").alias("refunded"),
                                            part("unpaid").alias("unpaid"),
                                            F.sum(F.when(F.col("status") == "paid", F.col("amount"))).alias("paid_amount"),
                                            X.count_when(F.col("final_amount") != X.net_amount("amount", "discount"))
                                            .alias("net_mismatches"))


def shift_reconciliation(fees: DataFrame, payment: DataFrame) -> DataFrame:
    """Per check-out staff, business day and shift: sessions closed, fee
    due (F6), paid, refunded and unpaid amounts, difference (due - paid) and a
    flag when it is not zero."""
    closed = fees.filter(F.col("check_out_time").isNotNull())
    day, shift = shift_of("check_out_time")
    j = closed.join(payments_per_ticket(payment), "ticket_id", "left")
    zero = F.lit(0).cast("decimal(18,2)")
    g = j.groupBy(F.col("check_out_by").alias("staff_id"), day.alias("shift_day"), shift.alias("shift")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("fee").alias("fee_due"),
        F.coalesce(F.sum("paid"), zero).alias("paid"), F.coalesce(F.sum("refunded"), zero).alias("refunded"),
        F.coalesce(F.sum("unpaid"), zero).alias("unpaid"))
    diff = (F.col("fee_due") - F.col("paid")).cast("decimal(20,2)")
    return g.select("staff_id", "shift_day", "shift", F.col("sessions").cast("bigint"),
                    *[F.col(c).cast("double").alias(c) for c in ("fee_due", "paid", "refunded", "unpaid")],
                    diff.cast("double").alias("difference"), (diff != 0).alias("flagged"))


def peak_hours(ticket: DataFrame) -> DataFrame:
    """Entries and exits by ISO day of week (1 = Monday) x hour, all 168
    cells present.  Both timestamps come from one scan of the tickets."""
    events = ticket.select(F.inline(F.array(
        F.struct(F.col("entry_time").alias("ts"), F.lit(1).alias("is_entry")),
        F.struct(F.col("check_out_time").alias("ts"), F.lit(0).alias("is_entry"))))).filter(F.col("ts").isNotNull())
    counts = events.groupBy((F.weekday("ts") + 1).alias("dow"), F.hour("ts").alias("hour")).agg(
        X.count_when(F.col("is_entry") == 1).alias("entries"), X.count_when(F.col("is_entry") == 0).alias("exits"))
    cells = ticket.sparkSession.range(168).select(
        (F.col("id") / 24 + 1).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    return (cells.join(counts, ["dow", "hour"], "left")
            .select("dow", "hour", F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"),
                    F.coalesce("exits", F.lit(0)).cast("bigint").alias("exits")))


def capacity_alerts(parking_slot: DataFrame, parking_area: DataFrame, ticket: DataFrame,
                    threshold_pct: int = 76, min_free: int = 5, level: str = "zone") -> DataFrame:
    """Capacity alerts per zone (``level='zone'``) or floor (``'floor'``):
    ``occupancy`` (percent occupied >= threshold), ``low_free`` (assignable
    Empty slots < min_free), ``over_capacity`` (more active sessions on its
    slots than it has slots).  Sessions are counted per slot first, so the
    join to slots is one row per slot."""
    z = parking_slot.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("total"), X.count_when(F.col("status") == "Occupied").alias("occupied"),
        X.count_when(F.col("status") == "Empty").alias("assignable"))
    live = (ticket.filter((F.col("status") == "active") & F.col("slot_id").isNotNull())
            .groupBy("slot_id").agg(F.count(F.lit(1)).alias("n"))
            .join(parking_slot.select("slot_id", "area_id"), "slot_id")
            .groupBy("area_id").agg(F.sum("n").alias("active_sessions")))
    areas = parking_area.select("area_id", "area_code", "floor_id")
    counts = ("total", "occupied", "assignable", "active_sessions")
    j = (areas.join(z, "area_id", "left").join(live, "area_id", "left")
         .select("area_id", "area_code", "floor_id",
                 *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts]))
    if level == "floor":
        j = j.groupBy("floor_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in counts])
        ids = ["floor_id"]
    elif level == "zone":
        ids = ["area_id", "area_code"]
    else:
        raise ValueError("level must be 'zone' or 'floor'")
    pct = X.percent(F.col("occupied"), F.col("total"))
    alerts = F.filter(F.array(
        F.when((F.col("total") > 0) & (pct >= threshold_pct), F.lit("occupancy")),
        F.when(F.col("assignable") < min_free, F.lit("low_free")),
        F.when(F.col("active_sessions") > F.col("total"), F.lit("over_capacity"))), lambda a: a.isNotNull())
    return j.select(*ids, *counts, pct.alias("pct"), F.explode(alerts).alias("alert"))


ADMIN_ACTIONS = ("role_change", "config_change")


def audit_summary(auth_event: DataFrame, day_start_hour: int = 6, day_end_hour: int = 22,
                  rare_below: int = 2) -> DataFrame:
    """Actions per actor, action and day with the off-hours count; flags
    administrative actions taken off hours, and marks actions an actor took
    fewer than ``rare_below`` times in the whole log (``rare``).  Both levels
    are partial aggregates; the per-(actor, action) totals come from the
    per-day table, not from a second pass over the events."""
    h = F.hour("event_time")
    off = (h < day_start_hour) | (h >= day_end_hour)
    g = auth_event.groupBy("staff_id", "action", F.date_trunc("day", "event_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), X.count_when(off).alias("off_hours"))
    totals = g.groupBy("staff_id", "action").agg(F.sum("n").alias("_lq_total"))
    flag = F.when(F.col("action").isin(*ADMIN_ACTIONS) & (F.col("off_hours") > 0), F.lit("off_hours_admin"))
    return g.join(totals, ["staff_id", "action"]).select(
        "staff_id", "action", "day", F.col("n").cast("bigint"), "off_hours", flag.alias("flag"),
        (F.col("_lq_total") < rare_below).alias("rare"))


def revenue_delta(payment: DataFrame) -> DataFrame:
    """Revenue per calendar day (``amount`` of all payments, as A2) with the
    previous day's revenue and percent change (null when the previous is 0).

    The daily table is stored once; the calendar comes from ``sequence`` over
    its range (one row per day: bounded by the calendar, not the data), and the
    previous day is an equi-join on ``day - 1``, so no window spans the table."""
    daily = cut_lineage(payment.filter(F.col("payment_time").isNotNull())
                        .groupBy(F.to_date("payment_time").alias("d")).agg(F.sum("amount").cast("decimal(20,2)").alias("rev")))
    days = daily.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("d"))
    rev = F.coalesce("rev", F.lit(0).cast("decimal(20,2)"))
    cal = days.join(daily, "d", "left").select("d", rev.alias("rev"))
    before = daily.select(F.date_add("d", 1).alias("d"), F.col("rev").alias("prev"))
    first = daily.agg(F.min("d")).scalar()  # has no previous day
    prev = F.when(F.col("d") > first, F.coalesce("prev", F.lit(0).cast("decimal(20,2)")))
    j = cal.join(before, "d", "left").withColumn("prev", prev)
    change = F.when(F.col("prev") > 0, F.round((F.col("rev") - F.col("prev")) * 100 / F.col("prev"), 2))
    return j.select(F.col("d").cast("timestamp_ntz").alias("day"), F.col("rev").cast("double").alias("revenue"),
                    F.col("prev").cast("double").alias("prev_revenue"), change.cast("double").alias("pct_change"))


def recent_activity(parking_log: DataFrame, ticket: DataFrame, vehicle: DataFrame, parking_slot: DataFrame,
                    parking_area: DataFrame, as_of: str | dt.datetime, k: int = 10) -> DataFrame:
    """The latest ``k`` log actions at ``as_of`` with plate, zone, model,
    colour and age text.  The top-k runs first (TakeOrderedAndProject: each
    task keeps k rows); each other table is then reduced to the rows that the k
    need by a semi-join before anything else, so no fact is shuffled."""
    now = X.ts_lit(as_of)
    top = (parking_log.filter(F.col("action_time") <= now)
           .select("log_id", "ticket_id", "action", "action_time")
           .orderBy(F.col("action_time").desc(), F.col("log_id").desc()).limit(k))

    def needed(df: DataFrame, key: str, by: DataFrame) -> DataFrame:
        return F.broadcast(df.join(F.broadcast(by.select(key)), key, "left_semi"))  # k keys

    tickets = needed(ticket.select("ticket_id", "vehicle_id", "slot_id"), "ticket_id", top)
    vehicles = needed(vehicle.select("vehicle_id", "license_plate", _optional(vehicle, "model"),
                                     _optional(vehicle, "color")), "vehicle_id", tickets)
    slots = needed(parking_slot.select("slot_id", "area_id"), "slot_id", tickets)
    areas = needed(parking_area.select("area_id", "area_code"), "area_id", slots)
    j = (top.join(tickets, "ticket_id", "left").join(vehicles, "vehicle_id", "left")
         .join(slots, "slot_id", "left").join(areas, "area_id", "left"))
    return (j.select("log_id", "license_plate", "action", "area_code", "model", "color", "action_time",
                     X.age_text("action_time", now).alias("age"))
            .orderBy(F.col("action_time").desc(), F.col("log_id").desc()))  # k rows: newest first for display


def _optional(df: DataFrame, name: str) -> Column:
    """A nullable descriptive column that some sources do not carry."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)


def entry_exit_log(ticket: DataFrame, vehicle: DataFrame, vehicle_type: DataFrame, parking_slot: DataFrame,
                   payment: DataFrame) -> DataFrame:
    """One row per session with plate, type, slot, entry, exit, whole
    minutes and fee (sum of paid ``final_amount``; payments are aggregated per
    ticket before the join, so the join is one-to-one)."""
    fees = (payment.filter(F.col("status") == "paid").groupBy("ticket_id")
            .agg(F.sum("final_amount").alias("fee")))
    j = (ticket.select("ticket_id", "vehicle_id", "slot_id", "entry_time", "check_out_time")
         .join(vehicle.select("vehicle_id", "license_plate", "vehicle_type_id"), "vehicle_id", "left")
         .join(vehicle_type.select("vehicle_type_id", "type_name"),
               "vehicle_type_id", "left")
         .join(fees, "ticket_id", "left"))
    j = left_join_spread(j, parking_slot.select("slot_id", "slot_code"), "slot_id", "ticket_id")
    return j.select("ticket_id", "license_plate", "type_name", "slot_code", "entry_time",
                    F.col("check_out_time").alias("exit_time"),
                    X.minutes_between("entry_time", "check_out_time").alias("minutes"),
                    F.col("fee").cast("double").alias("fee"))


def exception_report(t: ParkingTables, max_minutes: int, as_of: str | dt.datetime) -> DataFrame:
    """One tagged list of session exceptions: lost_ticket, plate_mismatch,
    overtime, wrong_zone, fee_override (paid amount differs from F6), net_mismatch
    (a payment whose stored final amount is not amount - discount, F7), unpaid
    (closed session without a paid payment).

    One pass over the tickets: the fee (F6) carries the ticket and vehicle
    columns every test needs, the slot type and the per-ticket payments are
    joined once, and each ticket emits its 0..7 exception rows with ``inline``
    over an array of tagged structs - no union of seven re-scans."""
    from lotquery.operators.pricing import parking_fee

    now = X.ts_lit(as_of)
    fees = parking_fee(t.ticket, t.vehicle, t.vehicle_type, t.pricing_rules, t.holidays, as_of,
                       carry=("slot_id", "qr_code", "license_plate_snapshot"), vehicle_carry=("license_plate",),
                       how="left")
    slot_types = (t.parking_slot.select("slot_id", "slot_type")
                  .join(t.slot_type_map.withColumnRenamed("vehicle_type_id", "slot_vt"),
                        "slot_type", "left"))
    paid = payments_per_ticket(t.payment).select("ticket_id", "paid_amount", "net_mismatches")
    j = left_join_spread(fees, slot_types, "slot_id", "ticket_id").join(paid, "ticket_id", "left")
    minutes = X.minutes_between("entry_time", F.coalesce(F.col("check_out_time"), now))

    def tag(kind: str, cond: Column, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))

    tags = F.array(
        tag("lost_ticket", F.col("status") == "lost", F.col("qr_code")),
        tag("plate_mismatch", F.col("license_plate_snapshot").isNotNull()
            & (X.plate_key("license_plate_snapshot") != X.plate_key("license_plate")),
            F.concat_ws(" vs ", "license_plate_snapshot", "license_plate")),
        tag("overtime", minutes > max_minutes, minutes),
        tag("wrong_zone", F.col("slot_type").isNotNull()
            & (F.col("slot_vt").isNull() | (F.col("slot_vt") != F.col("vehicle_type_id"))), F.col("slot_type")),
        tag("fee_override", F.col("paid_amount").isNotNull() & (F.col("paid_amount") != F.col("fee")),
            F.concat(F.col("paid_amount").cast("decimal(18,2)").cast("string"), F.lit(" vs "),
                     F.col("fee").cast("string"))),
        tag("net_mismatch", F.col("net_mismatches") > 0, F.col("net_mismatches")),
        tag("unpaid", F.col("status").isin("completed", "lost") & F.col("paid_amount").isNull(), F.col("status")))
    return j.select("ticket_id", F.inline(F.filter(tags, lambda x: x.isNotNull())))
