"""Window operators W2, W3, W5, W6, W7 and the slot utilisation report A13.

Every ordered scan per key (slot, zone) goes through ``functions.scan``: the
window runs inside (key, day block) partitions and state crosses blocks via
a small per-block table, so one busy slot or zone never lands in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotquery.functions import exprs as X
from lotquery.functions.scan import cut_lineage, day_block, neighbor, ordered_scan
from lotquery.operators.reports import ratio_half_up

# Fixed transition table (documented slot life cycle).  A repeat of the same
# status is a no-op and always allowed.
ALLOWED_MOVES = {
    "Empty": ("Occupied", "Reserved", "Maintenance", "Locked"),
    "Occupied": ("Empty",),
    "Reserved": ("Empty", "Occupied"),
    "Maintenance": ("Empty",),
    "Locked": ("Empty",),
}

EPOCH = "1970-01-01 00:00:00"


def is_allowed(from_status: Column, to_status: Column) -> Column:
    cond = from_status == to_status
    for src, targets in ALLOWED_MOVES.items():
        cond = cond | ((from_status == src) & to_status.isin(*targets))
    return F.coalesce(cond, F.lit(False))


def slot_transitions(slot_event: DataFrame) -> DataFrame:
    """Each slot's consecutive statuses (ordered by time, then event_id)
    with a flag for moves outside the allowed table.  The first event of a
    slot has no predecessor and is not a transition."""
    ev = slot_event.select("event_id", "slot_id", "event_time", "status")
    prev = neighbor(ev, ["slot_id"], ["event_time", "event_id"], day_block("event_time"),
                    ["status", "event_id"], direction="prev", prefix="prev_")
    return (prev.filter(F.col("prev_event_id").isNotNull())
            .select("event_id", "slot_id", "event_time", F.col("prev_status").alias("from_status"),
                    F.col("status").alias("to_status"),
                    is_allowed(F.col("prev_status"), F.col("status")).alias("is_legal")))


def status_intervals(slot_event: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """Events become [from, to) intervals (``to`` = next event of the slot,
    the last one closed at ``as_of``); total whole minutes and interval count
    per slot and status.  Events after ``as_of`` are ignored."""
    now = X.ts_lit(as_of)
    ev = slot_event.filter(F.col("event_time") <= now).select("event_id", "slot_id", "event_time", "status")
    nxt = neighbor(ev, ["slot_id"], ["event_time", "event_id"], day_block("event_time"),
                   ["event_time"], direction="next", prefix="next_")
    span = X.micros_between("event_time", F.coalesce(F.col("next_event_time"), now))
    return (nxt.groupBy("slot_id", "status")
            .agg(F.count(F.lit(1)).alias("intervals"), F.sum(span).alias("_us"))
            .select("slot_id", "status", F.col("intervals").cast("bigint"),
                    F.floor(F.col("_us") / 60_000_000).cast("bigint").alias("minutes")))


def latest_slot_status(slot_event: DataFrame, parking_slot: DataFrame) -> DataFrame:
    """Current status per slot: the latest event (time, then event_id)
    wins; slots without events keep the table's status.  ``max_by`` is a
    partial aggregate, so a busy slot is combined map-side."""
    latest = slot_event.groupBy("slot_id").agg(
        F.max_by("status", F.struct("event_time", "event_id")).alias("event_status"))
    return (parking_slot.select("slot_id", "status").join(latest, "slot_id", "left")
            .select("slot_id", F.coalesce("event_status", "status").alias("status"),
                    F.when(F.col("event_status").isNotNull(), "event").otherwise("table").alias("source")))


def _epoch_seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", X.ts_lit(EPOCH), ts)


def _band_seconds(t: Column, band: Column) -> Column:
    """Seconds of hour-of-day ``band`` in [epoch, t): full days give 3600 each,
    the current day gives the clipped part of the band."""
    return (F.floor(t / 86400) * 3600
            + F.least(F.greatest(F.pmod(t, F.lit(86400)) - band * 3600, F.lit(0)), F.lit(3600)))


PROFILE_GROUPS = ("area_id", "floor_id", "vehicle_type_id")


def occupancy_profile(ticket: DataFrame, parking_slot: DataFrame, as_of: str | dt.datetime,
                      by: str = "area_id", parking_area: DataFrame | None = None,
                      vehicle: DataFrame | None = None) -> DataFrame:
    """Per group (``by``: zone ``area_id``, ``floor_id`` or
    ``vehicle_type_id``) and hour-of-day band (0-23), the time-weighted average
    number of parked vehicles over the period [first entry day, ``as_of``) and
    the peak number parked at any instant in that band.

    * average: for each session, its seconds inside band b are
      F(end, b) - F(start, b) (closed form): 24 sums in one aggregate, turned
      into rows afterwards; divided by the band's seconds in the period.
    * peak: +1/-1 events give the occupancy level after each distinct time
      (two-level running sum per zone); each constant-level segment
      [t, next t) covers at most 24 bands; peak = max level per band.
    No window spans a whole zone, and no session is exploded by its length.
    """
    now_s = _epoch_seconds(X.ts_lit(as_of))
    sessions = (ticket.filter(F.col("slot_id").isNotNull() & (F.col("entry_time") < X.ts_lit(as_of)))
                .select("vehicle_id", "slot_id", _epoch_seconds(F.col("entry_time")).alias("a"),
                        F.least(_epoch_seconds(F.coalesce(F.col("check_out_time"), X.ts_lit(as_of))),
                                now_s).alias("b"))
                .filter(F.col("b") > F.col("a"))
                .join(parking_slot.select("slot_id", "area_id"), "slot_id"))
    if by == "floor_id":
        floors = parking_area.select("area_id", "floor_id")
        sessions = sessions.join(floors, "area_id", "left")
    elif by == "vehicle_type_id":
        sessions = sessions.join(vehicle.select("vehicle_id", "vehicle_type_id"), "vehicle_id")
    elif by != "area_id":
        raise ValueError(f"by must be one of {PROFILE_GROUPS}")
    sessions = cut_lineage(sessions.select(F.col(by).alias("grp"), "a", "b"))  # read three times
    seconds = [(_band_seconds(F.col("b"), F.lit(h)) - _band_seconds(F.col("a"), F.lit(h))) for h in range(24)]
    overlap = (sessions.groupBy("grp").agg(*[F.sum(x).alias(f"_{h}") for h, x in enumerate(seconds)])
               .select("grp", F.expr(f"stack(24, {', '.join(f'{h}, _{h}' for h in range(24))}) AS (band, occupied_s)")))
    p0 = sessions.agg(F.floor(F.min("a") / 86400) * 86400).scalar()  # period start, computed once
    avg = overlap.withColumn("den", _band_seconds(now_s, F.col("band")) - _band_seconds(p0, F.col("band")))
    avg = avg.select("grp", "band", ratio_half_up(F.col("occupied_s"), F.col("den"), 4).alias("avg_occupancy"))

    deltas = (sessions.select("grp", F.inline(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")),
                                                          F.struct(F.col("b").alias("t"), F.lit(-1).alias("d")))))
              .groupBy("grp", "t").agg(F.sum("d").alias("d")))
    segs = ordered_scan(deltas, ["grp"], ["t"], F.floor(F.col("t") / 86400), runs=[("level", "sum", "d", True)],
                        next_cols=["t"], next_prefix="next_")
    segs = segs.withColumn("e", F.coalesce(F.col("next_t"), now_s)).filter(F.col("e") > F.col("t"))
    n = F.when(F.col("e") - F.col("t") >= 86400, F.lit(24)).otherwise(
        F.floor((F.col("e") - 1) / 3600) - F.floor(F.col("t") / 3600) + 1)
    covered = segs.select("grp", "level", F.explode(
        F.transform(F.sequence(F.lit(0), (F.least(n, F.lit(24)) - 1).cast("int")),
                    lambda k: F.pmod(F.floor(F.col("t") / 3600) + k, F.lit(24)).cast("int"))).alias("band"))
    peak = covered.groupBy("grp", "band").agg(F.max("level").alias("peak"))
    return (avg.join(peak, ["grp", "band"], "left")
            .select(F.col("grp").alias(by), F.col("band").cast("int"), "avg_occupancy",
                    F.coalesce("peak", F.lit(0)).cast("bigint").alias("peak")))


def peak_forecast(ticket: DataFrame, k: int = 5) -> DataFrame:
    """Expected entries per ISO day of week x hour = entries observed in
    that cell / number of such weekdays in the observed date span; the top
    ``k`` cells (ties by dow, hour).  All inputs to the ranking are the 168-cell
    table, so the final top-k is a bounded TakeOrderedAndProject."""
    e = ticket.select(F.col("entry_time").alias("ts"))
    cells = e.groupBy((F.weekday("ts") + 1).alias("dow"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("entries"))
    span = e.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    bounds = span.select(F.struct((F.datediff("hi", "lo") + 1).alias("n"), (F.weekday("lo") + 1).alias("d"))).scalar()
    ndays, dow_lo = bounds["n"], bounds["d"]
    j = cells
    days = (F.floor(ndays / 7)
            + F.when(F.pmod(F.col("dow") - dow_lo, F.lit(7)) < F.pmod(ndays, F.lit(7)), 1)
            .otherwise(0)).cast("bigint")
    expected = ratio_half_up(F.col("entries"), F.col("days"), 4)
    out = j.withColumn("days", days).select("dow", "hour", F.col("entries").cast("bigint"), "days",
                                            expected.alias("expected"))
    return out.orderBy(F.col("expected").desc(), "dow", "hour").limit(k)


def slot_utilization(parking_slot: DataFrame, ticket: DataFrame, payment: DataFrame, slot_event: DataFrame,
                     events_as_of: str | dt.datetime) -> DataFrame:
    """Per slot: sessions, average whole minutes of closed sessions
    (2 decimals), net paid revenue and minutes spent in Maintenance (W3).
    Each side is aggregated per slot before the joins."""
    mins = X.minutes_between("entry_time", "check_out_time")
    sess = ticket.filter(F.col("slot_id").isNotNull()).groupBy("slot_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(mins).alias("_m"), F.count(mins).alias("_c"))
    paid = (payment.filter(F.col("status") == "paid").groupBy("ticket_id").agg(F.sum("final_amount").alias("amt"))
            .join(ticket.select("ticket_id", "slot_id"), "ticket_id")
            .groupBy("slot_id").agg(F.sum("amt").alias("net_revenue")))
    maint = (status_intervals(slot_event, events_as_of).filter(F.col("status") == "Maintenance")
             .select("slot_id", F.col("minutes").alias("maintenance_minutes")))
    j = (parking_slot.select("slot_id").join(sess, "slot_id", "left").join(paid, "slot_id", "left")
         .join(maint, "slot_id", "left"))
    avg = ratio_half_up(F.col("_m"), F.col("_c"), 2)
    return j.select("slot_id", F.coalesce("sessions", F.lit(0)).cast("bigint").alias("sessions"),
                    avg.alias("avg_minutes"),
                    F.coalesce(F.col("net_revenue"), F.lit(0)).cast("double").alias("net_revenue"),
                    F.coalesce("maintenance_minutes", F.lit(0)).cast("bigint").alias("maintenance_minutes"))
