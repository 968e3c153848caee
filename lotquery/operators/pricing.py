"""Fee core: J4 ``match_pricing_rule`` and F6 ``parking_fee``.

Rules are joined by an equi key (vehicle type, day type, month of entry): a
rule stands once in each month of its dates, within the months that have
entries.  Exact date and time tests follow, and the rule of highest priority is
taken by an aggregate per ticket, so no list of rules is ever gathered.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.functions import exprs as X

def with_day_type(df: DataFrame, ts_col: str, holidays: DataFrame) -> DataFrame:
    """F9 on ``ts_col``: Holiday (listed date) > Weekend (Sat, Sun) > Weekday."""
    days = holidays.select(F.col("holiday").alias("_lq_day")).distinct()
    flagged = (df.withColumn("_lq_date", F.to_date(ts_col))
               .join(days, F.col("_lq_date") == F.col("_lq_day"), "left"))
    return (flagged.withColumn("day_type", X.day_type(ts_col, F.col("_lq_day").isNotNull()))
            .drop("_lq_day"))


def match_pricing_rule(ticket: DataFrame, vehicle: DataFrame, pricing_rules: DataFrame,
                       holidays: DataFrame, carry: tuple[str, ...] = (), vehicle_carry: tuple[str, ...] = (),
                       how: str = "inner") -> DataFrame:
    """Exactly one rule per session or none (``needs_review``).

    Candidates: same vehicle type, active, entry date within
    [effective_from, effective_to], entry second-of-day in [start_sec, end_sec),
    same day type.  Several -> latest effective_from, then highest rule_id.
    ``carry`` / ``vehicle_carry`` pass further ticket / vehicle columns through,
    so callers need no second ticket-vehicle join; ``how='left'`` keeps tickets
    whose vehicle is missing (they get no rule)."""
    tv = (ticket.select("ticket_id", "vehicle_id", "entry_time", "check_out_time", "status", *carry)
          .join(vehicle.select("vehicle_id", "vehicle_type_id", *vehicle_carry), "vehicle_id", how))
    tv = with_day_type(tv, "entry_time", holidays)
    tv = tv.withColumn("_lq_month", F.trunc("_lq_date", "month"))
    span = ticket.agg(F.min("entry_time").alias("lo"), F.max("entry_time").alias("hi")).select(
        F.struct(F.trunc(F.to_date("lo"), "month").alias("lo"), F.to_date("hi").alias("hi"))).scalar()
    first, last = F.greatest(F.trunc("effective_from", "month"), span["lo"]), F.least("effective_to", span["hi"])
    rules = (pricing_rules.filter(F.col("is_active") & (first <= last))
             .withColumn("_lq_month", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))))
             .select("vehicle_type_id", "day_type", "_lq_month", "rule_id", "effective_from", "effective_to",
                     "start_sec", "end_sec", "first_hour_price", "next_hour_price", "max_daily_price"))
    sec = F.hour("entry_time") * 3600 + F.minute("entry_time") * 60 + F.second("entry_time")
    fits = (F.col("_lq_date").between(F.col("effective_from"), F.col("effective_to"))
            & (sec >= F.col("start_sec")) & (sec < F.col("end_sec")))
    prices = ("first_hour_price", "next_hour_price", "max_daily_price")
    own = ("ticket_id", "vehicle_type_id", "day_type", "entry_time", "check_out_time", "status", *carry, *vehicle_carry)
    # A ticket's candidate rows lie in one task after the join: the aggregate is combined before its shuffle.
    chosen = (tv.join(rules, ["vehicle_type_id", "day_type", "_lq_month"], "left")
              .groupBy(*own).agg(F.max_by(F.struct("rule_id", *prices),
                                          F.when(fits, F.struct("effective_from", "rule_id"))).alias("_lq_rule")))
    return chosen.select(*own, *(F.col(f"_lq_rule.{c}").alias(c) for c in ("rule_id", *prices)),
                         F.col("_lq_rule.rule_id").isNull().alias("needs_review"))


def parking_fee(ticket: DataFrame, vehicle: DataFrame, vehicle_type: DataFrame, pricing_rules: DataFrame,
                holidays: DataFrame, as_of: str | dt.datetime, overstay_minutes: int | None = None,
                overstay_fee_per_hour: float = 0.0, carry: tuple[str, ...] = (),
                vehicle_carry: tuple[str, ...] = (), how: str = "inner",
                wrong_zone_fee: float = 0.0, parking_slot: DataFrame | None = None,
                slot_type_map: DataFrame | None = None,
                occupancy_multiplier: DataFrame | None = None) -> DataFrame:
    """

    1. out = check-out time, else ``as_of``; h = max(1, ceil(seconds / 3600)).
    2. with a rule: first 24 h least(max_daily, first + (min(h,24) - 1) * next);
       each further full 24 h least(max_daily, 24 * next); the remaining r hours
       least(max_daily, r * next).
    3. no rule: per 24 h block least(price_per_day, hours * price_per_hour),
       ``needs_review`` = true.
    4. lost: max_daily (or price_per_day) * ceil(h / 24); canceled: 0.
    5. optional surcharges (both default 0): per started hour beyond
       ``overstay_minutes``; ``wrong_zone_fee`` when the slot's type does not
       fit the vehicle type (needs ``parking_slot`` and ``slot_type_map``).
    6. optional ``occupancy_multiplier`` table (``band`` 0-23, ``multiplier``),
       applied by the entry hour (e.g. derived from W5); default 1.
    """
    zone_check = wrong_zone_fee and parking_slot is not None and slot_type_map is not None
    extra = ("slot_id",) if zone_check and "slot_id" not in carry else ()
    m = match_pricing_rule(ticket, vehicle, pricing_rules, holidays, carry + extra, vehicle_carry, how)
    prices = vehicle_type.select("vehicle_type_id", "price_per_hour", "price_per_day")
    m = m.join(prices, "vehicle_type_id", "left")
    out = F.coalesce(F.col("check_out_time"), X.ts_lit(as_of))
    secs = X.seconds_between("entry_time", out)
    h = F.greatest(F.lit(1), F.ceil(secs / 3600)).cast("bigint")
    money = "decimal(18,2)"
    first, nxt, cap = (F.col("first_hour_price"), F.col("next_hour_price"), F.col("max_daily_price"))
    after = F.greatest(h - 24, F.lit(0))
    with_rule = (F.least(cap, first + (F.least(h, F.lit(24)) - 1) * nxt)
                 + F.floor(after / 24).cast("bigint") * F.least(cap, 24 * nxt)
                 + F.least(cap, (after % 24) * nxt))
    pph, ppd = F.col("price_per_hour"), F.col("price_per_day")
    no_rule = F.floor(h / 24).cast("bigint") * F.least(ppd, 24 * pph) + F.least(ppd, (h % 24) * pph)
    base = F.when(F.col("needs_review"), no_rule).otherwise(with_rule)
    lost = F.coalesce(cap, ppd) * F.ceil(h / 24).cast("bigint")
    fee = (F.when(F.col("status") == "canceled", F.lit(0))
           .when(F.col("status") == "lost", lost)
           .otherwise(base)).cast(money)
    if occupancy_multiplier is not None:
        bands = occupancy_multiplier.select(F.col("band").cast("int").alias("_lq_band"),
                                                              F.col("multiplier").cast("decimal(10,4)")
                                                              .alias("_lq_mult"))
        m = m.join(bands, F.hour("entry_time") == F.col("_lq_band"), "left")
        fee = (fee * F.coalesce(F.col("_lq_mult"), F.lit(1).cast("decimal(10,4)"))).cast(money)
    if overstay_minutes is not None and overstay_fee_per_hour:
        over = F.greatest(secs - overstay_minutes * 60, F.lit(0))
        fee = (fee + F.ceil(over / 3600) * F.lit(overstay_fee_per_hour).cast(money)).cast(money)
    if zone_check:
        fits = (parking_slot.select("slot_id", "slot_type")
                .join(slot_type_map.withColumnRenamed("vehicle_type_id", "_lq_fit_vt"),
                      "slot_type", "left").select("slot_id", "_lq_fit_vt"))
        m = m.join(fits, "slot_id", "left")
        wrong = F.col("slot_id").isNotNull() & (F.col("_lq_fit_vt").isNull()
                                                | (F.col("_lq_fit_vt") != F.col("vehicle_type_id")))
        fee = (fee + F.when(wrong & (F.col("status") != "canceled"), F.lit(wrong_zone_fee).cast(money))
               .otherwise(F.lit(0).cast(money))).cast(money)
    return m.select("ticket_id", "status", "entry_time", "check_out_time", h.alias("hours"), "rule_id",
                    fee.alias("fee"), "needs_review", "vehicle_type_id", *carry, *vehicle_carry)
