
import datetime as dt
import json

from pyspark.sql import functions as F

from lotquery.operators import audit, dashboard as dash, reports
from lotquery.sources.tables import seed_tables

AS_OF = dt.datetime(2026, 5, 6, 12, 0, 0)


def test_slot_totals(seeds):
    row = dash.slot_totals(seeds.parking_slot).first().asDict()
    assert row == {"total": 6, "occupied": 3, "available": 3, "assignable": 2}


def test_revenue_and_payments_empty(seeds):
    assert dash.total_revenue(seeds.payment).first()["total_revenue"] == 0.0
    row = dash.payments_on_day(seeds.payment, AS_OF.date()).first().asDict()
    assert row == {"total_amount": 0.0, "transactions": 0, "paid": 0, "unpaid": 0}


def test_ticket_status_counts(seeds):
    got = {r["status"]: r["cnt"] for r in dash.ticket_status_counts(seeds.ticket).collect()}
    assert got == {"completed": 1, "active": 2}


def test_active_tickets_newest_first(seeds):
    rows = dash.active_tickets(seeds.ticket, seeds.vehicle).collect()
    assert [(r["ticket_id"], r["license_plate"]) for r in rows] == [(3, "59P-555.55"), (2, "51G-987.65")]
    assert rows[0]["entry_time"] == (AS_OF - dt.timedelta(hours=1)).strftime("%Y-%m-%d %H:%M:%S")


def test_zone_summary(seeds):
    got = {r["area_code"]: (r["occupied"], r["total"], r["pct"], r["label"])
           for r in reports.zone_summary(seeds.parking_slot, seeds.parking_area).collect()}
    assert got == {"ZONE-A": (1, 3, 33, "Open"), "ZONE-B": (1, 2, 50, "Busy"), "ZONE-C": (1, 1, 100, "Full")}


def test_slot_grid_json(seeds):
    cells = dash.slot_grid(seeds.parking_slot)
    doc = dash.grid_json(cells).first()
    assert doc["grid_json"] == "[[1,0,0,0,0],[1,0,0,0,0],[1,0,0,0,0],[0,0,0,0,0],[0,0,0,0,0]]"


def test_pair_log_events(seeds):
    got = {r["ticket_id"]: (r["minutes"], r["anomaly"]) for r in audit.pair_log_events(seeds.parking_log).collect()}
    assert got == {1: (180, None), 2: (None, "entry_without_exit")}


def test_plates_valid(seeds):
    assert all(r["is_valid"] for r in audit.plate_audit(seeds.vehicle).collect())


def test_no_plate_mismatch(spark, seeds):
    rep = reports.exception_report(seeds, 2880, AS_OF)
    assert rep.filter(F.col("kind") == "plate_mismatch").count() == 0


def test_dashboard_document(seeds):
    rows = dash.dashboard_json(dash.dashboard_document(seeds.ticket, seeds.vehicle, seeds.parking_slot, seeds.payment,
                                                       AS_OF.date())).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.section, []).append(json.loads(r.json))
    assert set(parts) == {"slots", "totalRevenue", "ticketStatus", "currentTickets", "paymentsToday"}
    merged = {k: {n: v for x in parts[k] for n, v in x.items()} for k in ("slots", "ticketStatus", "paymentsToday")}
    assert merged["slots"] == {"total": 6, "occupied": 3, "available": 3}
    assert merged["ticketStatus"] == {"active": 2, "completed": 1}
    assert merged["paymentsToday"] == {"totalAmount": 0.0, "transactions": 0, "paid": 0, "unpaid": 0}
    assert {t["ticket_id"] for t in parts["currentTickets"]} == {2, 3}
    assert all(list(t) == ["ticket_id", "license_plate", "entry_time", "area", "status"] and t["area"] is None
               for t in parts["currentTickets"])


def test_slot_summary(seeds):
    rows = dash.slot_summary(seeds.parking_slot, seeds.parking_area).collect()
    whole = [r for r in rows if r.section == "facility"]
    assert [(r.total, r.occupied, r.available) for r in whole] == [(6, 3, 3)]
    assert sum(r.total for r in rows if r.section == "zone") == 6


def test_seed_fee_sedan_three_hours(spark):
    """Ticket 1: Sedan, 3 h on a weekday inside the band -> 15,000 + 2 x 10,000."""
    from lotquery.operators import pricing
    as_of = dt.datetime(2026, 5, 6, 12, 0, 0)  # a Wednesday
    seeds = seed_tables(spark, as_of)
    fee = pricing.parking_fee(seeds.ticket, seeds.vehicle, seeds.vehicle_type, seeds.pricing_rules,
                              seeds.holidays, as_of).filter("ticket_id = 1").first()
    assert fee["hours"] == 3 and fee["rule_id"] == 1 and float(fee["fee"]) == 35000.0


def test_vehicle_type_list(seeds):
    rows = dash.vehicle_type_list(seeds.vehicle_type).collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "Sedan"), (2, "SUV / Truck"), (3, "Motorbike")]


def test_recent_activity_on_seeds(seeds):
    rows = reports.recent_activity(seeds.parking_log, seeds.ticket, seeds.vehicle, seeds.parking_slot,
                                   seeds.parking_area, AS_OF, 2).collect()
    assert [(r["license_plate"], r["action"], r["model"], r["color"], r["age"]) for r in rows] == [
        ("59A-123.45", "exit", "Toyota Vios", "Silver", "~1h ago"),
        ("51G-987.65", "entry", "Ford Ranger", "Black", "~2h ago")]


def test_capacity_alerts_floor_level(seeds):
    from pyspark.sql import functions as F
    area = seeds.parking_area.withColumn("floor_id", F.lit(1))
    rows = reports.capacity_alerts(seeds.parking_slot, area, seeds.ticket, threshold_pct=50, min_free=3,
                                   level="floor").collect()
    assert {(r["floor_id"], r["total"], r["occupied"], r["assignable"], r["pct"], r["alert"]) for r in rows} == {
        (1, 6, 3, 2, 50, "occupancy"), (1, 6, 3, 2, 50, "low_free")}


def test_fee_surcharges_and_multiplier(spark):
    """F6 steps 5-6 on the seed Sedan ticket (3 h, 35,000): a wrong-zone
    surcharge when its slot is an SUV bay, and an occupancy multiplier by entry
    hour."""
    from pyspark.sql import functions as F
    from lotquery.operators import pricing
    as_of = dt.datetime(2026, 5, 6, 12, 0, 0)
    s = seed_tables(spark, as_of)
    ticket = s.ticket.withColumn("slot_id", F.when(F.col("ticket_id") == 1, F.lit(4)).otherwise(F.col("slot_id")))
    mult = spark.createDataFrame([(8, 1.5)], "band int, multiplier double")
    fee = pricing.parking_fee(ticket, s.vehicle, s.vehicle_type, s.pricing_rules, s.holidays, as_of,
                              wrong_zone_fee=5000.0, parking_slot=s.parking_slot, slot_type_map=s.slot_type_map,
                              occupancy_multiplier=mult).filter("ticket_id = 1").first()
    assert float(fee["fee"]) == 35000.0 * 1.5 + 5000.0
