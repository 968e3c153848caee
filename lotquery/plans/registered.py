"""

Spark side: the operator functions, composed with the DataFrame API.
Oracle side: plain SQL over the same derived views (``pk_*``), written
independently.  Money leaves both as DOUBLE after exact decimal arithmetic,
counts as BIGINT, so values hash identically in both engines.
"""

from __future__ import annotations

from lotquery.session import scratch_path
from lotquery.operators import dashboard as dash
from lotquery.plans.catalog import query
from lotquery.sources.derive import PAY_DAY

# ---------------------------------------------------------------- mark C

@query("active_tickets", """
SELECT t.ticket_id, v.license_plate, strftime(t.entry_time, '%Y-%m-%d %H:%M:%S') AS entry_time, t.status
FROM pk_ticket t JOIN pk_vehicle v ON t.vehicle_id = v.vehicle_id
WHERE t.status = 'active'
ORDER BY t.entry_time DESC, t.ticket_id DESC
""")
def _active_tickets(t):
    """J1 over all tickets."""
    return dash.active_tickets(t.ticket, t.vehicle)


@query("slot_totals", """
SELECT CAST(COUNT(*) AS BIGINT) AS total,
       CAST(COALESCE(SUM(CASE WHEN status = 'Occupied' THEN 1 ELSE 0 END), 0) AS BIGINT) AS occupied,
       CAST(greatest(COUNT(*) - COALESCE(SUM(CASE WHEN status = 'Occupied' THEN 1 ELSE 0 END), 0), 0) AS BIGINT) AS available,
       CAST(COALESCE(SUM(CASE WHEN status = 'Empty' THEN 1 ELSE 0 END), 0) AS BIGINT) AS assignable
FROM pk_parking_slot
""")
def _slot_totals(t):
    return dash.slot_totals(t.parking_slot)


@query("total_revenue", """
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_revenue FROM pk_payment
""")
def _total_revenue(t):
    return dash.total_revenue(t.payment)


@query("ticket_status_counts", """
SELECT status, CAST(COUNT(*) AS BIGINT) AS cnt FROM pk_ticket GROUP BY status
""")
def _ticket_status_counts(t):
    return dash.ticket_status_counts(t.ticket)


@query("payments_on_day", f"""
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount, CAST(COUNT(*) AS BIGINT) AS transactions,
       CAST(COALESCE(SUM(CASE WHEN status = 'paid' THEN 1 ELSE 0 END), 0) AS BIGINT) AS paid,
       CAST(COALESCE(SUM(CASE WHEN status <> 'paid' THEN 1 ELSE 0 END), 0) AS BIGINT) AS unpaid
FROM pk_payment WHERE CAST(payment_time AS DATE) = DATE '{PAY_DAY}'
""")
def _payments_on_day(t):
    return dash.payments_on_day(t.payment, PAY_DAY)


SLOT_GRID_SQL = r"""
WITH decoded AS (
  SELECT slot_id, status, string_split(slot_code, '-') AS parts,
         regexp_replace(string_split(slot_code, '-')[1], '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS first_part
  FROM {slots}),
cells AS (
  SELECT ascii(CASE WHEN first_part = '' THEN 'A' ELSE upper(substr(first_part, 1, 1)) END) - 65 AS "row",
         TRY_CAST(regexp_replace(parts[2], '[^0-9]', '', 'g') AS INTEGER) - 1 AS col,
         slot_id, CASE WHEN lower(status) = 'occupied' THEN 1 ELSE 0 END AS occ
  FROM decoded
  WHERE len(parts) >= 2 AND (parts[2] <> '' OR len(parts) > 2)),
kept AS (
  SELECT "row", col, arg_max(occ, slot_id) AS occ FROM cells
  WHERE col IS NOT NULL AND "row" BETWEEN 0 AND 4 AND col BETWEEN 0 AND 4 GROUP BY "row", col),
dense AS (SELECT CAST(i // 5 AS INTEGER) AS "row", CAST(i % 5 AS INTEGER) AS col FROM range(25) r(i))
SELECT d."row", d.col, CAST(COALESCE(k.occ, 0) AS INTEGER) AS occ
FROM dense d LEFT JOIN kept k ON k."row" = d."row" AND k.col = d.col
"""


@query("slot_grid", SLOT_GRID_SQL.replace("{slots}", "pk_parking_slot"))
def _slot_grid(t):
    return dash.slot_grid(t.parking_slot)


@query("dashboard_document", f"""
WITH p AS (SELECT amount, status, CAST(payment_time AS DATE) = DATE '{PAY_DAY}' AS today FROM pk_payment),
figures AS (
  SELECT 'slots' AS section, 'total' AS name, CAST(COUNT(*) AS DOUBLE) AS number FROM pk_parking_slot
  UNION ALL SELECT 'slots', 'occupied', count_if(status = 'Occupied') FROM pk_parking_slot
  UNION ALL SELECT 'slots', 'available', count_if(status IS DISTINCT FROM 'Occupied') FROM pk_parking_slot
  UNION ALL SELECT 'totalRevenue', 'totalRevenue', COALESCE(SUM(amount), 0) FROM p
  UNION ALL SELECT 'paymentsToday', 'totalAmount', COALESCE(SUM(amount) FILTER (today), 0) FROM p
  UNION ALL SELECT 'paymentsToday', 'transactions', count_if(today) FROM p
  UNION ALL SELECT 'paymentsToday', 'paid', count_if(today AND status = 'paid') FROM p
  UNION ALL SELECT 'paymentsToday', 'unpaid', count_if(today AND status <> 'paid') FROM p
  UNION ALL SELECT 'ticketStatus', status, COUNT(*) FROM pk_ticket GROUP BY status)
SELECT section, name, CAST(NULL AS BIGINT) AS ticket_id, CAST(NULL AS VARCHAR) AS license_plate,
       CAST(NULL AS VARCHAR) AS entry_time, CAST(NULL AS VARCHAR) AS status, CAST(number AS DOUBLE) AS number FROM figures
UNION ALL
SELECT 'currentTickets', NULL, t.ticket_id, v.license_plate, strftime(t.entry_time, '%Y-%m-%d %H:%M:%S'), t.status, NULL
FROM pk_ticket t JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id WHERE t.status = 'active'
""")
def _dashboard_document(t):
    """S4 as rows: every figure, status and active ticket."""
    return dash.dashboard_document(t.ticket, t.vehicle, t.parking_slot, t.payment, PAY_DAY)


@query("slot_summary", """
SELECT 'facility' AS section, CAST(NULL AS VARCHAR) AS area_code, CAST(count_if(status = 'Occupied') AS BIGINT) AS occupied,
       CAST(count_if(status IS DISTINCT FROM 'Occupied') AS BIGINT) AS available, CAST(COUNT(*) AS BIGINT) AS total
FROM pk_parking_slot
UNION ALL
SELECT 'zone', a.area_code, CAST(count_if(s.status = 'Occupied') AS BIGINT),
       CAST(COUNT(s.slot_id) - count_if(s.status = 'Occupied') AS BIGINT), CAST(COUNT(s.slot_id) AS BIGINT)
FROM pk_parking_area a LEFT JOIN pk_parking_slot s ON s.area_id = a.area_id GROUP BY a.area_id, a.area_code
""")
def _slot_summary(t):
    return dash.slot_summary(t.parking_slot, t.parking_area)


@query("grid_json", """
WITH g AS (""" + SLOT_GRID_SQL.replace("{slots}", "pk_parking_slot") + """)
SELECT '[' || string_agg(cells, ',' ORDER BY "row") || ']' AS grid_json
FROM (SELECT "row", '[' || string_agg(CAST(occ AS VARCHAR), ',' ORDER BY col) || ']' AS cells FROM g GROUP BY "row") x
""")
def _grid_json(t):
    """The grid of all slots as JSON text."""
    return dash.grid_json(dash.slot_grid(t.parking_slot)).select("grid_json")


@query("grid_of_cells", """
WITH cells AS (SELECT slot_id, CAST(slot_id % 7 - 1 AS INTEGER) AS "row", CAST(slot_id // 7 % 6 AS INTEGER) AS col, status FROM pk_parking_slot),
kept AS (SELECT "row", col, arg_max(CASE WHEN lower(status) = 'occupied' THEN 1 ELSE 0 END, slot_id) AS occ FROM cells
         WHERE "row" BETWEEN 0 AND 4 AND col BETWEEN 0 AND 4 GROUP BY "row", col),
dense AS (SELECT CAST(i // 5 AS INTEGER) AS "row", CAST(i % 5 AS INTEGER) AS col FROM range(25) r(i))
SELECT d."row", d.col, CAST(COALESCE(k.occ, 0) AS INTEGER) AS occ FROM dense d LEFT JOIN kept k ON k."row" = d."row" AND k.col = d.col
""")
def _grid_of_cells(t):
    """A9 from row and column numbers, some outside the grid."""
    cells = t.parking_slot.selectExpr("slot_id AS cell_id", "CAST(slot_id % 7 - 1 AS INT) AS row",
                                      "CAST(slot_id div 7 % 6 AS INT) AS col", "status")
    return dash.grid_of_cells(cells)


# ---------------------------------------------------------------- audits and integrity

from lotquery.operators import audit  # noqa: E402
from lotquery.sources.derive import AS_OF  # noqa: E402

_JTRIM = r"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query("plate_audit", r"""
SELECT vehicle_id, license_plate,
       COALESCE(upper(""" + _JTRIM.format(c="license_plate") + r""") <> ''
                AND regexp_matches(upper(""" + _JTRIM.format(c="license_plate") + r"""), '^[0-9]{2}[A-Z]-[0-9]{3}\.[0-9]{2}$'),
                false) AS is_valid
FROM pk_vehicle
""")
def _plate_audit(t):
    return audit.plate_audit(t.vehicle)


@query("unsafe_text_audit", r"""
SELECT request_id, full_name AS value,
  CASE WHEN full_name IS NULL THEN 'null'
       WHEN """ + _JTRIM.format(c="full_name") + r""" = '' THEN 'blank'
       WHEN length(""" + _JTRIM.format(c="full_name") + r""") > 100 THEN 'too_long'
       WHEN contains(""" + _JTRIM.format(c="full_name") + r""", '''') OR contains(""" + _JTRIM.format(c="full_name") + r""", '"')
         OR contains(""" + _JTRIM.format(c="full_name") + r""", ';') OR contains(""" + _JTRIM.format(c="full_name") + r""", '--') THEN 'unsafe_char'
  END AS reason
FROM pk_registration_requests
WHERE reason IS NOT NULL
""")
def _unsafe_text_audit(t):
    """P3 on the registration form's name field (limit 100)."""
    return audit.unsafe_text_audit(t.registration_requests, "request_id", "full_name", 100)


@query("staff_eligibility", r"""
WITH s AS (
  SELECT staff_id, name, lower(""" + _JTRIM.format(c="role") + r""") AS folded,
         COALESCE(lower(""" + _JTRIM.format(c="status") + r""") = 'active', false) AS is_active
  FROM pk_staff)
SELECT staff_id, name, CASE WHEN folded IN ('admin', 'manager', 'attendant') THEN folded END AS role, is_active,
       CASE WHEN NOT is_active OR folded NOT IN ('admin', 'manager', 'attendant') OR folded IS NULL THEN 'denied'
            WHEN folded = 'admin' THEN 'full' ELSE 'staff' END AS access
FROM s
""")
def _staff_eligibility(t):
    return audit.staff_eligibility(t.staff)


@query("domain_audit", """
SELECT 'staff' AS table_name, 'name' AS column_name, CAST(count_if(NOT COALESCE(name IS NOT NULL AND length(name) <= 100, false)) AS BIGINT) AS bad_rows FROM pk_staff
UNION ALL SELECT 'staff', 'role', CAST(count_if(NOT COALESCE(role IN ('admin', 'manager', 'attendant'), false)) AS BIGINT) FROM pk_staff
UNION ALL SELECT 'staff', 'status', CAST(count_if(NOT COALESCE(status IN ('active', 'inactive'), false)) AS BIGINT) FROM pk_staff
UNION ALL SELECT 'vehicle', 'license_plate', CAST(count_if(NOT COALESCE(license_plate IS NOT NULL AND length(license_plate) <= 20, false)) AS BIGINT) FROM pk_vehicle
UNION ALL SELECT 'parking_slot', 'slot_code', CAST(count_if(NOT COALESCE(slot_code IS NOT NULL AND length(slot_code) <= 10, false)) AS BIGINT) FROM pk_parking_slot
UNION ALL SELECT 'parking_slot', 'status', CAST(count_if(NOT COALESCE(status IN ('Empty', 'Reserved', 'Occupied', 'Maintenance', 'Locked'), false)) AS BIGINT) FROM pk_parking_slot
UNION ALL SELECT 'pricing_rules', 'day_type', CAST(count_if(NOT COALESCE(day_type IN ('Weekday', 'Weekend', 'Holiday'), false)) AS BIGINT) FROM pk_pricing_rules
UNION ALL SELECT 'ticket', 'status', CAST(count_if(NOT COALESCE(status IN ('active', 'completed', 'lost', 'canceled'), false)) AS BIGINT) FROM pk_ticket
UNION ALL SELECT 'ticket', 'qr_code', CAST(count_if(NOT COALESCE(qr_code IS NOT NULL AND length(qr_code) <= 255, false)) AS BIGINT) FROM pk_ticket
UNION ALL SELECT 'parking_log', 'action', CAST(count_if(NOT COALESCE(action IN ('entry', 'exit'), false)) AS BIGINT) FROM pk_parking_log
UNION ALL SELECT 'payment', 'status', CAST(count_if(NOT COALESCE(status IN ('paid', 'unpaid', 'refunded'), false)) AS BIGINT) FROM pk_payment
""")
def _domain_audit(t):
    return audit.domain_audit(t)


SEARCH_TERM = "A-00"
#: A term of three letters or more, and the folders of its index at fixture scale.
SEARCH_PLATE, SEARCH_INDEX_BUCKETS = "a-0", 16


@query("search", f"""
SELECT 'vehicle' AS kind, vehicle_id AS id, license_plate AS label FROM pk_vehicle WHERE contains(lower(license_plate), lower('{SEARCH_TERM}'))
UNION ALL
SELECT 'slot', slot_id, slot_code FROM pk_parking_slot WHERE contains(lower(slot_code), lower('{SEARCH_TERM}'))
""")
def _search(t):
    return audit.search(t.vehicle, t.parking_slot, SEARCH_TERM)


@query("search_indexed", f"""
SELECT 'vehicle' AS kind, vehicle_id AS id, license_plate AS label FROM pk_vehicle WHERE contains(lower(license_plate), lower('{SEARCH_PLATE}'))
UNION ALL
SELECT 'slot', slot_id, slot_code FROM pk_parking_slot WHERE contains(lower(slot_code), lower('{SEARCH_PLATE}'))
""", raw=True)
def _search_indexed(spark, sf_dir, t):
    """P6 by the trigram index, built from the tables."""
    path = scratch_path(spark, "search-index")
    audit.build_search_index(t.vehicle, t.parking_slot, path, SEARCH_INDEX_BUCKETS)
    return audit.search_indexed(spark, path, SEARCH_PLATE, SEARCH_INDEX_BUCKETS)


RETENTION_DAYS = 1825


@query("retention_filter", f"""
SELECT log_id, ticket_id, action, action_time FROM pk_parking_log
WHERE action_time < TIMESTAMP '{AS_OF}' - INTERVAL {RETENTION_DAYS} DAY
""")
def _retention_filter(t):
    """The expired part of the parking log (what a purge would remove)."""
    _, expired = audit.retention_filter(t.parking_log, "action_time", RETENTION_DAYS, AS_OF)
    return expired.select("log_id", "ticket_id", "action", "action_time")


@query("retention_kept", f"""
SELECT log_id, ticket_id, action, action_time FROM pk_parking_log
WHERE action_time IS NULL OR action_time >= TIMESTAMP '{AS_OF}' - INTERVAL {RETENTION_DAYS} DAY
""")
def _retention_kept(t):
    """The part of the parking log that a purge leaves."""
    kept, _ = audit.retention_filter(t.parking_log, "action_time", RETENTION_DAYS, AS_OF)
    return kept.select("log_id", "ticket_id", "action", "action_time")


@query("orphan_audit", """
WITH fks(fk) AS (VALUES ('vehicle.customer_id'), ('vehicle.vehicle_type_id'), ('parking_slot.area_id'),
  ('pricing_rules.vehicle_type_id'), ('ticket.vehicle_id'), ('ticket.slot_id'), ('ticket.check_in_by'),
  ('ticket.check_out_by'), ('parking_log.ticket_id'), ('parking_log.staff_id'), ('payment.ticket_id'),
  ('payment.payment_method_id')),
o AS (
  SELECT 'vehicle.customer_id' AS fk, COUNT(*) AS n FROM pk_vehicle c WHERE NOT EXISTS (SELECT 1 FROM pk_customer p WHERE p.customer_id = c.customer_id)
  UNION ALL SELECT 'vehicle.vehicle_type_id', COUNT(*) FROM pk_vehicle c WHERE NOT EXISTS (SELECT 1 FROM pk_vehicle_type p WHERE p.vehicle_type_id = c.vehicle_type_id)
  UNION ALL SELECT 'parking_slot.area_id', COUNT(*) FROM pk_parking_slot c WHERE NOT EXISTS (SELECT 1 FROM pk_parking_area p WHERE p.area_id = c.area_id)
  UNION ALL SELECT 'pricing_rules.vehicle_type_id', COUNT(*) FROM pk_pricing_rules c WHERE NOT EXISTS (SELECT 1 FROM pk_vehicle_type p WHERE p.vehicle_type_id = c.vehicle_type_id)
  UNION ALL SELECT 'ticket.vehicle_id', COUNT(*) FROM pk_ticket c WHERE NOT EXISTS (SELECT 1 FROM pk_vehicle p WHERE p.vehicle_id = c.vehicle_id)
  UNION ALL SELECT 'ticket.slot_id', COUNT(*) FROM pk_ticket c WHERE c.slot_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pk_parking_slot p WHERE p.slot_id = c.slot_id)
  UNION ALL SELECT 'ticket.check_in_by', COUNT(*) FROM pk_ticket c WHERE c.check_in_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pk_staff p WHERE p.staff_id = c.check_in_by)
  UNION ALL SELECT 'ticket.check_out_by', COUNT(*) FROM pk_ticket c WHERE c.check_out_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pk_staff p WHERE p.staff_id = c.check_out_by)
  UNION ALL SELECT 'parking_log.ticket_id', COUNT(*) FROM pk_parking_log c WHERE NOT EXISTS (SELECT 1 FROM pk_ticket p WHERE p.ticket_id = c.ticket_id)
  UNION ALL SELECT 'parking_log.staff_id', COUNT(*) FROM pk_parking_log c WHERE c.staff_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pk_staff p WHERE p.staff_id = c.staff_id)
  UNION ALL SELECT 'payment.ticket_id', COUNT(*) FROM pk_payment c WHERE NOT EXISTS (SELECT 1 FROM pk_ticket p WHERE p.ticket_id = c.ticket_id)
  UNION ALL SELECT 'payment.payment_method_id', COUNT(*) FROM pk_payment c WHERE NOT EXISTS (SELECT 1 FROM pk_payment_method p WHERE p.payment_method_id = c.payment_method_id))
SELECT fks.fk, CAST(COALESCE(o.n, 0) AS BIGINT) AS orphan_rows FROM fks LEFT JOIN o ON o.fk = fks.fk
""")
def _orphan_audit(t):
    return audit.orphan_audit(t)


@query("unique_audit", """
SELECT 'staff.name' AS rule, CAST(name AS VARCHAR) AS key, CAST(COUNT(*) AS BIGINT) AS n FROM pk_staff GROUP BY name HAVING COUNT(*) > 1
UNION ALL SELECT 'vehicle.license_plate', license_plate, CAST(COUNT(*) AS BIGINT) FROM pk_vehicle GROUP BY license_plate HAVING COUNT(*) > 1
UNION ALL SELECT 'ticket.qr_code', qr_code, CAST(COUNT(*) AS BIGINT) FROM pk_ticket GROUP BY qr_code HAVING COUNT(*) > 1
""")
def _unique_audit(t):
    return audit.unique_audit(t)


@query("pair_log_events", """
WITH p AS (
  SELECT ticket_id, min(CASE WHEN action = 'entry' THEN action_time END) AS entry_time,
         max(CASE WHEN action = 'exit' THEN action_time END) AS exit_time,
         count_if(action = 'entry') AS entries, count_if(action = 'exit') AS exits
  FROM pk_parking_log GROUP BY ticket_id)
SELECT ticket_id, entry_time, exit_time,
       CAST(floor(date_diff('second', entry_time, exit_time) / 60) AS BIGINT) AS minutes,
       CASE WHEN exits > 0 AND entries = 0 THEN 'exit_without_entry'
            WHEN entries > 0 AND exits = 0 THEN 'entry_without_exit'
            WHEN exit_time < entry_time THEN 'exit_before_entry' END AS anomaly
FROM p
""")
def _pair_log_events(t):
    return audit.pair_log_events(t.parking_log)


@query("duplicate_active_sessions", """
WITH a AS (
  SELECT t.ticket_id, regexp_replace(upper(v.license_plate), '[^0-9A-Z]', '', 'g') AS plate
  FROM pk_ticket t JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id WHERE t.status = 'active'),
d AS (SELECT plate, COUNT(*) AS n FROM a GROUP BY plate HAVING COUNT(*) > 1)
SELECT a.plate, a.ticket_id, CAST(d.n AS BIGINT) AS n FROM a JOIN d ON d.plate = a.plate
""")
def _duplicate_active_sessions(t):
    return audit.duplicate_active_sessions(t.ticket, t.vehicle)


@query("ticket_scan_check", """
WITH c AS (SELECT qr_code, max(ticket_id) AS ticket_id, arg_max(status, ticket_id) AS ticket_status FROM pk_ticket GROUP BY qr_code)
SELECT s.scan_id, s.qr_code, c.ticket_id,
       CASE c.ticket_status WHEN 'active' THEN 'ok' WHEN 'completed' THEN 'used' WHEN 'lost' THEN 'lost'
            WHEN 'canceled' THEN 'canceled' ELSE 'unknown' END AS verdict
FROM pk_scans s LEFT JOIN c ON c.qr_code = s.qr_code
""")
def _ticket_scan_check(t):
    return audit.ticket_scan_check(t.scans, t.ticket)


@query("slot_reconciliation", """
WITH live AS (SELECT slot_id, COUNT(*) AS n FROM pk_ticket WHERE status = 'active' AND slot_id IS NOT NULL GROUP BY slot_id),
j AS (SELECT COALESCE(s.slot_id, l.slot_id) AS slot_id, s.status, CAST(COALESCE(l.n, 0) AS BIGINT) AS active_sessions
      FROM pk_parking_slot s FULL OUTER JOIN live l ON l.slot_id = s.slot_id),
k AS (SELECT *, CASE WHEN status IS NULL THEN 'unknown_slot'
                     WHEN status = 'Occupied' AND active_sessions = 0 THEN 'occupied_without_session'
                     WHEN status <> 'Occupied' AND active_sessions > 0 THEN 'session_on_free_slot' END AS issue FROM j)
SELECT slot_id, status, active_sessions, issue FROM k WHERE issue IS NOT NULL
""")
def _slot_reconciliation(t):
    return audit.slot_reconciliation(t.parking_slot, t.ticket)


# ---------------------------------------------------------------- fee core

from lotquery.operators import pricing  # noqa: E402

# Oracle building blocks shared by the fee-based oracles (DuckDB dialect).
ORACLE_MATCHED = """
tv AS (
  SELECT t.ticket_id, t.status, t.entry_time, t.check_out_time, t.slot_id, t.check_out_by, v.vehicle_type_id,
         CAST(t.entry_time AS DATE) AS d,
         hour(t.entry_time) * 3600 + minute(t.entry_time) * 60 + second(t.entry_time) AS sec,
         CASE WHEN h.holiday IS NOT NULL THEN 'Holiday' WHEN isodow(t.entry_time) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type
  FROM pk_ticket t JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id
  LEFT JOIN (SELECT DISTINCT holiday FROM pk_holidays) h ON h.holiday = CAST(t.entry_time AS DATE)),
matched AS (
  SELECT tv.*, r.rule_id, r.first_hour_price, r.next_hour_price, r.max_daily_price
  FROM tv LEFT JOIN pk_pricing_rules r
    ON r.vehicle_type_id = tv.vehicle_type_id AND r.day_type = tv.day_type AND r.is_active
   AND tv.d BETWEEN r.effective_from AND r.effective_to AND tv.sec >= r.start_sec AND tv.sec < r.end_sec
  QUALIFY row_number() OVER (PARTITION BY tv.ticket_id ORDER BY r.effective_from DESC NULLS LAST, r.rule_id DESC NULLS LAST) = 1)
"""

ORACLE_FEE = ORACLE_MATCHED + f""",
hrs AS (
  SELECT m.*, greatest(1, CAST(ceil(date_diff('second', m.entry_time, COALESCE(m.check_out_time, TIMESTAMP '{AS_OF}')) / 3600.0) AS BIGINT)) AS hours,
         vt.price_per_hour, vt.price_per_day
  FROM matched m LEFT JOIN pk_vehicle_type vt ON vt.vehicle_type_id = m.vehicle_type_id),
fees AS (
  SELECT ticket_id, status, entry_time, check_out_time, slot_id, check_out_by, vehicle_type_id, hours, rule_id,
         rule_id IS NULL AS needs_review,
         CAST(CASE WHEN status = 'canceled' THEN 0
              WHEN status = 'lost' THEN COALESCE(max_daily_price, price_per_day) * CAST(ceil(hours / 24.0) AS BIGINT)
              WHEN rule_id IS NULL THEN (hours // 24) * least(price_per_day, 24 * price_per_hour)
                                        + least(price_per_day, (hours % 24) * price_per_hour)
              ELSE least(max_daily_price, first_hour_price + (least(hours, 24) - 1) * next_hour_price)
                   + (greatest(hours - 24, 0) // 24) * least(max_daily_price, 24 * next_hour_price)
                   + least(max_daily_price, (greatest(hours - 24, 0) % 24) * next_hour_price) END AS DECIMAL(18,2)) AS fee
  FROM hrs)
"""


@query("match_pricing_rule", "WITH " + ORACLE_MATCHED + """
SELECT ticket_id, vehicle_type_id, day_type, rule_id, CAST(first_hour_price AS DOUBLE) AS first_hour_price,
       CAST(next_hour_price AS DOUBLE) AS next_hour_price, CAST(max_daily_price AS DOUBLE) AS max_daily_price,
       rule_id IS NULL AS needs_review
FROM matched
""")
def _match_pricing_rule(t):
    m = pricing.match_pricing_rule(t.ticket, t.vehicle, t.pricing_rules, t.holidays)
    return m.select("ticket_id", "vehicle_type_id", "day_type", "rule_id",
                    *[m[c].cast("double").alias(c) for c in ("first_hour_price", "next_hour_price", "max_daily_price")],
                    "needs_review")


@query("parking_fee", "WITH " + ORACLE_FEE + """
SELECT ticket_id, status, hours, rule_id, CAST(fee AS DOUBLE) AS fee, needs_review FROM fees
""")
def _parking_fee(t):
    f = pricing.parking_fee(t.ticket, t.vehicle, t.vehicle_type, t.pricing_rules, t.holidays, AS_OF)
    return f.select("ticket_id", "status", "hours", "rule_id", f.fee.cast("double").alias("fee"), "needs_review")


# ---------------------------------------------------------------- reports

from lotquery.operators import reports  # noqa: E402

_PCT = "CAST(CASE WHEN {w} > 0 THEN (200 * {p} + {w}) // (2 * {w}) ELSE 0 END AS INTEGER)"


@query("zone_summary", """
WITH per AS (SELECT area_id, COUNT(*) AS total, count_if(status = 'Occupied') AS occupied FROM pk_parking_slot GROUP BY area_id),
z AS (SELECT a.area_id, a.area_code, CAST(COALESCE(per.total, 0) AS BIGINT) AS total, CAST(COALESCE(per.occupied, 0) AS BIGINT) AS occupied
      FROM pk_parking_area a LEFT JOIN per ON per.area_id = a.area_id)
SELECT area_id, area_code, total, occupied, """ + _PCT.format(p="occupied", w="total") + """ AS pct,
       CASE WHEN """ + _PCT.format(p="occupied", w="total") + """ >= 80 THEN 'Full'
            WHEN """ + _PCT.format(p="occupied", w="total") + """ >= 40 THEN 'Busy' ELSE 'Open' END AS label
FROM z
""")
def _zone_summary(t):
    return reports.zone_summary(t.parking_slot, t.parking_area)


@query("floor_occupancy", """
WITH s AS (SELECT a.floor_id, s.status FROM pk_parking_slot s LEFT JOIN pk_parking_area a ON a.area_id = s.area_id),
r AS (SELECT floor_id, GROUPING(floor_id) = 1 AS is_total, CAST(count_if(status = 'Occupied') AS BIGINT) AS occupied,
             CAST(COUNT(*) AS BIGINT) AS total FROM s GROUP BY ROLLUP (floor_id))
SELECT floor_id, is_total, occupied, total, """ + _PCT.format(p="occupied", w="total") + """ AS pct FROM r
""")
def _floor_occupancy(t):
    return reports.floor_occupancy(t.parking_slot, t.parking_area)


@query("vehicle_type_share", """
WITH per AS (SELECT v.vehicle_type_id, COUNT(*) AS n FROM pk_ticket t JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id
             WHERE t.status = 'active' GROUP BY v.vehicle_type_id),
z AS (SELECT vt.vehicle_type_id, vt.type_name, CAST(COALESCE(per.n, 0) AS BIGINT) AS active_sessions
      FROM pk_vehicle_type vt LEFT JOIN per ON per.vehicle_type_id = vt.vehicle_type_id),
tot AS (SELECT SUM(active_sessions) AS total FROM z)
SELECT vehicle_type_id, type_name, active_sessions,
       CASE WHEN total > 0 THEN ((2 * active_sessions * 100 * 100 + total) // (2 * total)) / 100.0 ELSE 0.0 END AS share_pct
FROM z, tot
""")
def _vehicle_type_share(t):
    return reports.vehicle_type_share(t.ticket, t.vehicle, t.vehicle_type)


@query("slot_status_breakdown", """
SELECT a.area_id, a.area_code,
  CAST(count_if(s.status = 'Empty') AS BIGINT) AS empty, CAST(count_if(s.status = 'Occupied') AS BIGINT) AS occupied,
  CAST(count_if(s.status = 'Reserved') AS BIGINT) AS reserved, CAST(count_if(s.status = 'Maintenance') AS BIGINT) AS maintenance,
  CAST(count_if(s.status = 'Locked') AS BIGINT) AS locked
FROM pk_parking_area a LEFT JOIN pk_parking_slot s ON s.area_id = a.area_id
GROUP BY a.area_id, a.area_code
""")
def _slot_status_breakdown(t):
    return reports.slot_status_breakdown(t.parking_slot, t.parking_area)


@query("revenue_report", """
WITH p AS (
  SELECT date_trunc('month', p.payment_time) AS period, vt.type_name, t.gate_id, p.final_amount
  FROM pk_payment p JOIN pk_ticket t ON t.ticket_id = p.ticket_id JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id
  LEFT JOIN pk_vehicle_type vt ON vt.vehicle_type_id = v.vehicle_type_id
  WHERE p.status = 'paid')
SELECT period, type_name, gate_id, CAST(SUM(final_amount) AS DOUBLE) AS net_revenue, CAST(COUNT(*) AS BIGINT) AS payments,
       CAST(GROUPING(period, type_name, gate_id) AS INTEGER) AS level
FROM p GROUP BY ROLLUP (period, type_name, gate_id)
""")
def _revenue_report(t):
    """A10 by month, vehicle type and gate, with subtotals."""
    return reports.revenue_report(t.payment, t.ticket, t.vehicle, t.vehicle_type, "month", ("type_name", "gate_id"))


def _revenue_sql(grain: str, dims: dict[str, str]) -> str:
    names = ", ".join(dims)
    return f"""
WITH p AS (
  SELECT date_trunc('{grain}', p.payment_time) AS period, {", ".join(f"{e} AS {n}" for n, e in dims.items())}, p.final_amount
  FROM pk_payment p JOIN pk_ticket t ON t.ticket_id = p.ticket_id WHERE p.status = 'paid')
SELECT period, {names}, CAST(SUM(final_amount) AS DOUBLE) AS net_revenue, CAST(COUNT(*) AS BIGINT) AS payments,
       CAST(GROUPING(period, {names}) AS INTEGER) AS level
FROM p GROUP BY ROLLUP (period, {names})
"""


_SHIFT = """CASE WHEN hour(t.check_out_time) >= 6 AND hour(t.check_out_time) < 14 THEN 'morning'
              WHEN hour(t.check_out_time) >= 14 AND hour(t.check_out_time) < 22 THEN 'evening' ELSE 'night' END"""


@query("revenue_by_day_and_shift", _revenue_sql("day", {"shift": _SHIFT}))
def _revenue_by_day_and_shift(t):
    return reports.revenue_report(t.payment, t.ticket, t.vehicle, t.vehicle_type, "day", ("shift",))


@query("revenue_by_week_and_staff", _revenue_sql("week", {"staff_id": "t.check_out_by"}))
def _revenue_by_week_and_staff(t):
    return reports.revenue_report(t.payment, t.ticket, t.vehicle, t.vehicle_type, "week", ("staff_id",))


@query("shift_reconciliation", "WITH " + ORACLE_FEE + """,
pt AS (SELECT ticket_id, SUM(CASE WHEN status = 'paid' THEN final_amount END) AS paid,
              SUM(CASE WHEN status = 'refunded' THEN final_amount END) AS refunded,
              SUM(CASE WHEN status = 'unpaid' THEN final_amount END) AS unpaid
       FROM pk_payment GROUP BY ticket_id),
g AS (
  SELECT f.check_out_by AS staff_id, date_trunc('day', f.check_out_time - INTERVAL 6 HOUR) AS shift_day,
         CASE WHEN hour(f.check_out_time) >= 6 AND hour(f.check_out_time) < 14 THEN 'morning'
              WHEN hour(f.check_out_time) >= 14 AND hour(f.check_out_time) < 22 THEN 'evening' ELSE 'night' END AS shift,
         COUNT(*) AS sessions, SUM(f.fee) AS fee_due, COALESCE(SUM(pt.paid), 0) AS paid,
         COALESCE(SUM(pt.refunded), 0) AS refunded, COALESCE(SUM(pt.unpaid), 0) AS unpaid
  FROM fees f LEFT JOIN pt ON pt.ticket_id = f.ticket_id
  WHERE f.check_out_time IS NOT NULL
  GROUP BY ALL)
SELECT staff_id, shift_day, shift, CAST(sessions AS BIGINT) AS sessions, CAST(fee_due AS DOUBLE) AS fee_due,
       CAST(paid AS DOUBLE) AS paid, CAST(refunded AS DOUBLE) AS refunded, CAST(unpaid AS DOUBLE) AS unpaid,
       CAST(fee_due - paid AS DOUBLE) AS difference, fee_due - paid <> 0 AS flagged
FROM g
""")
def _shift_reconciliation(t):
    fees = pricing.parking_fee(t.ticket, t.vehicle, t.vehicle_type, t.pricing_rules, t.holidays, AS_OF,
                               carry=("check_out_by",))
    return reports.shift_reconciliation(fees, t.payment)


@query("peak_hours", """
WITH e AS (SELECT entry_time AS ts, 1 AS is_entry FROM pk_ticket
           UNION ALL SELECT check_out_time, 0 FROM pk_ticket WHERE check_out_time IS NOT NULL),
c AS (SELECT isodow(ts) AS dow, hour(ts) AS hour, count_if(is_entry = 1) AS entries, count_if(is_entry = 0) AS exits FROM e GROUP BY ALL),
cells AS (SELECT CAST(i // 24 + 1 AS INTEGER) AS dow, CAST(i % 24 AS INTEGER) AS hour FROM range(168) r(i))
SELECT cells.dow, cells.hour, CAST(COALESCE(c.entries, 0) AS BIGINT) AS entries, CAST(COALESCE(c.exits, 0) AS BIGINT) AS exits
FROM cells LEFT JOIN c ON c.dow = cells.dow AND c.hour = cells.hour
""")
def _peak_hours(t):
    return reports.peak_hours(t.ticket)


CAPACITY_THRESHOLD, CAPACITY_MIN_FREE = 76, 30
FLOOR_THRESHOLD, FLOOR_MIN_FREE = 40, 160


@query("capacity_alerts", f"""
WITH z AS (SELECT area_id, COUNT(*) AS total, count_if(status = 'Occupied') AS occupied, count_if(status = 'Empty') AS assignable
           FROM pk_parking_slot GROUP BY area_id),
live AS (SELECT s.area_id, COUNT(*) AS active_sessions FROM pk_ticket t JOIN pk_parking_slot s ON s.slot_id = t.slot_id
         WHERE t.status = 'active' GROUP BY s.area_id),
j AS (SELECT a.area_id, a.area_code, CAST(COALESCE(z.total, 0) AS BIGINT) AS total, CAST(COALESCE(z.occupied, 0) AS BIGINT) AS occupied,
             CAST(COALESCE(z.assignable, 0) AS BIGINT) AS assignable, CAST(COALESCE(live.active_sessions, 0) AS BIGINT) AS active_sessions
      FROM pk_parking_area a LEFT JOIN z ON z.area_id = a.area_id LEFT JOIN live ON live.area_id = a.area_id),
k AS (SELECT *, {_PCT.format(p="occupied", w="total")} AS pct FROM j)
SELECT area_id, area_code, total, occupied, assignable, active_sessions, pct, 'occupancy' AS alert FROM k WHERE total > 0 AND pct >= {CAPACITY_THRESHOLD}
UNION ALL SELECT area_id, area_code, total, occupied, assignable, active_sessions, pct, 'low_free' FROM k WHERE assignable < {CAPACITY_MIN_FREE}
UNION ALL SELECT area_id, area_code, total, occupied, assignable, active_sessions, pct, 'over_capacity' FROM k WHERE active_sessions > total
""")
def _capacity_alerts(t):
    return reports.capacity_alerts(t.parking_slot, t.parking_area, t.ticket, CAPACITY_THRESHOLD, CAPACITY_MIN_FREE)


@query("capacity_alerts_by_floor", f"""
WITH z AS (SELECT a.floor_id, COUNT(s.slot_id) AS total, count_if(s.status = 'Occupied') AS occupied, count_if(s.status = 'Empty') AS assignable
           FROM pk_parking_area a LEFT JOIN pk_parking_slot s ON s.area_id = a.area_id GROUP BY a.floor_id),
live AS (SELECT a.floor_id, COUNT(*) AS n FROM pk_ticket t JOIN pk_parking_slot s ON s.slot_id = t.slot_id
         JOIN pk_parking_area a ON a.area_id = s.area_id WHERE t.status = 'active' GROUP BY a.floor_id),
k AS (SELECT z.floor_id, CAST(total AS BIGINT) AS total, CAST(occupied AS BIGINT) AS occupied, CAST(assignable AS BIGINT) AS assignable,
             CAST(COALESCE(n, 0) AS BIGINT) AS active_sessions, {_PCT.format(p="occupied", w="total")} AS pct
      FROM z LEFT JOIN live ON live.floor_id IS NOT DISTINCT FROM z.floor_id)
SELECT *, 'occupancy' AS alert FROM k WHERE total > 0 AND pct >= {FLOOR_THRESHOLD}
UNION ALL SELECT *, 'low_free' FROM k WHERE assignable < {FLOOR_MIN_FREE}
UNION ALL SELECT *, 'over_capacity' FROM k WHERE active_sessions > total
""")
def _capacity_alerts_by_floor(t):
    return reports.capacity_alerts(t.parking_slot, t.parking_area, t.ticket, FLOOR_THRESHOLD, FLOOR_MIN_FREE, "floor")


@query("audit_summary", """
WITH d AS (
  SELECT staff_id, action, date_trunc('day', event_time) AS day, CAST(COUNT(*) AS BIGINT) AS n,
         CAST(count_if(hour(event_time) < 6 OR hour(event_time) >= 22) AS BIGINT) AS off_hours
  FROM pk_auth_event GROUP BY staff_id, action, date_trunc('day', event_time)),
t AS (SELECT staff_id, action, SUM(n) AS total FROM d GROUP BY staff_id, action)
SELECT d.staff_id, d.action, d.day, d.n, d.off_hours,
       CASE WHEN d.action IN ('role_change', 'config_change') AND d.off_hours > 0 THEN 'off_hours_admin' END AS flag,
       t.total < 2 AS rare
FROM d JOIN t ON t.staff_id = d.staff_id AND t.action = d.action
""")
def _audit_summary(t):
    return reports.audit_summary(t.auth_event)


@query("revenue_delta", """
WITH daily AS (SELECT CAST(payment_time AS DATE) AS d, SUM(amount) AS rev FROM pk_payment WHERE payment_time IS NOT NULL GROUP BY 1),
cal AS (SELECT CAST(g AS DATE) AS d FROM (SELECT min(d) AS lo, max(d) AS hi FROM daily) s, generate_series(s.lo, s.hi, INTERVAL 1 DAY) AS t(g)),
c AS (SELECT cal.d, COALESCE(daily.rev, 0) AS rev FROM cal LEFT JOIN daily ON daily.d = cal.d),
j AS (SELECT c.d, CAST(c.rev * 100 AS BIGINT) AS cur, c.rev, p.rev AS prev, CAST(p.rev * 100 AS BIGINT) AS pc
      FROM c LEFT JOIN c p ON p.d = c.d - INTERVAL 1 DAY)
SELECT CAST(d AS TIMESTAMP) AS day, CAST(rev AS DOUBLE) AS revenue, CAST(prev AS DOUBLE) AS prev_revenue,
       CASE WHEN prev > 0 THEN sign((cur - pc) * 100) * ((2 * abs((cur - pc) * 100) * 100 + pc) // (2 * pc)) / 100.0 END AS pct_change
FROM j
""")
def _revenue_delta(t):
    return reports.revenue_delta(t.payment)


RECENT_K = 10


@query("recent_activity", f"""
WITH top AS (SELECT log_id, ticket_id, action, action_time FROM pk_parking_log WHERE action_time <= TIMESTAMP '{AS_OF}'
             ORDER BY action_time DESC, log_id DESC LIMIT {RECENT_K})
SELECT top.log_id, v.license_plate, top.action, a.area_code, CAST(NULL AS VARCHAR) AS model,
       CAST(NULL AS VARCHAR) AS color, top.action_time,
       '~' || CAST(CAST(floor(date_diff('second', top.action_time, TIMESTAMP '{AS_OF}') / 3600) AS BIGINT) AS VARCHAR) || 'h ago' AS age
FROM top LEFT JOIN pk_ticket t ON t.ticket_id = top.ticket_id LEFT JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id
LEFT JOIN pk_parking_slot s ON s.slot_id = t.slot_id LEFT JOIN pk_parking_area a ON a.area_id = s.area_id
""")
def _recent_activity(t):
    return reports.recent_activity(t.parking_log, t.ticket, t.vehicle, t.parking_slot, t.parking_area, AS_OF, RECENT_K)


@query("entry_exit_log", """
WITH f AS (SELECT ticket_id, SUM(final_amount) AS fee FROM pk_payment WHERE status = 'paid' GROUP BY ticket_id)
SELECT t.ticket_id, v.license_plate, vt.type_name, s.slot_code, t.entry_time, t.check_out_time AS exit_time,
       CAST(floor(date_diff('second', t.entry_time, t.check_out_time) / 60) AS BIGINT) AS minutes, CAST(f.fee AS DOUBLE) AS fee
FROM pk_ticket t LEFT JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id
LEFT JOIN pk_vehicle_type vt ON vt.vehicle_type_id = v.vehicle_type_id
LEFT JOIN pk_parking_slot s ON s.slot_id = t.slot_id LEFT JOIN f ON f.ticket_id = t.ticket_id
""")
def _entry_exit_log(t):
    return reports.entry_exit_log(t.ticket, t.vehicle, t.vehicle_type, t.parking_slot, t.payment)


MAX_STAY = 2880


@query("exception_report", "WITH " + ORACLE_FEE + f""",
tpv AS (SELECT t.*, v.license_plate, v.vehicle_type_id FROM pk_ticket t LEFT JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id),
pt AS (SELECT ticket_id, SUM(CASE WHEN status = 'paid' THEN amount END) AS paid_amount FROM pk_payment GROUP BY ticket_id HAVING paid_amount IS NOT NULL),
mins AS (SELECT ticket_id, CAST(floor(date_diff('second', entry_time, COALESCE(check_out_time, TIMESTAMP '{AS_OF}')) / 60) AS BIGINT) AS m FROM pk_ticket)
SELECT ticket_id, 'lost_ticket' AS kind, qr_code AS detail FROM pk_ticket WHERE status = 'lost'
UNION ALL
SELECT ticket_id, 'plate_mismatch', license_plate_snapshot || ' vs ' || license_plate FROM tpv
WHERE license_plate_snapshot IS NOT NULL
  AND regexp_replace(upper(license_plate_snapshot), '[^0-9A-Z]', '', 'g') <> regexp_replace(upper(license_plate), '[^0-9A-Z]', '', 'g')
UNION ALL
SELECT ticket_id, 'overtime', CAST(m AS VARCHAR) FROM mins WHERE m > {MAX_STAY}
UNION ALL
SELECT tpv.ticket_id, 'wrong_zone', s.slot_type FROM tpv JOIN pk_parking_slot s ON s.slot_id = tpv.slot_id
LEFT JOIN pk_slot_type_map m ON m.slot_type = s.slot_type
WHERE m.vehicle_type_id IS NULL OR m.vehicle_type_id <> tpv.vehicle_type_id
UNION ALL
SELECT pt.ticket_id, 'fee_override', CAST(CAST(pt.paid_amount AS DECIMAL(18,2)) AS VARCHAR) || ' vs ' || CAST(fees.fee AS VARCHAR)
FROM pt JOIN fees ON fees.ticket_id = pt.ticket_id WHERE pt.paid_amount <> fees.fee
UNION ALL
SELECT ticket_id, 'net_mismatch', CAST(count_if(final_amount <> amount - discount) AS VARCHAR) FROM pk_payment
GROUP BY ticket_id HAVING count_if(final_amount <> amount - discount) > 0
UNION ALL
SELECT t.ticket_id, 'unpaid', t.status FROM pk_ticket t
WHERE t.status IN ('completed', 'lost') AND NOT EXISTS (SELECT 1 FROM pt WHERE pt.ticket_id = t.ticket_id)
""")
def _exception_report(t):
    return reports.exception_report(t, MAX_STAY, AS_OF)


# ---------------------------------------------------------------- windows

from lotquery.operators import windows as win  # noqa: E402

# Slot and auth events are dated 2024 while sessions end by 2001, so event
# operators take their own as-of: the end of the event month (decision).
EVENTS_AS_OF = "2024-02-01 00:00:00"

_LEGAL = """COALESCE(from_status = to_status
  OR (from_status = 'Empty' AND to_status IN ('Occupied', 'Reserved', 'Maintenance', 'Locked'))
  OR (from_status = 'Occupied' AND to_status = 'Empty')
  OR (from_status = 'Reserved' AND to_status IN ('Empty', 'Occupied'))
  OR (from_status = 'Maintenance' AND to_status = 'Empty')
  OR (from_status = 'Locked' AND to_status = 'Empty'), false)"""

ORACLE_TRANSITIONS = """
tr AS (
  SELECT event_id, slot_id, event_time, lag(status) OVER w AS from_status, status AS to_status, lag(event_id) OVER w AS prev_id
  FROM pk_slot_event WINDOW w AS (PARTITION BY slot_id ORDER BY event_time, event_id))
"""


@query("slot_transitions", "WITH " + ORACLE_TRANSITIONS + f"""
SELECT event_id, slot_id, event_time, from_status, to_status, {_LEGAL} AS is_legal FROM tr WHERE prev_id IS NOT NULL
""")
def _slot_transitions(t):
    return win.slot_transitions(t.slot_event)


ORACLE_INTERVALS = f"""
iv_e AS (
  SELECT slot_id, status, event_time, lead(event_time) OVER (PARTITION BY slot_id ORDER BY event_time, event_id) AS nt
  FROM pk_slot_event WHERE event_time <= TIMESTAMP '{EVENTS_AS_OF}'),
iv AS (
  SELECT slot_id, status, CAST(COUNT(*) AS BIGINT) AS intervals,
         CAST(floor(CAST(SUM(epoch_us(COALESCE(nt, TIMESTAMP '{EVENTS_AS_OF}')) - epoch_us(event_time)) AS DOUBLE) / 60000000) AS BIGINT) AS minutes
  FROM iv_e GROUP BY slot_id, status)
"""


@query("status_intervals", "WITH " + ORACLE_INTERVALS + "SELECT slot_id, status, intervals, minutes FROM iv")
def _status_intervals(t):
    return win.status_intervals(t.slot_event, EVENTS_AS_OF)


@query("latest_slot_status", """
WITH l AS (SELECT slot_id, status FROM pk_slot_event
           QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY event_time DESC, event_id DESC) = 1)
SELECT s.slot_id, COALESCE(l.status, s.status) AS status, CASE WHEN l.status IS NOT NULL THEN 'event' ELSE 'table' END AS source
FROM pk_parking_slot s LEFT JOIN l ON l.slot_id = s.slot_id
""")
def _latest_slot_status(t):
    return win.latest_slot_status(t.slot_event, t.parking_slot)


_F = "(({t}) // 86400 * 3600 + least(greatest((({t}) % 86400) - {b} * 3600, 0), 3600))"


def _profile_sql(name: str, group: str, join: str = "") -> str:
    return f"""
WITH s AS (
  SELECT {group} AS grp, date_diff('second', TIMESTAMP '1970-01-01 00:00:00', t.entry_time) AS a,
         least(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', COALESCE(t.check_out_time, TIMESTAMP '{AS_OF}')),
               date_diff('second', TIMESTAMP '1970-01-01 00:00:00', TIMESTAMP '{AS_OF}')) AS b
  FROM pk_ticket t JOIN pk_parking_slot sl ON sl.slot_id = t.slot_id {join}
  WHERE t.slot_id IS NOT NULL AND t.entry_time < TIMESTAMP '{AS_OF}'),
s2 AS (SELECT * FROM s WHERE b > a),
k AS (SELECT (min(a) // 86400) * 86400 AS p0, date_diff('second', TIMESTAMP '1970-01-01 00:00:00', TIMESTAMP '{AS_OF}') AS now_s FROM s2),
bands AS (SELECT CAST(i AS BIGINT) AS band FROM range(24) r(i)),
ov AS (SELECT s2.grp, bands.band, SUM({_F.format(t="s2.b", b="bands.band")} - {_F.format(t="s2.a", b="bands.band")}) AS occ
       FROM s2, bands GROUP BY ALL),
av AS (SELECT ov.grp, ov.band,
              CASE WHEN den > 0 THEN ((2 * occ * 10000 + den) // (2 * den)) / 10000.0 END AS avg_occupancy
       FROM (SELECT ov.*, {_F.format(t="k.now_s", b="ov.band")} - {_F.format(t="k.p0", b="ov.band")} AS den FROM ov, k) ov),
ev AS (SELECT grp, t, SUM(d) AS d FROM (SELECT grp, a AS t, 1 AS d FROM s2 UNION ALL SELECT grp, b, -1 FROM s2) GROUP BY ALL),
lv AS (SELECT grp, t, SUM(d) OVER (PARTITION BY grp ORDER BY t) AS level,
              COALESCE(lead(t) OVER (PARTITION BY grp ORDER BY t), (SELECT now_s FROM k)) AS e FROM ev),
seg AS (SELECT grp, level, t, CASE WHEN e - t >= 86400 THEN 24 ELSE (e - 1) // 3600 - t // 3600 + 1 END AS n FROM lv WHERE e > t),
cov AS (SELECT grp, level, CAST((t // 3600 + unnest(range(least(n, 24)))) % 24 AS BIGINT) AS band FROM seg),
pk AS (SELECT grp, band, max(level) AS peak FROM cov GROUP BY ALL)
SELECT av.grp AS {name}, CAST(av.band AS INTEGER) AS band, av.avg_occupancy, CAST(COALESCE(pk.peak, 0) AS BIGINT) AS peak
FROM av LEFT JOIN pk ON pk.grp = av.grp AND pk.band = av.band
"""


@query("occupancy_profile", _profile_sql("area_id", "sl.area_id"))
def _occupancy_profile(t):
    return win.occupancy_profile(t.ticket, t.parking_slot, AS_OF)


@query("occupancy_profile_by_floor",
       _profile_sql("floor_id", "a.floor_id", "LEFT JOIN pk_parking_area a ON a.area_id = sl.area_id"))
def _occupancy_profile_by_floor(t):
    return win.occupancy_profile(t.ticket, t.parking_slot, AS_OF, "floor_id", parking_area=t.parking_area)


@query("occupancy_profile_by_type",
       _profile_sql("vehicle_type_id", "v.vehicle_type_id", "JOIN pk_vehicle v ON v.vehicle_id = t.vehicle_id"))
def _occupancy_profile_by_type(t):
    return win.occupancy_profile(t.ticket, t.parking_slot, AS_OF, "vehicle_type_id", vehicle=t.vehicle)


FORECAST_K = 5


@query("peak_forecast", f"""
WITH c AS (SELECT isodow(entry_time) AS dow, hour(entry_time) AS hour, COUNT(*) AS entries FROM pk_ticket GROUP BY ALL),
s AS (SELECT date_diff('day', CAST(min(entry_time) AS DATE), CAST(max(entry_time) AS DATE)) + 1 AS ndays,
             isodow(min(entry_time)) AS dow_lo FROM pk_ticket),
j AS (SELECT c.*, ndays // 7 + CASE WHEN ((c.dow - s.dow_lo) % 7 + 7) % 7 < ndays % 7 THEN 1 ELSE 0 END AS days FROM c, s)
SELECT CAST(dow AS INTEGER) AS dow, CAST(hour AS INTEGER) AS hour, CAST(entries AS BIGINT) AS entries, CAST(days AS BIGINT) AS days,
       ((2 * entries * 10000 + days) // (2 * days)) / 10000.0 AS expected
FROM j ORDER BY expected DESC, dow, hour LIMIT {FORECAST_K}
""")
def _peak_forecast(t):
    return win.peak_forecast(t.ticket, FORECAST_K)


@query("slot_utilization", "WITH " + ORACLE_INTERVALS + """,
sess AS (SELECT slot_id, COUNT(*) AS sessions,
                CAST(SUM(floor(date_diff('second', entry_time, check_out_time) / 60)) AS BIGINT) AS m,
                COUNT(check_out_time) AS c
         FROM pk_ticket WHERE slot_id IS NOT NULL GROUP BY slot_id),
paid AS (SELECT t.slot_id, SUM(p.amt) AS net
         FROM (SELECT ticket_id, SUM(final_amount) AS amt FROM pk_payment WHERE status = 'paid' GROUP BY ticket_id) p
         JOIN pk_ticket t ON t.ticket_id = p.ticket_id GROUP BY t.slot_id)
SELECT s.slot_id, CAST(COALESCE(sess.sessions, 0) AS BIGINT) AS sessions,
       CASE WHEN sess.c > 0 THEN sign(sess.m) * ((2 * abs(sess.m) * 100 + sess.c) // (2 * sess.c)) / 100.0 END AS avg_minutes,
       CAST(COALESCE(paid.net, 0) AS DOUBLE) AS net_revenue, CAST(COALESCE(iv.minutes, 0) AS BIGINT) AS maintenance_minutes
FROM pk_parking_slot s LEFT JOIN sess ON sess.slot_id = s.slot_id LEFT JOIN paid ON paid.slot_id = s.slot_id
LEFT JOIN iv ON iv.slot_id = s.slot_id AND iv.status = 'Maintenance'
""")
def _slot_utilization(t):
    return win.slot_utilization(t.parking_slot, t.ticket, t.payment, t.slot_event, EVENTS_AS_OF)


# ---------------------------------------------------------------- allocation, booking, registration

from lotquery.operators import booking  # noqa: E402


@query("assignable_slots", """
WITH per AS (SELECT m.vehicle_type_id, s.area_id, COUNT(*) AS n
             FROM pk_parking_slot s JOIN pk_slot_type_map m ON m.slot_type = s.slot_type
             WHERE s.status = 'Empty' GROUP BY ALL)
SELECT vt.vehicle_type_id, vt.type_name, per.area_id, CAST(COALESCE(per.n, 0) AS BIGINT) AS assignable
FROM pk_vehicle_type vt LEFT JOIN per ON per.vehicle_type_id = vt.vehicle_type_id
""")
def _assignable_slots(t):
    return booking.assignable_slots(t.parking_slot, t.slot_type_map, t.vehicle_type)


@query("bookable_slots", """
WITH compat AS (SELECT s.slot_id, m.vehicle_type_id FROM pk_parking_slot s JOIN pk_slot_type_map m ON m.slot_type = s.slot_type
                WHERE s.status NOT IN ('Maintenance', 'Locked')),
live AS (SELECT slot_id, from_time, to_time FROM pk_reservation WHERE state = 'confirmed'),
blk AS (SELECT DISTINCT q.request_id, c.slot_id FROM pk_booking_requests q
        JOIN compat c ON c.vehicle_type_id = q.vehicle_type_id
        JOIN live l ON l.slot_id = c.slot_id AND q.from_time < l.to_time AND l.from_time < q.to_time),
cnt AS (SELECT vehicle_type_id, COUNT(*) AS candidates FROM compat GROUP BY ALL),
b AS (SELECT request_id, COUNT(*) AS blocked FROM blk GROUP BY ALL),
f AS (SELECT q.request_id, min(c.slot_id) AS first_slot_id FROM pk_booking_requests q
      JOIN compat c ON c.vehicle_type_id = q.vehicle_type_id
      WHERE NOT EXISTS (SELECT 1 FROM blk WHERE blk.request_id = q.request_id AND blk.slot_id = c.slot_id)
      GROUP BY q.request_id)
SELECT q.request_id, q.vehicle_type_id, CAST(COALESCE(cnt.candidates, 0) AS BIGINT) AS candidates,
       CAST(COALESCE(b.blocked, 0) AS BIGINT) AS blocked,
       CAST(COALESCE(cnt.candidates, 0) - COALESCE(b.blocked, 0) AS BIGINT) AS bookable, f.first_slot_id
FROM pk_booking_requests q LEFT JOIN cnt ON cnt.vehicle_type_id = q.vehicle_type_id
LEFT JOIN b ON b.request_id = q.request_id LEFT JOIN f ON f.request_id = q.request_id
""")
def _bookable_slots(t):
    return booking.bookable_slots(t.booking_requests, t.parking_slot, t.slot_type_map, t.reservation)


BOOKABLE_K = 3


@query("bookable_slot_list", f"""
WITH compat AS (SELECT s.slot_id, m.vehicle_type_id FROM pk_parking_slot s JOIN pk_slot_type_map m ON m.slot_type = s.slot_type
                WHERE s.status NOT IN ('Maintenance', 'Locked')),
blk AS (SELECT DISTINCT q.request_id, l.slot_id FROM pk_booking_requests q
        JOIN pk_reservation l ON l.state = 'confirmed' AND q.from_time < l.to_time AND l.from_time < q.to_time)
SELECT q.request_id, CAST(row_number() OVER (PARTITION BY q.request_id ORDER BY c.slot_id) AS INTEGER) AS choice, c.slot_id
FROM pk_booking_requests q JOIN compat c ON c.vehicle_type_id = q.vehicle_type_id
ANTI JOIN blk ON blk.request_id = q.request_id AND blk.slot_id = c.slot_id
QUALIFY choice <= {BOOKABLE_K}
""")
def _bookable_slot_list(t):
    """J9 as pairs: each request's lowest bookable slots."""
    return booking.bookable_slot_list(t.booking_requests, t.parking_slot, t.slot_type_map, t.reservation, BOOKABLE_K)


@query("arrival_booking", """
WITH h AS (SELECT a.arrival_id, r.reservation_id FROM pk_arrivals a JOIN pk_reservation r
             ON r.vehicle_id = a.vehicle_id AND r.state = 'confirmed' AND r.from_time <= a.arrival_time AND a.arrival_time < r.to_time
           QUALIFY row_number() OVER (PARTITION BY a.arrival_id ORDER BY r.from_time, r.reservation_id) = 1)
SELECT a.arrival_id, a.vehicle_id, a.arrival_time, h.reservation_id, h.reservation_id IS NOT NULL AS is_booked
FROM pk_arrivals a LEFT JOIN h ON h.arrival_id = a.arrival_id
""")
def _arrival_booking(t):
    return booking.arrival_booking(t.arrivals, t.reservation)


@query("assign_slots", """
WITH zones AS (SELECT area_id, COUNT(*) AS zone_total, count_if(status = 'Occupied') AS zone_occupied FROM pk_parking_slot GROUP BY area_id),
free AS (SELECT s.slot_id, s.area_id, m.vehicle_type_id,
                row_number() OVER (PARTITION BY m.vehicle_type_id, s.area_id ORDER BY s.slot_id) AS zone_rank
         FROM pk_parking_slot s JOIN pk_slot_type_map m ON m.slot_type = s.slot_type WHERE s.status = 'Empty'),
f2 AS (SELECT f.*, (z.zone_occupied + f.zone_rank) / z.zone_total AS fill FROM free f JOIN zones z ON z.area_id = f.area_id),
f3 AS (SELECT *, row_number() OVER (PARTITION BY vehicle_type_id ORDER BY fill, slot_id) AS rank FROM f2),
a AS (SELECT arrival_id, vehicle_type_id, row_number() OVER (PARTITION BY vehicle_type_id ORDER BY arrival_time, arrival_id) AS rank
      FROM pk_arrivals)
SELECT a.arrival_id, a.vehicle_type_id, f3.slot_id, f3.area_id,
       CASE WHEN f3.slot_id IS NOT NULL THEN 'assigned' ELSE 'manual' END AS outcome
FROM a LEFT JOIN f3 ON f3.vehicle_type_id = a.vehicle_type_id AND f3.rank = a.rank
""")
def _assign_slots(t):
    return booking.assign_slots(t.arrivals, t.parking_slot, t.slot_type_map)


@query("register_drivers", r"""
WITH r AS (
  SELECT request_id, full_name, phone, email, address, license_plate, upper(""" + _JTRIM.format(c="license_plate") + r""") AS plate_norm,
         COALESCE(CASE WHEN regexp_matches(vehicle_type_text, '^[+-]?[0-9]+$') THEN TRY_CAST(vehicle_type_text AS INTEGER) END, 1) AS vehicle_type_id,
         COALESCE(upper(""" + _JTRIM.format(c="license_plate") + r""") <> ''
                  AND regexp_matches(upper(""" + _JTRIM.format(c="license_plate") + r"""), '^[0-9]{2}[A-Z]-[0-9]{3}\.[0-9]{2}$'), false) AS plate_ok
  FROM pk_registration_requests),
r2 AS (SELECT r.*, vt.vehicle_type_id IS NOT NULL AS type_ok, tk.plate_norm IS NOT NULL AS taken
       FROM r LEFT JOIN pk_vehicle_type vt ON vt.vehicle_type_id = r.vehicle_type_id
       LEFT JOIN (SELECT DISTINCT upper(""" + _JTRIM.format(c="license_plate") + r""") AS plate_norm FROM pk_vehicle) tk
         ON tk.plate_norm = r.plate_norm),
w AS (SELECT plate_norm, min(request_id) AS winner FROM r2
      WHERE plate_ok AND full_name IS NOT NULL AND NOT taken AND type_ok GROUP BY plate_norm),
o AS (SELECT r2.*, CASE WHEN NOT plate_ok THEN 'bad_plate' WHEN full_name IS NULL THEN 'missing_name'
                        WHEN taken THEN 'duplicate_plate' WHEN w.winner < r2.request_id THEN 'duplicate_plate'
                        WHEN w.winner = r2.request_id THEN 'registered' ELSE 'unknown_vehicle_type' END AS outcome
      FROM r2 LEFT JOIN w ON w.plate_norm = r2.plate_norm),
k AS (SELECT request_id, row_number() OVER (ORDER BY request_id) AS seq FROM o WHERE outcome = 'registered')
SELECT o.request_id, o.outcome, (SELECT max(customer_id) FROM pk_customer) + k.seq AS customer_id,
       (SELECT max(vehicle_id) FROM pk_vehicle) + k.seq AS vehicle_id, o.full_name, o.phone, o.email, o.address, o.license_plate, o.vehicle_type_id
FROM o LEFT JOIN k ON k.request_id = o.request_id
""")
def _register_drivers(t):
    return booking.register_drivers(t.registration_requests, t.customer, t.vehicle, t.vehicle_type)


# ---------------------------------------------------------------- streaming (availableNow runs)

from lotquery.streaming import live  # noqa: E402

ONCE = {"availableNow": True}
#: Files of a source that a micro-batch takes at most.
FILES_PER_TRIGGER = 256


def _log_stream(spark, t, name):
    """The canonical parking log (stored as Parquet under the shared checkpoint
    folder) read as a file stream."""
    if hasattr(t, "path_of"):
        path = t.path_of("parking_log")
    else:
        path = scratch_path(spark, f"{name}-log")
        t.parking_log.write.parquet(path)
    return live.table_stream(spark, path, "parking_log")


_LATEST_SQL = """
SELECT s.slot_id, s.slot_code, COALESCE(l.status, s.status) AS status FROM pk_parking_slot s
LEFT JOIN (SELECT slot_id, status FROM pk_slot_event
           QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY event_time DESC, event_id DESC) = 1) l
  ON l.slot_id = s.slot_id
"""


@query("live_slot_grid", SLOT_GRID_SQL.replace("{slots}", "(" + _LATEST_SQL + ")"), raw=True)
def _live_slot_grid(spark, sf_dir, t):
    """Stream the slot events through to the end; the last published grid."""
    root = scratch_path(spark, "live_slot_grid")
    events = live.derived_stream(spark, "pk_slot_event", live.event_stream(spark, sf_dir))
    live.run(live.live_slot_grid(events, t.parking_slot, root, ONCE, live.default_state_partitions(spark)))
    return live.latest_version(spark, f"{root}/grid").select("row", "col", "occ")


@query("live_volumes", """
SELECT date_trunc('hour', action_time) AS window_start, action, CAST(COUNT(*) AS BIGINT) AS n
FROM pk_parking_log WHERE action_time IS NOT NULL GROUP BY ALL
""", raw=True)
def _live_volumes(spark, sf_dir, t):
    """R2 in update mode with a one-day watermark: current hourly counts."""
    root = scratch_path(spark, "live_volumes")
    live.run(live.live_volumes(_log_stream(spark, t, "live_volumes"), root, ONCE, mode="update",
                               state_partitions=live.default_state_partitions(spark)))
    return live.volumes_table(spark, root)


@query("live_transition_check", "WITH " + ORACLE_TRANSITIONS + f"""
SELECT event_id, slot_id, event_time, from_status, to_status, 'illegal' AS kind
FROM tr WHERE prev_id IS NOT NULL AND NOT {_LEGAL}
""", raw=True)
def _live_transition_check(spark, sf_dir, t):
    """Illegal moves (and late events) over the event stream."""
    root = scratch_path(spark, "live_transition_check")
    events = live.derived_stream(spark, "pk_slot_event", live.event_stream(spark, sf_dir, FILES_PER_TRIGGER))
    live.run(live.live_transition_check(events, root, ONCE, live.default_state_partitions(spark)))
    return live.transition_alerts(spark, root)


@query("overstay_alerts", f"""
WITH e AS (SELECT ticket_id, action_time FROM pk_parking_log WHERE action = 'entry'),
x AS (SELECT ticket_id, action_time FROM pk_parking_log WHERE action = 'exit'),
w AS (SELECT max(action_time) - INTERVAL 1 HOUR AS wm FROM pk_parking_log)
SELECT e.ticket_id, e.action_time AS entry_time, e.action_time + INTERVAL {MAX_STAY} MINUTE AS deadline, 'overstay' AS kind
FROM e, w
WHERE e.action_time + INTERVAL {MAX_STAY} MINUTE < w.wm
  AND NOT EXISTS (SELECT 1 FROM x WHERE x.ticket_id = e.ticket_id AND x.action_time >= e.action_time
                  AND x.action_time <= e.action_time + INTERVAL {MAX_STAY} MINUTE)
""", raw=True)
def _overstay_alerts(spark, sf_dir, t):
    """Sessions with no exit within the maximum stay, as alerts."""
    root = scratch_path(spark, "overstay_alerts")
    live.run(live.overstay_alerts(_log_stream(spark, t, "overstay_alerts"), root, MAX_STAY, ONCE,
                                  state_partitions=live.default_state_partitions(spark)))
    return spark.read.parquet(f"{root}/out")


@query("reservation_expiry", """
WITH r AS (SELECT reservation_id, slot_id, vehicle_id, from_time, to_time FROM pk_reservation WHERE state = 'confirmed'),
a AS (SELECT arrival_id, vehicle_id, arrival_time FROM pk_arrivals),
w AS (SELECT least((SELECT max(to_time) FROM r), (SELECT max(arrival_time) FROM a)) - INTERVAL 1 HOUR AS wm),
m AS (SELECT r.*, a.arrival_id FROM r JOIN a ON a.vehicle_id = r.vehicle_id AND a.arrival_time >= r.from_time
        AND a.arrival_time < r.to_time)
SELECT reservation_id, slot_id, vehicle_id, from_time, to_time, arrival_id, 'fulfilled' AS outcome,
       CAST(NULL AS VARCHAR) AS slot_status FROM m
UNION ALL
SELECT r.reservation_id, r.slot_id, r.vehicle_id, r.from_time, r.to_time, NULL, 'expired', 'Empty' FROM r, w
WHERE r.to_time < w.wm AND NOT EXISTS (SELECT 1 FROM m WHERE m.reservation_id = r.reservation_id)
""", raw=True)
def _reservation_expiry(spark, sf_dir, t):
    """Confirmed reservations fulfilled by an arrival, or expired."""
    root = scratch_path(spark, "reservation_expiry")
    res = live.derived_stream(spark, "pk_reservation", live.event_stream(spark, sf_dir))
    arr = live.derived_stream(spark, "pk_arrivals", live.event_stream(spark, sf_dir), pk_vehicle=t.vehicle)
    live.run(live.reservation_expiry(res, arr, root, trigger=ONCE,
                                     state_partitions=live.default_state_partitions(spark)))
    return live.reservation_outcomes(spark, root)


LOCKOUT_N, LOCKOUT_MINUTES = 2, 15


@query("lockout_alerts", f"""
SELECT staff_id, time_bucket(INTERVAL {LOCKOUT_MINUTES} MINUTE, event_time) AS window_start,
       time_bucket(INTERVAL {LOCKOUT_MINUTES} MINUTE, event_time) + INTERVAL {LOCKOUT_MINUTES} MINUTE AS window_end,
       CAST(COUNT(*) AS BIGINT) AS failures
FROM pk_auth_event WHERE action = 'login_failed' GROUP BY ALL HAVING COUNT(*) >= {LOCKOUT_N}
""", raw=True)
def _lockout_alerts(spark, sf_dir, t):
    """R6 over the auth event stream (n = 2 in 15 minutes at fixture scale)."""
    root = scratch_path(spark, "lockout_alerts")
    auth = live.derived_stream(spark, "pk_auth_event", live.event_stream(spark, sf_dir))
    live.run(live.lockout_alerts(auth, root, LOCKOUT_N, LOCKOUT_MINUTES, ONCE, live.default_state_partitions(spark)))
    return live.lockout_table(spark, root)


LOCKOUT_SLIDE = 5


@query("lockout_bursts", f"""
WITH f AS (SELECT staff_id, time_bucket(INTERVAL {LOCKOUT_SLIDE} MINUTE, event_time) AS last FROM pk_auth_event WHERE action = 'login_failed'),
w AS (SELECT staff_id, window_start, window_start + INTERVAL {LOCKOUT_MINUTES} MINUTE AS window_end, COUNT(*) AS failures
      FROM (SELECT staff_id, unnest(generate_series(last - INTERVAL {LOCKOUT_MINUTES - LOCKOUT_SLIDE} MINUTE, last, INTERVAL {LOCKOUT_SLIDE} MINUTE)) AS window_start FROM f)
      GROUP BY ALL HAVING COUNT(*) >= {LOCKOUT_N}),
g AS (SELECT *, CASE WHEN window_start < max(window_end) OVER (PARTITION BY staff_id ORDER BY window_start
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first FROM w),
h AS (SELECT *, sum(first) OVER (PARTITION BY staff_id ORDER BY window_start) AS burst FROM g)
SELECT staff_id, min(window_start) AS burst_start, max(window_end) AS burst_end, CAST(COUNT(*) AS BIGINT) AS windows,
       CAST(max(failures) AS BIGINT) AS most_failures
FROM h GROUP BY staff_id, burst
""", raw=True)
def _lockout_bursts(spark, sf_dir, t):
    """R6 with sliding windows, merged to one alert for each burst."""
    root = scratch_path(spark, "lockout_bursts")
    auth = live.derived_stream(spark, "pk_auth_event", live.event_stream(spark, sf_dir))
    live.run(live.lockout_alerts(auth, root, LOCKOUT_N, LOCKOUT_MINUTES, ONCE, live.default_state_partitions(spark),
                                 slide_minutes=LOCKOUT_SLIDE))
    return live.lockout_bursts(live.lockout_table(spark, root))
