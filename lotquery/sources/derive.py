"""Canonical parking tables derived from the driver's TPC-H-style Parquet tables.

Each derivation is one SQL text that Spark and DuckDB both accept.  Table
references are written ``{name}``: Spark binds them to DataFrames through
``spark.sql(text, name=df)``; the DuckDB oracle replaces them with view / CTE
names.  The texts are fixture definitions (FIXTURES.md part B), shared on
purpose so both engines start from identical inputs; operators themselves are
written independently with the DataFrame API (Spark) and plain SQL (oracle).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lotquery.sources.tables import ParkingTables

# Fixed fixture constants (FIXTURES.md): the oracle run uses the same values.
AS_OF = "2001-08-05 00:00:00"
PAY_DAY = "1998-04-25"


DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Derivation texts in dependency order.  Fixed values below (prices, rules,
# vocabularies) are fixture definitions and must stay exactly as written.
DERIVATIONS: dict[str, str] = {
    "pk_vehicle_type": """
SELECT * FROM (VALUES (1,'Sedan',CAST(15000 AS DECIMAL(18,2)),CAST(120000 AS DECIMAL(18,2))),(2,'SUV / Truck',CAST(20000 AS DECIMAL(18,2)),CAST(160000 AS DECIMAL(18,2))),(3,'Motorbike',CAST(5000 AS DECIMAL(18,2)),CAST(40000 AS DECIMAL(18,2)))) AS t(vehicle_type_id, type_name, price_per_hour, price_per_day)
""",
    "pk_slot_type_map": """
SELECT * FROM (VALUES ('Sedan',1),('SUV',2),('Motorbike',3)) AS t(slot_type, vehicle_type_id)
""",
    "pk_payment_method": """
SELECT * FROM (VALUES (1,'Cash Handover',true),(2,'Momo QR Scan',true),(3,'Bank Card Terminal',true)) AS t(payment_method_id, method_name, is_active)
""",
    "pk_pricing_rules": """
SELECT rule_id, vehicle_type_id, start_sec, end_sec, day_type, CAST(f AS DECIMAL(18,2)) AS first_hour_price, CAST(n AS DECIMAL(18,2)) AS next_hour_price, CAST(m AS DECIMAL(18,2)) AS max_daily_price, is_active, effective_from, effective_to
FROM (VALUES (1,1,21600,79200,'Weekday',15000,10000,120000,true,DATE '1995-01-01',DATE '1998-12-31'),
 (2,2,21600,79200,'Weekday',20000,15000,160000,true,DATE '1995-01-01',DATE '1998-12-31'),
 (3,3,21600,79200,'Weekday',5000,3000,40000,true,DATE '1995-01-01',DATE '1998-12-31'),
 (4,1,0,86400,'Weekend',18000,12000,140000,true,DATE '1995-01-01',DATE '2001-12-31'),
 (5,1,21600,79200,'Weekday',16000,11000,130000,true,DATE '1998-01-01',DATE '2001-12-31'),
 (6,2,0,86400,'Weekend',1,1,1,false,DATE '1995-01-01',DATE '2001-12-31'),
 (7,3,0,86400,'Holiday',9000,6000,60000,true,DATE '1995-01-01',DATE '2001-12-31'))
 AS t(rule_id, vehicle_type_id, start_sec, end_sec, day_type, f, n, m, is_active, effective_from, effective_to)
""",
    "pk_holidays": """
SELECT * FROM (VALUES (DATE '1996-01-01'),(DATE '1997-01-01')) AS t(holiday)
""",
    "pk_staff": """
SELECT s_suppkey + 1 AS staff_id, s_name AS name,
 CASE WHEN s_suppkey % 10 = 9 THEN 'guest' WHEN s_nationkey % 3 = 0 THEN 'ADMIN' WHEN s_nationkey % 3 = 1 THEN 'Manager ' ELSE 'attendant' END AS role,
 CASE WHEN s_acctbal < 1000 THEN 'inactive' WHEN s_suppkey % 4 = 0 THEN ' Active' ELSE 'active' END AS status
FROM {supplier}
""",
    "pk_parking_area": """
SELECT n_nationkey + 1 AS area_id, 'ZONE-' || chr(CAST(65 + n_nationkey AS INT)) AS area_code, n_regionkey + 1 AS floor_id FROM {nation}
""",
    "pk_parking_slot": """
SELECT p_partkey + 1 AS slot_id, CAST(p_partkey % 25 + 1 AS INT) AS area_id,
 chr(CAST(65 + p_partkey % 25 AS INT)) || '-' || lpad(CAST(CAST(floor(p_partkey / 25) AS INT) + 1 AS STRING), 3, '0') AS slot_code,
 CASE p_partkey % 3 WHEN 0 THEN 'Sedan' WHEN 1 THEN 'SUV' ELSE 'Motorbike' END AS slot_type,
 CASE WHEN p_size <= 20 THEN 'Empty' WHEN p_size <= 40 THEN 'Occupied' WHEN p_size <= 45 THEN 'Reserved' ELSE 'Maintenance' END AS status
FROM {part}
""",
    "pk_customer": """
SELECT c_custkey + 1 AS customer_id, c_name AS name, '09' || lpad(CAST(c_custkey AS STRING), 8, '0') AS phone FROM {customer}
""",
    "pk_vehicle": """
SELECT c_custkey + 1 AS vehicle_id, c_custkey + 1 AS customer_id, CAST(c_custkey % 3 + 1 AS INT) AS vehicle_type_id,
 CASE WHEN c_custkey % 60 = 59 THEN 'X' ELSE '' END || lpad(CAST(10 + c_custkey % 90 AS STRING), 2, '0') || chr(CAST(65 + floor(c_custkey / 90) % 26 AS INT)) || '-' || lpad(CAST(CAST(floor(c_custkey / 2340) AS INT) % 1000 AS STRING), 3, '0') || '.' || lpad(CAST(c_custkey * 7 % 100 AS STRING), 2, '0') AS license_plate
FROM {customer}
""",
    "pk_ticket": """
SELECT o_orderkey AS ticket_id, o_custkey + 1 AS vehicle_id, CAST(o_orderkey % 200 + 1 AS BIGINT) AS slot_id, CAST(o_orderkey % 4 + 1 AS INT) AS gate_id,
 CAST(o_orderkey % 10 + 1 AS BIGINT) AS check_in_by,
 o_orderdate + (o_orderkey * 37 % 1440) * INTERVAL '1' MINUTE + (o_orderkey * 11 % 60) * INTERVAL '1' SECOND AS entry_time,
 CASE WHEN o_orderkey % 40 = 5 THEN '00X00000' ELSE replace(replace(v.license_plate, '-', ''), '.', '') END AS license_plate_snapshot,
 'QR-' || CAST(CASE WHEN o_orderkey % 500 = 498 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING) AS qr_code,
 CASE WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 10 = 0 THEN 'lost' WHEN o_orderkey % 10 = 1 THEN 'canceled' ELSE 'completed' END AS status,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + (o_orderkey * 37 % 1440 + o_orderkey * 7919 % 4320 + 5) * INTERVAL '1' MINUTE END AS check_out_time,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderkey * 3 % 10 + 1 AS BIGINT) END AS check_out_by
FROM {orders} JOIN {pk_vehicle} v ON v.vehicle_id = o_custkey + 1
""",
    "pk_parking_log": """
SELECT ticket_id * 2 AS log_id, ticket_id, check_in_by AS staff_id, 'entry' AS action, entry_time AS action_time FROM {pk_ticket} WHERE ticket_id % 50 <> 7
UNION ALL
SELECT ticket_id * 2 + 1 AS log_id, ticket_id, check_out_by AS staff_id, 'exit' AS action, check_out_time AS action_time FROM {pk_ticket} WHERE status IN ('completed', 'lost')
""",
    "pk_payment": """
SELECT o_orderkey AS payment_id, o_orderkey AS ticket_id, CASE WHEN o_orderkey % 97 = 3 THEN 9 ELSE CAST(o_orderkey % 3 + 1 AS INT) END AS payment_method_id,
 CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderkey % 5 * 100 AS DECIMAL(18,2)) AS discount,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(o_orderkey % 5 * 100 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS final_amount,
 t.check_out_time AS payment_time,
 CASE o_orderkey % 20 WHEN 0 THEN 'unpaid' WHEN 1 THEN 'refunded' ELSE 'paid' END AS status
FROM {orders} JOIN {pk_ticket} t ON t.ticket_id = o_orderkey WHERE t.status IN ('completed', 'lost')
""",
    "pk_slot_event": """
SELECT event_id, ts AS event_time, user_id + 1 AS slot_id,
 CASE event_type WHEN 'signup' THEN 'Occupied' WHEN 'purchase' THEN 'Empty' WHEN 'click' THEN 'Reserved' WHEN 'view' THEN 'Maintenance' ELSE 'Locked' END AS status
FROM {events}
""",
    "pk_auth_event": """
SELECT event_id, ts AS event_time, CAST(user_id % 10 + 1 AS BIGINT) AS staff_id,
 CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'role_change' WHEN 'purchase' THEN 'config_change' ELSE 'login_ok' END AS action
FROM {events}
""",
    "pk_reservation": """
SELECT event_id AS reservation_id, user_id + 1 AS slot_id, user_id + 1 AS vehicle_id, ts + INTERVAL '1' HOUR AS from_time,
 ts + (event_id % 4 + 2) * INTERVAL '1' HOUR AS to_time, CASE WHEN event_id % 7 = 0 THEN 'canceled' ELSE 'confirmed' END AS state
FROM {events} WHERE event_type = 'click'
""",
    "pk_arrivals": """
SELECT e.event_id AS arrival_id, e.ts AS arrival_time, v.vehicle_id, v.license_plate, v.vehicle_type_id
FROM {events} e JOIN {pk_vehicle} v ON v.vehicle_id = e.user_id + 1 WHERE e.event_type = 'signup'
""",
    "pk_booking_requests": """
SELECT event_id AS request_id, CAST(event_id % 3 + 1 AS INT) AS vehicle_type_id, ts AS from_time, ts + INTERVAL '2' HOUR AS to_time
FROM {events} WHERE event_type = 'view'
""",
    "pk_scans": """
SELECT event_id AS scan_id, 'QR-' || CAST(event_id * 2 AS STRING) AS qr_code, ts AS scan_time FROM {events} WHERE event_type = 'purchase'
""",
    "pk_registration_requests": """
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 70 = 69 THEN NULL ELSE c_name END AS full_name,
 '08' || lpad(CAST(c_custkey AS STRING), 8, '0') AS phone,
 CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE 'driver' || CAST(c_custkey AS STRING) || '@mail.example' END AS email,
 CASE WHEN c_custkey % 11 = 6 THEN NULL ELSE CAST(c_custkey % 300 + 1 AS STRING) || ' Example Street, nation ' || CAST(c_nationkey AS STRING) END AS address,
 CASE c_custkey % 10 WHEN 0 THEN v.license_plate WHEN 1 THEN 'bad' WHEN 2 THEN lower(k.plate) ELSE k.plate END AS license_plate,
 CASE WHEN c_custkey % 100 = 98 THEN '9' WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '2' WHEN c_custkey % 4 = 2 THEN 'abc' ELSE '3' END AS vehicle_type_text
FROM {customer} JOIN {pk_vehicle} v ON v.vehicle_id = c_custkey + 1
JOIN (SELECT c_custkey AS ck, '0' || CAST(n % 10 AS STRING) || chr(CAST(65 + floor(n / 10) % 26 AS INT)) || '-' || lpad(CAST(CAST(floor(n / 260) AS INT) % 1000 AS STRING), 3, '0') || '.00' AS plate
      FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 1 ELSE c_custkey END AS n FROM {customer}) q) k ON k.ck = c_custkey
""",
}

_REF = re.compile(r"\{(\w+)\}")


def references(text: str) -> list[str]:
    return sorted(set(_REF.findall(text)))


def derive_tables(spark: SparkSession, sf_dir: str) -> ParkingTables:
    """Lazily derive every canonical table from the driver tables in ``sf_dir``.

    Only the columns each derivation names are read (Parquet column pruning),
    and nothing runs until an operator's result is acted on.
    """
    frames: dict[str, DataFrame] = {}

    def driver(name: str) -> DataFrame:
        if name not in frames:
            frames[name] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        return frames[name]

    for name, text in DERIVATIONS.items():
        args = {ref: (frames[ref] if ref.startswith("pk_") else driver(ref)) for ref in references(text)}
        frames[name] = spark.sql(text, **args)
    return ParkingTables.from_mapping({k[3:]: v for k, v in frames.items() if k.startswith("pk_")})


# Columns each canonical table is ordered by inside its files, so range filters
# on them skip row groups by Parquet min/max statistics.
CLUSTER_BY = {"ticket": "entry_time", "payment": "payment_time", "parking_log": "action_time",
              "slot_event": "event_time", "auth_event": "event_time", "reservation": "from_time",
              "arrivals": "arrival_time"}


class MaterializedTables:
    """Canonical tables written once, on first use, as Parquet under ``root``
    (a folder in the shared checkpoint location) and read back from there.

    This cuts the derivation lineage: queries scan compact canonical files with
    column pruning and pushed filters instead of recomputing the fixture joins,
    and a lost executor recomputes from those files.  Only the tables a query
    touches are written."""

    def __init__(self, spark: SparkSession, derived: ParkingTables, root: str):
        self._spark = spark
        self._derived = derived
        self._root = root.rstrip("/")
        self._done: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame | None:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._done:
            df = getattr(self._derived, name)
            if df is None:
                return None
            if name in CLUSTER_BY:
                df = df.sortWithinPartitions(CLUSTER_BY[name])
            path = f"{self._root}/{name}"
            df.write.mode("overwrite").parquet(path)
            self._done[name] = self._spark.read.parquet(path)
        return self._done[name]

    def names(self) -> list[str]:
        return self._derived.names()

    def path_of(self, name: str) -> str:
        """Folder holding the stored table (written on first use)."""
        getattr(self, name)
        return f"{self._root}/{name}"


def materialize_tables(spark: SparkSession, tables: ParkingTables, root: str) -> MaterializedTables:
    return MaterializedTables(spark, tables, root)


def duckdb_with(sql: str) -> str:
    """Prefix an oracle query that names ``pk_*`` views with the CTEs it needs."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed or name not in DERIVATIONS:
            return
        for ref in references(DERIVATIONS[name]):
            if ref.startswith("pk_"):
                visit(ref)
        needed.append(name)

    for name in sorted(set(re.findall(r"\bpk_\w+", sql))):
        visit(name)
    order = [n for n in DERIVATIONS if n in needed]
    ctes = ",\n".join(f"{n} AS ({_REF.sub(lambda m: m.group(1), DERIVATIONS[n]).strip()})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"(?is)^with\s", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
