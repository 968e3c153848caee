"""Canonical parking tables: schemas, S1 ``load_tables`` and S2 ``seed_tables``."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _schema(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


L, I, S, TS, D, B = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType(), T.DateType(), T.BooleanType()

# Canonical schemas (FIXTURES.md part A).  No password column is ever loaded.
SCHEMAS: dict[str, T.StructType] = {
    "staff": _schema(("staff_id", L, False), ("name", S, False), ("role", S, False), ("status", S, False)),
    "vehicle_type": _schema(("vehicle_type_id", I, False), ("type_name", S, False),
                            ("price_per_hour", MONEY, False), ("price_per_day", MONEY, False)),
    "slot_type_map": _schema(("slot_type", S, False), ("vehicle_type_id", I, False)),
    "payment_method": _schema(("payment_method_id", I, False), ("method_name", S, False), ("is_active", B, False)),
    "pricing_rules": _schema(("rule_id", I, False), ("vehicle_type_id", I, False), ("start_sec", I, False),
                             ("end_sec", I, False), ("day_type", S, False), ("first_hour_price", MONEY, False),
                             ("next_hour_price", MONEY, False), ("max_daily_price", MONEY, False),
                             ("is_active", B, False), ("effective_from", D, False), ("effective_to", D, False)),
    "holidays": _schema(("holiday", D, False)),
    "parking_area": _schema(("area_id", I, False), ("area_code", S, False), ("floor_id", I, True)),
    "parking_slot": _schema(("slot_id", L, False), ("area_id", I, False), ("slot_code", S, False),
                            ("slot_type", S, False), ("status", S, False)),
    "customer": _schema(("customer_id", L, False), ("name", S, False), ("phone", S, True)),
    "vehicle": _schema(("vehicle_id", L, False), ("customer_id", L, False), ("vehicle_type_id", I, False),
                       ("license_plate", S, False), ("model", S, True), ("color", S, True)),
    "ticket": _schema(("ticket_id", L, False), ("vehicle_id", L, False), ("slot_id", L, True), ("gate_id", I, True),
                      ("check_in_by", L, False), ("entry_time", TS, False), ("license_plate_snapshot", S, True),
                      ("qr_code", S, False), ("status", S, False), ("check_out_time", TS, True),
                      ("check_out_by", L, True)),
    "parking_log": _schema(("log_id", L, False), ("ticket_id", L, False), ("staff_id", L, True),
                           ("action", S, False), ("action_time", TS, True)),
    "payment": _schema(("payment_id", L, False), ("ticket_id", L, False), ("payment_method_id", I, False),
                       ("amount", MONEY, False), ("discount", MONEY, False), ("final_amount", MONEY, False),
                       ("payment_time", TS, True), ("status", S, False)),
    "slot_event": _schema(("event_id", L, False), ("event_time", TS, False), ("slot_id", L, False), ("status", S, False)),
    "auth_event": _schema(("event_id", L, False), ("event_time", TS, False), ("staff_id", L, False), ("action", S, False)),
    "reservation": _schema(("reservation_id", L, False), ("slot_id", L, False), ("vehicle_id", L, False),
                           ("from_time", TS, False), ("to_time", TS, False), ("state", S, False)),
    "arrivals": _schema(("arrival_id", L, False), ("arrival_time", TS, False), ("vehicle_id", L, False),
                        ("license_plate", S, True), ("vehicle_type_id", I, False)),
    "booking_requests": _schema(("request_id", L, False), ("vehicle_type_id", I, False),
                                ("from_time", TS, False), ("to_time", TS, False)),
    "scans": _schema(("scan_id", L, False), ("qr_code", S, True), ("scan_time", TS, False)),
    "registration_requests": _schema(("request_id", L, False), ("full_name", S, True), ("phone", S, True),
                                     ("email", S, True), ("address", S, True),
                                     ("license_plate", S, True), ("vehicle_type_text", S, True)),
}


@dataclass
class ParkingTables:
    """The canonical tables as lazy DataFrames (any may be None when absent)."""

    staff: DataFrame | None = None
    vehicle_type: DataFrame | None = None
    slot_type_map: DataFrame | None = None
    payment_method: DataFrame | None = None
    pricing_rules: DataFrame | None = None
    holidays: DataFrame | None = None
    parking_area: DataFrame | None = None
    parking_slot: DataFrame | None = None
    customer: DataFrame | None = None
    vehicle: DataFrame | None = None
    ticket: DataFrame | None = None
    parking_log: DataFrame | None = None
    payment: DataFrame | None = None
    slot_event: DataFrame | None = None
    auth_event: DataFrame | None = None
    reservation: DataFrame | None = None
    arrivals: DataFrame | None = None
    booking_requests: DataFrame | None = None
    scans: DataFrame | None = None
    registration_requests: DataFrame | None = None

    @classmethod
    def from_mapping(cls, frames: dict[str, DataFrame]) -> "ParkingTables":
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in frames.items() if k in names})

    def names(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) is not None]


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                names: list[str] | None = None) -> ParkingTables:
    """Read canonical tables stored one folder per table under ``path``
    with explicit schemas (no inference, so a 100 TB scan starts at once and
    Parquet column pruning / filter pushdown apply)."""
    frames = {}
    for name in names or list(SCHEMAS):
        frames[name] = spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{path.rstrip('/')}/{name}")
    return ParkingTables.from_mapping(frames)


def load_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str,
                    lower: int, upper: int, num_partitions: int, properties: dict[str, str]) -> DataFrame:
    """S1 over JDBC: a partitioned range read so the scan is spread over
    ``num_partitions`` tasks.  Credentials come from ``properties`` (caller's
    configuration), never from code."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties)


def seed_tables(spark: SparkSession, as_of: dt.datetime) -> ParkingTables:
    """The reference's constant seed rows, with relative times resolved
    against ``as_of`` (an explicit argument, never the clock)."""
    def hours_ago(h: int) -> dt.datetime:
        return as_of - dt.timedelta(hours=h)

    m = Decimal
    rows = {
        # Fixed seed values (reference schema script); passwords deliberately omitted.
        "staff": [(1, "Nguyen Admin", "admin", "active"), (2, "Tran Manager", "manager", "active"),
                  (3, "Le Attendant 1", "attendant", "active"), (4, "Pham Attendant 2", "attendant", "active")],
        "vehicle_type": [(1, "Sedan", m("15000.00"), m("120000.00")), (2, "SUV / Truck", m("20000.00"), m("160000.00")),
                         (3, "Motorbike", m("5000.00"), m("40000.00"))],
        "slot_type_map": [("Sedan", 1), ("SUV", 2), ("Motorbike", 3)],
        "payment_method": [(1, "Cash Handover", True), (2, "Momo QR Scan", True), (3, "Bank Card Terminal", True)],
        "pricing_rules": [
            (1, 1, 21600, 79200, "Weekday", m("15000.00"), m("10000.00"), m("120000.00"), True,
             dt.date(2026, 1, 1), dt.date(2026, 12, 31)),
            (2, 2, 21600, 79200, "Weekday", m("20000.00"), m("15000.00"), m("160000.00"), True,
             dt.date(2026, 1, 1), dt.date(2026, 12, 31)),
            (3, 3, 21600, 79200, "Weekday", m("5000.00"), m("3000.00"), m("40000.00"), True,
             dt.date(2026, 1, 1), dt.date(2026, 12, 31))],
        "holidays": [],
        "parking_area": [(1, "ZONE-A", None), (2, "ZONE-B", None), (3, "ZONE-C", None)],
        "parking_slot": [(1, 1, "A-01", "Sedan", "Occupied"), (2, 1, "A-02", "Sedan", "Empty"),
                         (3, 1, "A-03", "Sedan", "Maintenance"), (4, 2, "B-01", "SUV", "Occupied"),
                         (5, 2, "B-02", "SUV", "Empty"), (6, 3, "C-01", "Motorbike", "Occupied")],
        "customer": [(1, "Tran Van Hoang", "0988777666"), (2, "Le Thi Mai", "0977666555"),
                     (3, "Pham Minh Duc", "0966555444")],
        "vehicle": [(1, 1, 1, "59A-123.45", "Toyota Vios", "Silver"), (2, 2, 2, "51G-987.65", "Ford Ranger", "Black"),
                    (3, 3, 3, "59P-555.55", "Honda SH 150i", "White")],
        "ticket": [(1, 1, None, None, 3, hours_ago(4), "59A12345", "QR_HASH_TOKEN_XYZ001", "completed", hours_ago(1), 3),
                   (2, 2, None, None, 3, hours_ago(2), "51G98765", "QR_HASH_TOKEN_XYZ002", "active", None, None),
                   (3, 3, None, None, 4, hours_ago(1), "59P55555", "QR_HASH_TOKEN_XYZ003", "active", None, None)],
        "parking_log": [(1, 1, 3, "entry", hours_ago(4)), (2, 1, 3, "exit", hours_ago(1)),
                        (3, 2, 3, "entry", hours_ago(2))],
        "payment": [],
    }
    return ParkingTables.from_mapping(
        {name: spark.createDataFrame(data, SCHEMAS[name]) for name, data in rows.items()})
