"""Data-quality and integrity operators: P2-P7, J2, J3, J6, J7, J11, J12."""

from __future__ import annotations

import datetime as dt
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotquery.functions import exprs as X
from lotquery.sources.tables import ParkingTables

# Fixed domains from the reference schema comments (plus 'Locked', SURVEY 0.1 #4).
ROLES = ("admin", "manager", "attendant")
STAFF_STATUSES = ("active", "inactive")
SLOT_STATUSES = ("Empty", "Reserved", "Occupied", "Maintenance", "Locked")
DAY_TYPES = ("Weekday", "Weekend", "Holiday")
TICKET_STATUSES = ("active", "completed", "lost", "canceled")
LOG_ACTIONS = ("entry", "exit")
PAYMENT_STATUSES = ("paid", "unpaid", "refunded")


def plate_audit(vehicle: DataFrame) -> DataFrame:
    """Validity of every registered plate."""
    return vehicle.select("vehicle_id", "license_plate", X.valid_plate("license_plate").alias("is_valid"))


def unsafe_text_audit(df: DataFrame, key: str, column: str, max_len: int) -> DataFrame:
    """Rows whose text fails the reference's login-input rule, with the reason."""
    reason = X.unsafe_text_reason(column, max_len)
    return (df.select(F.col(key), F.col(column).alias("value"), reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))


def staff_eligibility(staff: DataFrame) -> DataFrame:
    """active = trimmed status equals 'active' ignoring case; role folded to
    lower case (unknown -> null); access 'full' (admin), 'staff', or 'denied'
    (inactive or unknown role)."""
    folded = F.lower(X.java_trim("role"))
    role = F.when(folded.isin(*ROLES), folded)
    active = F.coalesce(F.lower(X.java_trim("status")) == "active", F.lit(False))
    access = (F.when(~active | role.isNull(), F.lit("denied"))
              .when(role == "admin", F.lit("full")).otherwise(F.lit("staff")))
    return staff.select("staff_id", "name", role.alias("role"), active.alias("is_active"), access.alias("access"))


def _bad(ok: F.Column) -> F.Column:
    """Rows where the domain rule ``ok`` is false or unknown."""
    return X.count_when(~F.coalesce(ok, F.lit(False)))


def domain_audit(t: ParkingTables) -> DataFrame:
    """P5: per table and column, rows outside the declared domain or length.
    One conditional aggregate per table (one scan each), then a union."""
    def checks(df: DataFrame, table: str, rules: dict[str, F.Column]) -> DataFrame:
        agg = df.agg(*[_bad(cond).alias(col) for col, cond in rules.items()])
        stacked = ", ".join(f"'{c}', `{c}`" for c in rules)
        return agg.select(F.lit(table).alias("table_name"),
                          F.expr(f"stack({len(rules)}, {stacked}) AS (column_name, bad_rows)"))

    length_ok = lambda c, n: F.col(c).isNotNull() & (F.length(c) <= n)
    parts = [
        checks(t.staff, "staff", {"name": length_ok("name", 100),
                                  "role": F.col("role").isin(*ROLES),
                                  "status": F.col("status").isin(*STAFF_STATUSES)}),
        checks(t.vehicle, "vehicle", {"license_plate": length_ok("license_plate", 20)}),
        checks(t.parking_slot, "parking_slot", {"slot_code": length_ok("slot_code", 10),
                                                "status": F.col("status").isin(*SLOT_STATUSES)}),
        checks(t.pricing_rules, "pricing_rules", {"day_type": F.col("day_type").isin(*DAY_TYPES)}),
        checks(t.ticket, "ticket", {"status": F.col("status").isin(*TICKET_STATUSES),
                                    "qr_code": length_ok("qr_code", 255)}),
        checks(t.parking_log, "parking_log", {"action": F.col("action").isin(*LOG_ACTIONS)}),
        checks(t.payment, "payment", {"status": F.col("status").isin(*PAYMENT_STATUSES)}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "column_name", F.col("bad_rows").cast("bigint"))


def search(vehicle: DataFrame, parking_slot: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring search over plates and slot codes."""
    needle = F.lit(term.lower())
    plates = vehicle.filter(F.lower("license_plate").contains(needle)).select(
        F.lit("vehicle").alias("kind"), F.col("vehicle_id").alias("id"), F.col("license_plate").alias("label"))
    slots = parking_slot.filter(F.lower("slot_code").contains(needle)).select(
        F.lit("slot").alias("kind"), F.col("slot_id").alias("id"), F.col("slot_code").alias("label"))
    return plates.unionByName(slots)


GRAM = 3
SEARCH_BUCKETS = 256


def build_search_index(vehicle: DataFrame, parking_slot: DataFrame, path: str, buckets: int = SEARCH_BUCKETS) -> None:
    """P6's index: inverted lists of the three-letter grams of all labels (lower
    case), rows (gram, kind, id, label) in folders by the gram's hash, sorted by
    gram within files."""
    labels = search(vehicle, parking_slot, "").withColumn("text", F.lower("label"))
    starts = F.sequence(F.lit(1), F.length("text") - GRAM + 1)
    grams = (labels.filter(F.length("text") >= GRAM)
             .withColumn("gram", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("text", i, F.lit(GRAM)))))))
    (grams.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int"))
     .select("gram", "kind", "id", "label", "bucket").repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
     .sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path))


def search_indexed(spark: SparkSession, path: str, term: str, buckets: int = SEARCH_BUCKETS) -> DataFrame:
    """P6 by the index at ``path``: the labels on the lists of all of the term's
    grams, then verified.  Only the grams' folders are read.  A term of less than
    three letters has no gram; search the tables for it (``search``)."""
    needle = term.lower()
    grams = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
    if not grams:
        raise ValueError(f"the index answers terms of {GRAM} letters or more")
    folders = sorted({zlib.crc32(g.encode()) % buckets for g in grams})
    lists = (spark.read.schema("gram string, kind string, id long, label string, bucket int").parquet(path)
             .filter(F.col("bucket").isin(folders) & F.col("gram").isin(grams) & F.lower("label").contains(needle)))
    return (lists.groupBy("kind", "id", "label").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == len(grams)).select("kind", "id", "label"))


def retention_filter(df: DataFrame, ts_col: str, days: int, as_of: str | dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Split rows into (keep, expired) by age; null times are kept.  The
    cut-off is a literal, so the predicate prunes date-partitioned tables."""
    cutoff = X.ts_lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    expired = F.coalesce(F.col(ts_col) < cutoff, F.lit(False))
    return df.filter(~expired), df.filter(expired)


# (fk name, child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("vehicle.customer_id", "vehicle", "customer_id", "customer", "customer_id"),
    ("vehicle.vehicle_type_id", "vehicle", "vehicle_type_id", "vehicle_type", "vehicle_type_id"),
    ("parking_slot.area_id", "parking_slot", "area_id", "parking_area", "area_id"),
    ("pricing_rules.vehicle_type_id", "pricing_rules", "vehicle_type_id", "vehicle_type", "vehicle_type_id"),
    ("ticket.vehicle_id", "ticket", "vehicle_id", "vehicle", "vehicle_id"),
    ("ticket.slot_id", "ticket", "slot_id", "parking_slot", "slot_id"),
    ("ticket.check_in_by", "ticket", "check_in_by", "staff", "staff_id"),
    ("ticket.check_out_by", "ticket", "check_out_by", "staff", "staff_id"),
    ("parking_log.ticket_id", "parking_log", "ticket_id", "ticket", "ticket_id"),
    ("parking_log.staff_id", "parking_log", "staff_id", "staff", "staff_id"),
    ("payment.ticket_id", "payment", "ticket_id", "ticket", "ticket_id"),
    ("payment.payment_method_id", "payment", "payment_method_id", "payment_method", "payment_method_id"),
]


def orphan_audit(t: ParkingTables) -> DataFrame:
    """Per foreign key, child rows whose (non-null) key has no parent.

    Each child table is scanned once: its foreign keys become (fk, parent, key)
    rows, counted per key before any join, so a key that most rows hold is one
    row.  One join against the union of all parent keys (tagged by parent
    table) finds the orphans, whose counts are summed.  Null keys are allowed."""
    children, parents = {}, {}
    for fk, child, ccol, parent, pcol in FOREIGN_KEYS:
        children.setdefault(child, []).append((fk, parent, ccol))
        parents.setdefault(parent, pcol)
    refs = None
    for child, items in children.items():
        arr = F.array(*[F.struct(F.lit(fk).alias("fk"), F.lit(parent).alias("parent"),
                                 F.col(ccol).cast("bigint").alias("key")) for fk, parent, ccol in items])
        part = getattr(t, child).select(F.inline(arr)).filter(F.col("key").isNotNull())
        refs = part if refs is None else refs.unionByName(part)
    keys = None
    for parent, pcol in parents.items():
        part = getattr(t, parent).select(F.lit(parent).alias("parent"), F.col(pcol).cast("bigint").alias("key"))
        keys = part if keys is None else keys.unionByName(part)
    # A left outer join + null test, not "left_anti": the optimizer pushes an
    # anti join below the union (one join per child table, each shuffling all
    # parent keys); an outer join stays one join, one shuffle per side.
    counted = refs.groupBy("fk", "parent", "key").agg(F.count(F.lit(1)).alias("n"))
    parents_present = keys.distinct().withColumn("_lq_hit", F.lit(True))
    orphans = (counted.join(parents_present, ["parent", "key"], "left").filter(F.col("_lq_hit").isNull())
               .groupBy("fk").agg(F.sum("n").alias("orphan_rows")))
    spark = refs.sparkSession
    all_fks = spark.createDataFrame([(fk,) for fk, *_ in FOREIGN_KEYS], "fk string")
    return (all_fks.join(orphans, "fk", "left")
            .select("fk", F.coalesce("orphan_rows", F.lit(0)).cast("bigint").alias("orphan_rows")))


def unique_audit(t: ParkingTables) -> DataFrame:
    """Groups breaking the unique rules (staff name, plate, ticket QR)."""
    def dup(df: DataFrame, rule: str, column: str) -> DataFrame:
        return (df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > 1).select(F.lit(rule).alias("rule"), F.col("key").cast("string"), "n"))
    return (dup(t.staff, "staff.name", "name")
            .unionByName(dup(t.vehicle, "vehicle.license_plate", "license_plate"))
            .unionByName(dup(t.ticket, "ticket.qr_code", "qr_code")))


def pair_log_events(parking_log: DataFrame) -> DataFrame:
    """Per ticket, first entry and last exit from the log, whole minutes
    between them and the anomaly, if any (partial aggregation: skew-safe)."""
    per = parking_log.groupBy("ticket_id").agg(
        F.min(F.when(F.col("action") == "entry", F.col("action_time"))).alias("entry_time"),
        F.max(F.when(F.col("action") == "exit", F.col("action_time"))).alias("exit_time"),
        X.count_when(F.col("action") == "entry").alias("entries"),
        X.count_when(F.col("action") == "exit").alias("exits"))
    anomaly = (F.when((F.col("exits") > 0) & (F.col("entries") == 0), F.lit("exit_without_entry"))
               .when((F.col("entries") > 0) & (F.col("exits") == 0), F.lit("entry_without_exit"))
               .when(F.col("exit_time") < F.col("entry_time"), F.lit("exit_before_entry")))
    return per.select("ticket_id", "entry_time", "exit_time",
                      X.minutes_between("entry_time", "exit_time").alias("minutes"), anomaly.alias("anomaly"))


def duplicate_active_sessions(ticket: DataFrame, vehicle: DataFrame) -> DataFrame:
    """One row per active ticket whose normalised plate has more than one
    active session, with the group size.  Sessions are counted per vehicle,
    then per plate; tickets join the vehicles of repeated plates only."""
    active = ticket.filter(F.col("status") == "active").select("ticket_id", "vehicle_id")
    per_vehicle = (active.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("c"))
                   .join(vehicle.select("vehicle_id", X.plate_key("license_plate").alias("plate")), "vehicle_id"))
    repeated = per_vehicle.groupBy("plate").agg(F.sum("c").alias("n")).filter(F.col("n") > 1)
    vehicles = per_vehicle.join(repeated, "plate").select("vehicle_id", "plate", "n")
    return active.join(vehicles, "vehicle_id").select("plate", "ticket_id", "n")


VERDICTS = {"active": "ok", "completed": "used", "lost": "lost", "canceled": "canceled"}


def ticket_scan_check(scans: DataFrame, ticket: DataFrame) -> DataFrame:
    """Classify presented QR codes; a code shared by several tickets
    resolves to the highest ticket_id.  Tickets are reduced to the scanned codes
    before they are grouped, so few scans move few tickets."""
    codes = scans.select("qr_code").distinct()
    per_code = ticket.select("qr_code", "ticket_id", "status").join(codes, "qr_code", "left_semi").groupBy("qr_code").agg(F.max("ticket_id").alias("ticket_id"),
                                             F.max_by("status", "ticket_id").alias("ticket_status"))
    verdict = F.lit("unknown")
    for status, word in reversed(list(VERDICTS.items())):
        verdict = F.when(F.col("ticket_status") == status, F.lit(word)).otherwise(verdict)
    return (scans.join(per_code, "qr_code", "left")
            .select("scan_id", "qr_code", "ticket_id", verdict.alias("verdict")))


def slot_reconciliation(parking_slot: DataFrame, ticket: DataFrame) -> DataFrame:
    """Slots whose status disagrees with the open sessions."""
    live = (ticket.filter((F.col("status") == "active") & F.col("slot_id").isNotNull())
            .groupBy("slot_id").agg(F.count(F.lit(1)).alias("active_sessions")))
    joined = parking_slot.select("slot_id", "status").join(live, "slot_id", "full_outer")
    n = F.coalesce(F.col("active_sessions"), F.lit(0))
    issue = (F.when(F.col("status").isNull(), F.lit("unknown_slot"))
             .when((F.col("status") == "Occupied") & (n == 0), F.lit("occupied_without_session"))
             .when((F.col("status") != "Occupied") & (n > 0), F.lit("session_on_free_slot")))
    return (joined.select("slot_id", "status", n.cast("bigint").alias("active_sessions"), issue.alias("issue"))
            .filter(F.col("issue").isNotNull()))
