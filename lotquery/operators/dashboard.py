"""Operators the reference computes in server code (mark C): the staff
dashboard (A1-A4, J1, S4), the slot grid (A9) and the vehicle-type list (P1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.functions import exprs as X

GRID_ROWS = 5
GRID_COLS = 5


def vehicle_type_list(vehicle_type: DataFrame) -> DataFrame:
    """Id and name ordered by id."""
    return vehicle_type.select(F.col("vehicle_type_id").alias("id"), F.col("type_name").alias("name")).orderBy("id")


def slot_totals(parking_slot: DataFrame) -> DataFrame:
    """A1: total, occupied (status Occupied), available = max(0, total - occupied)
    as the code computes it, and assignable (status Empty).  One fused
    aggregate: one scan instead of the reference's two statements."""
    agg = parking_slot.agg(
        F.count(F.lit(1)).alias("total"),
        X.count_when(F.col("status") == "Occupied").alias("occupied"),
        X.count_when(F.col("status") == "Empty").alias("assignable"))
    return agg.select("total", "occupied", X.floor_zero(F.col("total") - F.col("occupied")).alias("available"),
                      "assignable")


def total_revenue(payment: DataFrame) -> DataFrame:
    """A2: sum of ``amount`` over all payments, 0 when there are none."""
    return payment.agg(X.sum_or_zero("amount").cast("double").alias("total_revenue"))


def ticket_status_counts(ticket: DataFrame) -> DataFrame:
    """A3: count per ticket status."""
    return ticket.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


def payments_on_day(payment: DataFrame, day: str | dt.date) -> DataFrame:
    """A4: for one date, sum of amount (0 when none), count, paid count and
    not-paid count (0 when none).  The day test is a range on the raw column so
    it is pushed to the Parquet scan."""
    today = payment.filter(X.on_day("payment_time", day))
    if "month" in payment.columns:  # month-partitioned storage: prune partitions too
        today = today.filter(F.col("month") == F.trunc(F.lit(str(day)).cast("date"), "month"))
    return today.agg(
        X.sum_or_zero("amount").cast("double").alias("total_amount"),
        F.count(F.lit(1)).alias("transactions"),
        X.count_when(F.col("status") == "paid").alias("paid"),
        X.count_when(F.col("status") != "paid").alias("unpaid"))


def active_tickets(ticket: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Active tickets joined to their vehicle, entry time as text, newest first."""
    active = ticket.filter(F.col("status") == "active").select("ticket_id", "vehicle_id", "entry_time", "status")
    joined = active.join(vehicle.select("vehicle_id", "license_plate"), "vehicle_id")
    return (joined.select("ticket_id", "license_plate", X.time_text("entry_time").alias("entry_time"), "status",
                          F.col("entry_time").alias("_entry_ts"))
            .orderBy(F.col("_entry_ts").desc(), F.col("ticket_id").desc())
            .drop("_entry_ts"))


def decode_slot_code(slot_code: str = "slot_code"):
    """A9 decoding of ``A-01`` style codes into (row, col); null when skipped.

    Rules (reference socket code): null code or no second dash part -> skip;
    row = first char of the trimmed first part, upper-cased, minus 'A', blank
    first part -> 'A'; col = digits of the second part minus 1; no digits or
    overflow -> skip.
    """
    code = F.col(slot_code)
    parts = F.split(code, "-")
    first = X.java_trim(F.get(parts, 0))
    second = F.get(parts, 1)
    # Java split drops trailing empty strings, so "A-" has one part: skip it.
    has_second = F.coalesce(second != "", F.lit(False)) | (F.size(parts) > 2)
    row_char = F.when(first == "", F.lit("A")).otherwise(F.upper(F.substring(first, 1, 1)))
    row = F.ascii(row_char) - F.lit(65)
    col = F.regexp_replace(second, "[^0-9]", "").try_cast("int") - 1
    ok = code.isNotNull() & has_second & col.isNotNull()
    return F.when(ok, row), F.when(ok, col)


def slot_grid(parking_slot: DataFrame, rows: int = GRID_ROWS, cols: int = GRID_COLS) -> DataFrame:
    """Dense rows x cols cells (row, col, occ); occ = 1 iff the slot's status
    equals 'Occupied' ignoring case.  Duplicate cells keep the highest slot_id.

    The filter to in-range cells runs before the shuffle, so at most
    rows x cols groups reach the aggregate; the dense cell list comes from a
    generator on one literal row (rows x cols, fixed), not a join."""
    return grid_cells(grid_members(parking_slot, rows, cols), rows, cols)


def grid_members(parking_slot: DataFrame, rows: int = GRID_ROWS, cols: int = GRID_COLS) -> DataFrame:
    """Slots whose code decodes into the grid: (slot_id, row, col, status)."""
    r, c = decode_slot_code()
    return (parking_slot.select("slot_id", r.alias("row"), c.alias("col"), "status")
            .filter((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols)))


def grid_cells(members: DataFrame, rows: int = GRID_ROWS, cols: int = GRID_COLS) -> DataFrame:
    """Dense (row, col, occ) cells from decoded grid members."""
    cells = (members.select("row", "col", "slot_id",
                            F.when(F.lower(F.col("status")) == "occupied", 1).otherwise(0).alias("occ"))
             .groupBy("row", "col").agg(F.max_by("occ", "slot_id").alias("occ")))
    spark = members.sparkSession
    dense = (spark.range(rows * cols)
             .select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col")))
    return (dense.join(cells, ["row", "col"], "left")
            .select("row", "col", F.coalesce("occ", F.lit(0)).cast("int").alias("occ")))


def grid_json(cells: DataFrame, rows: int = GRID_ROWS, cols: int = GRID_COLS) -> DataFrame:
    """The grid as ``array<array<int>>`` and as compact JSON text,
    one row.  Input is the dense rows x cols cell list (bounded by the grid)."""
    row_arrays = (cells.groupBy("row")
                  .agg(F.array_sort(F.collect_list(F.struct("col", "occ"))).alias("cells"))
                  .select("row", F.transform("cells", lambda s: s["occ"]).alias("occ_row")))
    grid = row_arrays.agg(F.array_sort(F.collect_list(F.struct("row", "occ_row"))).alias("rows"))
    grid = grid.select(F.transform("rows", lambda s: s["occ_row"]).alias("grid"))
    return grid.select("grid", F.to_json("grid").alias("grid_json"))


def grid_of_cells(cells: DataFrame, rows: int = GRID_ROWS, cols: int = GRID_COLS) -> DataFrame:
    """A9 from explicit numbers: (cell_id, row, col, status) as dense cells.
    Cells outside the grid, or without a row or column, are passed over; of
    several the highest cell_id counts."""
    inside = cells.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    return grid_cells(inside.select(F.col("cell_id").alias("slot_id"), "row", "col", "status"), rows, cols)


def dashboard_document(ticket: DataFrame, vehicle: DataFrame, parking_slot: DataFrame, payment: DataFrame,
                       day: str | dt.date) -> DataFrame:
    """The staff dashboard as rows (section, name, ticket_id, license_plate,
    entry_time, status, number): a row for each figure, for each ticket status
    and for each active ticket, in any order.  Nothing is cut or gathered;
    ``dashboard_json`` renders the rows."""
    none = {"ticket_id": F.lit(None).cast("bigint"), "license_plate": F.lit(None).cast("string"),
            "entry_time": F.lit(None).cast("string"), "status": F.lit(None).cast("string")}

    def figures(section: str, df: DataFrame, **columns: str) -> DataFrame:
        pairs = [F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("number")) for name, c in columns.items()]
        return (df.select(F.inline(F.array(*pairs))).withColumns(none)
                .select(F.lit(section).alias("section"), "name", *none, "number"))

    today_row = X.on_day("payment_time", day)
    pay = payment.agg(  # A2 and A4 from one scan of the payments
        X.sum_or_zero("amount").alias("total"),
        F.coalesce(F.sum(F.when(today_row, F.col("amount"))), F.lit(0)).alias("today"),
        X.count_when(today_row).alias("transactions"),
        X.count_when(today_row & (F.col("status") == "paid")).alias("paid"),
        X.count_when(today_row & (F.col("status") != "paid")).alias("unpaid"))
    statuses = ticket_status_counts(ticket).select(
        F.lit("ticketStatus").alias("section"), F.col("status").alias("name"), *[v.alias(k) for k, v in none.items()],
        F.col("cnt").cast("double").alias("number"))
    current = (ticket.filter(F.col("status") == "active").select("ticket_id", "vehicle_id", "entry_time", "status")
               .join(vehicle.select("vehicle_id", "license_plate"), "vehicle_id")
               .select(F.lit("currentTickets").alias("section"), F.lit(None).cast("string").alias("name"), "ticket_id",
                       "license_plate", X.time_text("entry_time").alias("entry_time"), "status",
                       F.lit(None).cast("double").alias("number")))
    return (figures("slots", slot_totals(parking_slot), total="total", occupied="occupied", available="available")
            .unionByName(figures("totalRevenue", pay, totalRevenue="total"))
            .unionByName(statuses).unionByName(current)
            .unionByName(figures("paymentsToday", pay, totalAmount="today", transactions="transactions", paid="paid",
                                 unpaid="unpaid")))


def dashboard_json(rows: DataFrame) -> DataFrame:
    """S4 rows with their JSON text (F13): a figure as {name: number}, a ticket as
    an object with the page's keys (area is always null)."""
    is_ticket = F.col("section") == "currentTickets"
    ticket = F.to_json(F.struct("ticket_id", "license_plate", "entry_time", F.lit(None).cast("string").alias("area"), "status"),
                       {"ignoreNullFields": "false"})
    whole = F.col("number") == F.floor("number")
    number = F.when(whole & ~F.col("name").isin("totalRevenue", "totalAmount"), F.to_json(
        F.create_map(F.coalesce("name", F.lit("")), F.col("number").cast("bigint")))).otherwise(
        F.to_json(F.create_map(F.coalesce("name", F.lit("")), F.col("number"))))
    return rows.withColumn("json", F.when(is_ticket, ticket).otherwise(number))


def slot_summary(parking_slot: DataFrame, parking_area: DataFrame) -> DataFrame:
    """The slot summary in the page's shape, as rows (section, area_code,
    occupied, available, total): one for the facility, one for each zone."""
    counts = (F.count("slot_id").alias("total"), X.count_when(F.col("status") == "Occupied").alias("occupied"))
    per = parking_slot.groupBy("area_id").agg(*counts)
    zones = (parking_area.select("area_id", "area_code").join(per, "area_id", "left")
             .select(F.lit("zone").alias("section"), "area_code", F.coalesce("occupied", F.lit(0)).alias("occupied"),
                     F.coalesce("total", F.lit(0)).alias("total")))
    whole = parking_slot.agg(*counts).select(F.lit("facility").alias("section"), F.lit(None).cast("string").alias("area_code"),
                                             "occupied", "total")
    return whole.unionByName(zones).select(
        "section", "area_code", F.col("occupied").cast("bigint").alias("occupied"),
        X.floor_zero(F.col("total") - F.col("occupied")).cast("bigint").alias("available"), F.col("total").cast("bigint").alias("total"))
