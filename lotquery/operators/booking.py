"""Allocation, booking and registration: J8, J9, J10, W4 and S3.

J9 counts by free gaps instead of joining requests to reservations: no pair of
a request and a slot is ever a row.  J10 sweeps each vehicle's reservations and
arrivals in time order, in two-level scans: a row for each, however long.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotquery.functions import exprs as X
from lotquery.functions.scan import cut_lineage, ordered_scan, quantile_block
from lotquery.sources.sinks import CommitConflict, commit_staged, newest_commit, read_committed

UNAVAILABLE = ("Maintenance", "Locked")


def assignable_slots(parking_slot: DataFrame, slot_type_map: DataFrame, vehicle_type: DataFrame) -> DataFrame:
    """Per vehicle type and zone, Empty slots of a compatible type; types
    without any such slot appear once with a null zone and 0."""
    m = slot_type_map
    per = (parking_slot.filter(F.col("status") == "Empty").select("slot_type", "area_id").join(m, "slot_type")
           .groupBy("vehicle_type_id", "area_id").agg(F.count(F.lit(1)).alias("assignable")))
    types = vehicle_type.select("vehicle_type_id", "type_name")
    return (types.join(per, "vehicle_type_id", "left")
            .select("vehicle_type_id", "type_name", "area_id",
                    F.coalesce("assignable", F.lit(0)).cast("bigint").alias("assignable")))


FAR_PAST, FAR_FUTURE = -(2 ** 62), 2 ** 62


def free_gaps(reservation: DataFrame, slots: DataFrame) -> DataFrame:
    """(vehicle_type_id, slot_id, gap_from, gap_to), in microseconds: the times
    in which a slot of ``slots`` (slot_id, vehicle_type_id) has no confirmed
    reservation, for slots that have any.  A slot's gaps don't overlap."""
    live = (reservation.filter((F.col("state") == "confirmed") & (F.col("from_time") < F.col("to_time")))
            .select("slot_id", "reservation_id", X.micros("from_time").alias("a"), X.micros("to_time").alias("b"))
            .join(slots.select("slot_id").distinct(), "slot_id", "left_semi"))
    # A gap lies before each reservation that starts after all earlier ones of its slot end.
    scanned = ordered_scan(live, ["slot_id"], ["a", "b", "reservation_id"], quantile_block(live, F.col("a")),
                           runs=[("busy_to", "max", "b", False)])
    inner = (scanned.filter(F.col("busy_to").isNull() | (F.col("a") >= F.col("busy_to")))
             .select("slot_id", F.coalesce("busy_to", F.lit(FAR_PAST)).alias("gap_from"), F.col("a").alias("gap_to")))
    last = live.groupBy("slot_id").agg(F.max("b").alias("gap_from")).withColumn("gap_to", F.lit(FAR_FUTURE))
    return inner.unionByName(last).join(slots, "slot_id")


def _compatible(parking_slot: DataFrame, slot_type_map: DataFrame) -> DataFrame:
    return cut_lineage(parking_slot.filter(~F.col("status").isin(*UNAVAILABLE)).select("slot_id", "slot_type")
                       .join(slot_type_map, "slot_type").select("slot_id", "vehicle_type_id"))


def _asked(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", "vehicle_type_id", X.micros("from_time").alias("start"), X.micros("to_time").alias("stop"))


NODE = ["vehicle_type_id", "level", "node"]


def _meetings(asked: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vehicle_type_id, level, node, id, kind, start, stop) of gaps (kind
    0, id a slot) and requests (kind 1): a gap contains a request exactly if they
    meet in one node and the gap starts no later; and all rows by themselves.

    Gap ends and request ends are ranked together per type; a gap with the higher
    rank meets the request in one node of a binary tree over ranks, that of the
    highest bit in which the ranks differ.  Gaps without an end need the starts
    only, and have a node of their own (level -1)."""
    columns = ["vehicle_type_id", "id", "kind", "start", "stop"]
    both = (gaps.select("vehicle_type_id", F.col("slot_id").alias("id"), F.lit(0).alias("kind"),
                        F.col("gap_from").alias("start"), F.col("gap_to").alias("stop"))
            .unionByName(asked.select("vehicle_type_id", F.col("request_id").alias("id"), F.lit(1).alias("kind"), "start", "stop")))
    # Requests come first among equal ends: a gap that ends with the request contains it.
    ended = both.filter((F.col("kind") == 1) | (F.col("stop") < FAR_FUTURE)).withColumn("_order", 1 - F.col("kind"))
    ranked = cut_lineage(ordered_scan(ended, ["vehicle_type_id"], ["stop", "_order", "id", "start"],
                                      quantile_block(ended, F.col("stop")), position="rank").select(*columns, "rank"))
    # Above the highest rank's bits all ranks agree.
    top = ranked.agg(F.coalesce(F.ceil(F.log2(F.max("rank") + 1)), F.lit(1)).cast("int")).scalar()
    levels = F.filter(F.sequence(F.lit(0), F.col("_top") - 1),
                      lambda k: F.bit_get(F.col("rank"), k).cast("int") == 1 - F.col("kind"))
    nodes = ranked.withColumn("_top", top).withColumn("level", F.explode(levels)).select(
        *columns, "level", (F.expr("shiftright(rank, level)") + F.col("kind")).alias("node"))
    open_ended = both.filter((F.col("kind") == 1) | (F.col("stop") == FAR_FUTURE)).select(
        *columns, F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("node"))
    return nodes.unionByName(open_ended), both


def bookable_slots(requests: DataFrame, parking_slot: DataFrame, slot_type_map: DataFrame,
                   reservation: DataFrame) -> DataFrame:
    """For each booking request (type, from < to): how many compatible slots
    (not Maintenance / Locked) exist, how many are blocked by an overlapping
    confirmed reservation, how many are bookable, and the lowest bookable
    slot_id.

    A slot is bookable exactly when one of its free gaps contains the request:
    gap_from <= from and gap_to >= to.  In each node in which they meet, a
    running count and minimum over gap starts answers all its requests.  Work is
    (gaps + requests) x log(ranks), in two-level scans."""
    compat = _compatible(parking_slot, slot_type_map)
    gaps = cut_lineage(free_gaps(reservation, compat))
    asked = _asked(requests)
    rows, both = _meetings(asked, gaps)
    every = rows.withColumns({"gap": 1 - F.col("kind"), "slot": F.when(F.col("kind") == 0, F.col("id"))})
    answered = (ordered_scan(every, NODE, ["start", "kind", "id", "stop"], quantile_block(both, F.col("start")),
                             runs=[("free", "sum", "gap", True), ("first", "min", "slot", True)])
                .filter(F.col("kind") == 1).groupBy(F.col("id").alias("request_id"))
                .agg(F.sum("free").alias("free"), F.min("first").alias("first")))
    # Slots that were never reserved are free for every request of their type.
    never = compat.join(gaps.select("slot_id").distinct(), "slot_id", "left_anti")
    per_type = (compat.groupBy("vehicle_type_id").agg(F.count(F.lit(1)).alias("candidates"))
                .join(never.groupBy("vehicle_type_id").agg(F.count(F.lit(1)).alias("n0"), F.min("slot_id").alias("s0")),
                      "vehicle_type_id", "left"))
    out = (asked.select("request_id", "vehicle_type_id").join(per_type, "vehicle_type_id", "left")
           .join(answered, "request_id", "left"))
    bookable = F.coalesce("free", F.lit(0)) + F.coalesce("n0", F.lit(0))
    candidates = F.coalesce("candidates", F.lit(0))
    return out.select("request_id", "vehicle_type_id", candidates.cast("bigint").alias("candidates"),
                      (candidates - bookable).cast("bigint").alias("blocked"), bookable.cast("bigint").alias("bookable"),
                      F.least("first", "s0").alias("first_slot_id"))


def _lowest(rows: DataFrame, keys: list[str], slot: str, k: int) -> DataFrame:
    """The ``k`` lowest distinct slots of each key, as a sorted list: ranks up to
    ``k`` are cut off in each task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(slot)
    low = rows.select(*keys, slot).distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return low.groupBy(*keys).agg(F.array_sort(F.collect_list(slot)).alias("low"))  # k at most


def _lowest_so_far(k: int):
    """Rows (request or gap, in order within their block) -> (request_id, slots):
    the ``k`` lowest slots among the gaps before each request in its block and
    those of the blocks before, ``low``.  A list of ``k`` slots is the state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, []
        for batch in batches:
            ids, slots = [], []
            columns = [batch.column(c).to_pylist() for c in (*NODE, "_lq_blk", "kind", "id", "low")]
            for *now, kind, i, low in zip(*columns, strict=True):
                if now != key:
                    key, best = now, list(low or ())
                if kind:
                    ids.append(i)
                    slots.append(list(best))
                elif i not in best and (len(best) < k or i < best[-1]):
                    insort(best, i)
                    del best[k:]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(slots, pa.list_(pa.int64()))], names=["request_id", "slots"])
    return run


def bookable_slot_list(requests: DataFrame, parking_slot: DataFrame, slot_type_map: DataFrame,
                       reservation: DataFrame, k: int = 3) -> DataFrame:
    """J9 as (request_id, choice, slot_id): the ``k`` lowest bookable slots of
    each request (choice 1 is the lowest); requests without one have no row.

    The meetings of ``bookable_slots``, but a node's running state is the list of
    the k lowest slots instead of a count and a minimum.  Lists merge: those of
    a node's blocks are cut to k, the blocks before a block give its first state,
    and inside a block one ordered pass carries it.  No row is a pair of a
    request and a slot but the result's k."""
    compat = _compatible(parking_slot, slot_type_map)
    gaps = cut_lineage(free_gaps(reservation, compat))
    asked = _asked(requests)
    rows, both = _meetings(asked, gaps)
    blocked = cut_lineage(quantile_block(both, F.col("start"))(rows))
    lists = _lowest(blocked.filter("kind = 0").withColumnRenamed("id", "slot"), [*NODE, "_lq_blk"], "slot", k)
    blocks = blocked.select(*NODE, "_lq_blk").distinct().join(lists, [*NODE, "_lq_blk"], "left")
    # k slots for each block of a node, as many blocks as shuffle partitions
    before = Window.partitionBy(*NODE).orderBy("_lq_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("low", F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("low").over(before)))), 1, k))
    ready = (blocked.join(carried, [*NODE, "_lq_blk"]).repartition(*NODE, "_lq_blk")
             .sortWithinPartitions(*NODE, "_lq_blk", "start", "kind", "id")
             .select(*NODE, "_lq_blk", "kind", "id", "low"))
    found = ready.mapInArrow(_lowest_so_far(k), "request_id long, slots array<long>").filter(F.size("slots") > 0)
    never = _lowest(compat.join(gaps.select("slot_id").distinct(), "slot_id", "left_anti"), ["vehicle_type_id"], "slot_id", k)
    found = found.unionByName(asked.join(never, "vehicle_type_id").select("request_id", F.col("low").alias("slots")))
    lowest = _lowest(found.select("request_id", F.explode("slots").alias("slot_id")), ["request_id"], "slot_id", k)
    return (lowest.select("request_id", F.posexplode("low").alias("at", "slot_id"))
            .select("request_id", (F.col("at") + 1).alias("choice"), "slot_id"))


def arrival_booking(arrivals: DataFrame, reservation: DataFrame) -> DataFrame:
    """Each arrival with the confirmed reservation of the same vehicle
    whose window [from, to) contains the arrival time (earliest start, then
    lowest id), else a walk-in.

    A sweep: in the order of starts, a reservation is the earliest open one from
    the time when all before it have ended, until its own end; one that ends
    before that never is.  These turns of a vehicle don't overlap, so an
    arrival belongs to the last turn that began by its time, if that still
    goes on.  Two ordered scans, a row for each reservation however long it is."""
    res = (reservation.filter((F.col("state") == "confirmed") & (F.col("from_time") < F.col("to_time")) & F.col("vehicle_id").isNotNull())
           .select("vehicle_id", "reservation_id", X.micros("from_time").alias("a"), X.micros("to_time").alias("b")))
    turns = (ordered_scan(res, ["vehicle_id"], ["a", "reservation_id"], quantile_block(res, F.col("a")), runs=[("ended", "max", "b", False)])
             .withColumn("turn", F.greatest("a", "ended"))  # a null is passed over
             .filter(F.col("b") > F.col("turn")))
    came = arrivals.select("vehicle_id", X.micros("arrival_time").alias("t"), F.lit(1).alias("kind"), F.col("arrival_id").alias("id"),
                           F.lit(None).cast("struct<t: bigint, id: bigint, b: bigint>").alias("last"))
    # At equal times a turn comes before an arrival.
    events = came.filter(F.col("vehicle_id").isNotNull() & F.col("t").isNotNull()).unionByName(
        turns.select("vehicle_id", F.col("turn").alias("t"), F.lit(0).alias("kind"), F.col("reservation_id").alias("id"),
                     F.struct(F.col("turn").alias("t"), F.col("reservation_id").alias("id"), "b").alias("last")))
    swept = ordered_scan(events, ["vehicle_id"], ["t", "kind", "id"], quantile_block(came, F.col("t")),
                         runs=[("open", "max", "last", True)])
    hits = (swept.filter((F.col("kind") == 1) & (F.col("open.b") > F.col("t")))
            .groupBy(F.col("id").alias("arrival_id")).agg(F.min("open.id").alias("reservation_id")))
    return (arrivals.select("arrival_id", "vehicle_id", "arrival_time").join(hits, "arrival_id", "left")
            .select("arrival_id", "vehicle_id", "arrival_time", "reservation_id",
                    F.col("reservation_id").isNotNull().alias("is_booked")))


def assign_slots(arrivals: DataFrame, parking_slot: DataFrame, slot_type_map: DataFrame) -> DataFrame:
    """Batch allocation.  Arrivals of a vehicle type, in (time, id) order,
    take the Empty compatible slots in balancing order: a slot's key is the
    zone's fill ratio after taking it, (occupied + rank among the zone's free
    slots of that type) / zone total, ties by slot_id.  Equal ranks pair up;
    arrivals beyond the free slots go to ``manual``.  All rankings are
    two-level row numbers over blocks of about equal row counts, so a vehicle
    type holding most rows is still spread over many tasks."""
    m = slot_type_map
    zones = parking_slot.groupBy("area_id").agg(F.count(F.lit(1)).alias("zone_total"),
                                                X.count_when(F.col("status") == "Occupied").alias("zone_occupied"))
    free = (parking_slot.filter(F.col("status") == "Empty").select("slot_id", "area_id", "slot_type")
            .join(m, "slot_type"))
    free = ordered_scan(free, ["vehicle_type_id", "area_id"], ["slot_id"], quantile_block(free, F.col("slot_id")),
                        position="zone_rank")
    free = free.join(zones, "area_id").withColumn(
        "fill", (F.col("zone_occupied") + F.col("zone_rank")) / F.col("zone_total"))
    free = ordered_scan(free, ["vehicle_type_id"], ["fill", "slot_id"], quantile_block(free, F.col("fill")), position="rank")
    arr = arrivals.select("arrival_id", "arrival_time", "vehicle_type_id")
    arr = ordered_scan(arr, ["vehicle_type_id"], ["arrival_time", "arrival_id"],
                       quantile_block(arr, X.micros("arrival_time")), position="rank")
    out = arr.join(free.select("vehicle_type_id", "rank", "slot_id", "area_id"), ["vehicle_type_id", "rank"], "left")
    return out.select("arrival_id", "vehicle_type_id", "slot_id", "area_id",
                      F.when(F.col("slot_id").isNotNull(), "assigned").otherwise("manual").alias("outcome"))


def register_drivers(requests: DataFrame, customer: DataFrame, vehicle: DataFrame,
                     vehicle_type: DataFrame) -> DataFrame:
    """S3: batch driver registration; one outcome row per request.

    Checks in the reference's order: plate format (``bad_plate``), customer
    insert with a null name (``missing_name``), vehicle insert hitting the
    unique plate (``duplicate_plate``, compared trimmed and upper-cased) or
    the type foreign key (``unknown_vehicle_type``).  Vehicle type text:
    missing / blank / not an integer -> 1.  Within the batch the first request
    (by request_id) that would succeed takes the plate.  New keys continue
    after the current maximum, in request order; customer and vehicle rows
    are emitted together or not at all (see ``registration_outputs``)."""
    plate_norm = F.upper(X.java_trim("license_plate"))
    vt = X.safe_int("vehicle_type_text", default=1)
    r = requests.select("request_id", "full_name", "phone", "email", "address", "license_plate", plate_norm.alias("plate_norm"),
                        F.coalesce(vt, F.lit(1)).alias("vehicle_type_id"),
                        X.valid_plate("license_plate").alias("plate_ok"))
    types = vehicle_type.select("vehicle_type_id", F.lit(True).alias("type_ok"))
    taken = vehicle.select(F.upper(X.java_trim("license_plate")).alias("plate_norm")).distinct() \
        .withColumn("taken", F.lit(True))
    r = r.join(types, "vehicle_type_id", "left").join(taken, "plate_norm", "left")
    eligible = F.col("plate_ok") & F.col("full_name").isNotNull() & F.col("taken").isNull()
    winners = (r.filter(eligible & F.col("type_ok").isNotNull()).groupBy("plate_norm")
               .agg(F.min("request_id").alias("winner")))
    r = r.join(winners, "plate_norm", "left")
    outcome = (F.when(~F.col("plate_ok"), "bad_plate")
               .when(F.col("full_name").isNull(), "missing_name")
               .when(F.col("taken").isNotNull(), "duplicate_plate")
               .when(F.col("winner") < F.col("request_id"), "duplicate_plate")
               .when(F.col("winner") == F.col("request_id"), "registered")
               .otherwise("unknown_vehicle_type"))
    r = r.withColumn("outcome", outcome).withColumn(
        "_lq_ok", F.when(F.col("outcome") == "registered", 1).otherwise(0))
    # Running count of registered requests in request order = the new key's offset.
    r = ordered_scan(r, [], ["request_id"], quantile_block(requests, F.col("request_id")),
                     runs=[("seq", "sum", "_lq_ok", True)])
    max_c = customer.agg(F.coalesce(F.max("customer_id"), F.lit(0))).scalar()
    max_v = vehicle.agg(F.coalesce(F.max("vehicle_id"), F.lit(0))).scalar()
    ok = F.col("_lq_ok") == 1
    return r.select("request_id", "outcome", F.when(ok, max_c + F.col("seq")).alias("customer_id"),
                    F.when(ok, max_v + F.col("seq")).alias("vehicle_id"), "full_name", "phone", "email", "address",
                    "license_plate", "vehicle_type_id")


def registration_outputs(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Split S3 outcomes into the new customer rows, new vehicle rows and
    rejects.  The outcomes are stored first, so the three outputs are read from
    one run of the registration plan; ``sinks.write_staged`` commits them together."""
    outcomes = cut_lineage(outcomes)
    ok = outcomes.filter(F.col("outcome") == "registered")
    return {
        "new_customer": ok.select("customer_id", F.col("full_name").alias("name"), "phone", "email", "address"),
        "new_vehicle": ok.select("vehicle_id", "customer_id", "vehicle_type_id", "license_plate"),
        "rejects": outcomes.filter(F.col("outcome") != "registered").select("request_id", "outcome"),
    }


def register_batch(spark: SparkSession, requests: DataFrame, customer: DataFrame, vehicle: DataFrame,
                   vehicle_type: DataFrame, root: str, attempts: int = 20) -> dict[str, str]:
    """S3 as a transaction: register ``requests`` on top of the base tables and
    all batches committed under ``root``, and commit the outcome as the next batch.

    Batches may run at the same time.  Each computes its keys and checks its
    plates against the commits it has seen, n of them; only one can make commit
    n + 1, which reserves its key range and plates.  The others see the newer
    state and compute again, so keys and plates stay unique.  Returns the paths
    of the committed outputs."""
    for _ in range(attempts):
        seen = newest_commit(spark, root)
        held = {"new_customer": customer.select("customer_id"), "new_vehicle": vehicle.select("vehicle_id", "license_plate")}
        for name, base in held.items():
            new = read_committed(spark, root, name, seen)
            if new is not None:
                held[name] = base.unionByName(new.select(*base.columns))
        outcomes = register_drivers(requests, held["new_customer"], held["new_vehicle"], vehicle_type)
        try:
            return commit_staged(spark, registration_outputs(outcomes), root, seen)
        except CommitConflict:
            continue
    raise CommitConflict(f"no commit under {root} in {attempts} attempts")
