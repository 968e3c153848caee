"""Plan shape (no nested-loop or cartesian joins, pushdown reaches the scan)
and the source / sink helpers."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lotquery.operators import dashboard as dash
from lotquery.sources.sinks import export_report, write_staged
from lotquery.sources.tables import SCHEMAS, load_tables

from lotquery.plans.catalog import QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"
STREAMING = {"live_slot_grid", "live_volumes", "live_transition_check", "overstay_alerts",
             "reservation_expiry", "lockout_alerts"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_nested_loop_or_cartesian(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, plan


def test_payment_day_filter_is_pushed_down(spark, tmp_path):
    from lotquery.sources.derive import derive_tables
    t = derive_tables(spark, SF)
    path = str(tmp_path / "payment")
    t.payment.write.parquet(path)
    pay = spark.read.schema(SCHEMAS["payment"]).parquet(path)
    plan = _plan(dash.payments_on_day(pay, "1998-04-25"))
    assert "PushedFilters: [IsNotNull(payment_time), GreaterThanOrEqual(payment_time" in plan, plan


def test_load_tables_roundtrip_and_export(spark, small_tables, tmp_path):
    root = str(tmp_path / "canon")
    for name in ("ticket", "vehicle"):
        getattr(small_tables, name).write.parquet(f"{root}/{name}")
    loaded = load_tables(spark, root, names=["ticket", "vehicle"])
    assert loaded.ticket.count() == small_tables.ticket.count()
    assert loaded.ticket.schema.fieldNames() == SCHEMAS["ticket"].fieldNames()
    out = str(tmp_path / "report")
    rep = small_tables.ticket.select("ticket_id", F.to_date("entry_time").alias("d"))
    export_report(rep, out, "d")
    assert spark.read.parquet(out).count() == rep.count()
    assert any(p.startswith("d=") for p in os.listdir(out))


def test_write_staged_commits_all(spark, tmp_path):
    from lotquery.sources.sinks import read_staged
    paths = write_staged(spark, {"a": spark.range(3), "b": spark.range(5)}, str(tmp_path / "st"))
    assert spark.read.parquet(paths["a"]).count() == 3 and spark.read.parquet(paths["b"]).count() == 5
    got = read_staged(spark, str(tmp_path / "st"))
    assert got["a"].count() == 3 and got["b"].count() == 5
    spark.range(2).write.parquet(str(tmp_path / "half" / "a"))  # outputs without a commit
    with pytest.raises(RuntimeError):
        read_staged(spark, str(tmp_path / "half"))


def test_a_failed_batch_leaves_the_one_before(spark, tmp_path):
    from pyspark.sql import functions as F
    from lotquery.sources.sinks import read_staged
    root = str(tmp_path / "st")
    write_staged(spark, {"a": spark.range(1), "b": spark.range(2)}, root)
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        write_staged(spark, {"a": spark.range(5), "b": broken}, root)
    got = read_staged(spark, root)
    assert got["a"].count() == 1 and got["b"].count() == 2
    write_staged(spark, {"a": spark.range(7), "b": spark.range(8)}, root)
    assert read_staged(spark, root)["a"].count() == 7


def test_registration_outputs_staged(spark, small_tables, tmp_path):
    from lotquery.operators import booking
    from lotquery.sources.sinks import read_staged
    out = booking.register_drivers(small_tables.registration_requests, small_tables.customer,
                                   small_tables.vehicle, small_tables.vehicle_type)
    write_staged(spark, booking.registration_outputs(out), str(tmp_path / "reg"))
    got = read_staged(spark, str(tmp_path / "reg"))
    assert got["new_customer"].count() == got["new_vehicle"].count() > 0
    assert got["new_customer"].count() + got["rejects"].count() == small_tables.registration_requests.count()


def test_bucketed_canonical_tables_join_without_shuffle(spark, small_tables, tmp_path):
    from lotquery.sources.sinks import write_canonical_tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = write_canonical_tables(spark, small_tables, str(tmp_path / "canon"), names=["ticket", "payment"],
                                        buckets={"ticket": ("ticket_id", 8), "payment": ("ticket_id", 8)},
                                        partition_by_month=False)
        j = stored["ticket"].join(stored["payment"].drop("status"), "ticket_id")
        plan = _plan(j)
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert j.count() == small_tables.payment.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_month_partitions_prune(spark, small_tables, tmp_path):
    from lotquery.sources.sinks import write_canonical_tables
    stored = write_canonical_tables(spark, small_tables, str(tmp_path / "canon2"), names=["payment"])
    pay = stored["payment"]
    q = pay.filter(F.col("month") == F.lit("1998-04-01").cast("date"))
    assert "PartitionFilters: [isnotnull(month" in _plan(q)
    assert q.count() == small_tables.payment.filter(
        (F.col("payment_time") >= "1998-04-01") & (F.col("payment_time") < "1998-05-01")).count()


def test_payments_on_day_uses_month_partition(spark, small_tables, tmp_path):
    from lotquery.sources.sinks import write_canonical_tables
    pay = write_canonical_tables(spark, small_tables, str(tmp_path / "canon3"), names=["payment"])["payment"]
    got = dash.payments_on_day(pay, "1998-04-25")
    assert "PartitionFilters: [isnotnull(month" in _plan(got)
    assert got.first().asDict() == dash.payments_on_day(small_tables.payment, "1998-04-25").first().asDict()


def test_recommended_conf_scales_with_input():
    from lotquery.session import recommended_conf
    big = recommended_conf(100 * 1024 ** 4, 8000)
    small = recommended_conf(10 * 1024 ** 2, 8)
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 * 1024)


def test_vehicle_bucketing_removes_j1_shuffle(spark, small_tables, tmp_path):
    """README claim: bucketing ticket and vehicle on vehicle_id makes J1's join shuffle-free."""
    from lotquery.sources.sinks import write_canonical_tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = write_canonical_tables(spark, small_tables, str(tmp_path / "canon4"), names=["ticket", "vehicle"],
                                        buckets={"ticket": ("vehicle_id", 8), "vehicle": ("vehicle_id", 8)},
                                        partition_by_month=False)
        joined = stored["ticket"].filter(F.col("status") == "active").join(
            stored["vehicle"].select("vehicle_id", "license_plate"), "vehicle_id")
        plan = _plan(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        got = dash.active_tickets(stored["ticket"], stored["vehicle"])
        assert got.count() == dash.active_tickets(small_tables.ticket, small_tables.vehicle).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_command_line(spark, capsys, tmp_path):
    from lotquery.__main__ import main
    assert main(["list"]) == 0
    assert "occupancy_profile" in capsys.readouterr().out.split()
    out = str(tmp_path / "zones")
    assert main(["run", "zone_summary", SF, "--out", out]) == 0
    assert spark.read.parquet(out).count() == 25
    assert main(["explain", "slot_totals", SF]) == 0
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", SF])


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def _shuffled(spark, df):
    """Largest number of rows in one exchange of the plan that ran."""
    import re
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text, re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)


def test_recent_activity_shuffles_no_fact(spark, small_tables, no_broadcast):
    from lotquery.operators import reports
    from lotquery.plans.catalog import tables_for
    t = tables_for(spark, SF)  # stored tables, so the plan is the operator's own
    text, exchanges = _shuffled(spark, reports.recent_activity(t.parking_log, t.ticket, t.vehicle, t.parking_slot,
                                                               t.parking_area, "2001-08-05 00:00:00"))
    assert "SortMergeJoin" not in text and "LeftSemi" in text


def test_scans_reduce_tickets_before_grouping(spark, small_tables, no_broadcast):
    from lotquery.operators import audit
    plan = audit.ticket_scan_check(small_tables.scans, small_tables.ticket)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    group = next(i for i, x in enumerate(lines) if "Aggregate [qr_code" in x and "max(ticket_id" in x)
    semi = next(i for i, x in enumerate(lines) if "Join LeftSemi" in x)
    assert group < semi  # the semi-join is below the aggregate


def test_orphan_references_are_counted_before_the_join(spark, small_tables, no_broadcast):
    from lotquery.operators import audit
    plan = audit.orphan_audit(small_tables)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    join = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x and "parent" in x)
    counted = next(i for i, x in enumerate(lines) if "Aggregate [fk" in x and "parent" in x and "key" in x)
    assert join < counted


def test_duplicate_sessions_count_vehicles_first(spark, small_tables, no_broadcast):
    from lotquery.operators import audit
    plan = audit.duplicate_active_sessions(small_tables.ticket, small_tables.vehicle)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [vehicle_id" in plan


def test_planning_starts_no_job(spark, small_tables):
    from lotquery.operators import pricing, reports
    t = small_tables
    fresh = spark.range(10)  # materialize nothing of the fixture
    fresh.count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        pricing.parking_fee(t.ticket, t.vehicle, t.vehicle_type, t.pricing_rules, t.holidays, "2001-08-05 00:00:00")
        reports.exception_report(t, 2880, "2001-08-05 00:00:00")
        assert list(tracker.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_quantile_blocks_follow_rows_not_ids(spark):
    from pyspark.sql import functions as F
    from lotquery.functions.scan import ordered_scan, quantile_block
    for step in (1, 1_000_003):  # dense, sparse
        df = spark.range(0, 1500 * step, step).repartition(7)
        sizes = [r["count"] for r in quantile_block(df, F.col("id"), 8)(df).groupBy("_lq_blk").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 1500 / 8
        got = ordered_scan(df, [], ["id"], quantile_block(df, F.col("id"), 8), position="p").collect()
        assert all(r.p == r.id // step + 1 for r in got)


def test_cluster_needs_a_checkpoint_folder(monkeypatch):
    from types import SimpleNamespace
    from lotquery import session as S
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda p: None)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(fake)
    context.getCheckpointDir = lambda: "hdfs://name/ckpt"
    assert S.scratch_path(fake, "x").startswith("hdfs://name/ckpt/lotquery/x-")
    assert S.is_local_master("local[4]") and S.is_local_master("local") and not S.is_local_master("local-cluster[1,1,1]")


def test_library_sets_no_master():
    import inspect
    from lotquery import __main__ as cli, session as S
    assert inspect.signature(S.build_session).parameters["master"].default is None
    assert "master" not in inspect.getsource(cli.main).replace("__main__", "")


def test_changed_files_are_derived_again(spark, tmp_path):
    import shutil
    from lotquery.plans import catalog
    folder = tmp_path / "sf"
    folder.mkdir()
    for name in os.listdir(SF):  # without the source's read-only modes
        shutil.copyfile(f"{SF}/{name}", folder / name)
    first = catalog.tables_for(spark, str(folder))
    assert catalog.tables_for(spark, str(folder)) is first
    shutil.copyfile(f"{SF}/supplier.parquet", folder / "nation-copy.parquet")
    spark.read.parquet(f"{SF}/supplier.parquet").limit(3).toPandas().to_parquet(folder / "supplier.parquet")
    again = catalog.tables_for(spark, str(folder))
    assert again is not first and again.staff.count() == 3
