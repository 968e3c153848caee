"""Every registered query equals its DuckDB oracle on the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from lotquery.plans.catalog import ORACLES, QUERIES, load_all  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"
load_all()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= E.queries().items() and ORACLES.items() <= E.oracle_sql().items()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["ticket_id", "license_plate", "entry_time", "status"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert digest(got) == digest(want)


def test_dashboard_holds_every_active_ticket(spark):
    """S4 against the separately checked A1-A4 and J1 queries."""
    rows = QUERIES["dashboard_document"](spark, SF).collect()
    figures = {(r.section, r.name): r.number for r in rows if r.section != "currentTickets"}
    totals = QUERIES["slot_totals"](spark, SF).first().asDict()
    assert all(figures["slots", k] == totals[k] for k in ("total", "occupied", "available"))
    assert figures["totalRevenue", "totalRevenue"] == QUERIES["total_revenue"](spark, SF).first()["total_revenue"]
    today = QUERIES["payments_on_day"](spark, SF).first().asDict()
    assert [figures["paymentsToday", k] for k in ("totalAmount", "transactions", "paid", "unpaid")] == [
        today[k] for k in ("total_amount", "transactions", "paid", "unpaid")]
    assert {n: v for (s, n), v in figures.items() if s == "ticketStatus"} == {
        r["status"]: r["cnt"] for r in QUERIES["ticket_status_counts"](spark, SF).collect()}
    current = sorted(tuple(r)[2:6] for r in rows if r.section == "currentTickets")
    assert current == sorted(map(tuple, QUERIES["active_tickets"](spark, SF).collect())) and len(current) > 50
