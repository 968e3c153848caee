import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from lotquery.session import REQUIRED_CONF, ensure_checkpoint_dir

    builder = (SparkSession.builder.master("local[*]").appName("lotquery-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lotquery-test-ckpt-"))
               .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="lotquery-test-warehouse-")))
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_tables(spark):
    from lotquery.sources.derive import derive_tables
    return derive_tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def seeds(spark):
    import datetime as dt
    from lotquery.sources.tables import seed_tables
    return seed_tables(spark, dt.datetime(2026, 5, 6, 12, 0, 0))
