"""Session helpers: configuration suited to large clusters, local defaults for tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every lotquery job relies on.  Timestamps are TIMESTAMP_NTZ end to end;
# the few places that must pass through TIMESTAMP (streaming watermarks) need a
# fixed session zone so the round trip is the identity.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "lotquery", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings lotquery relies on.  Without ``master`` the
    submitted one holds (``spark-submit --master ...``), and so does the
    cluster's sizing; tests and the bench give a local master and sizes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**REQUIRED_CONF, "spark.ui.enabled": "false",
                       "spark.sql.execution.arrow.pyspark.enabled": "true", **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


MB = 1024 * 1024


def recommended_conf(input_bytes: int, total_cores: int, target_partition_mb: int = 256) -> dict[str, str]:
    """Sizing for a cluster run: enough shuffle partitions that each holds
    about ``target_partition_mb`` of the largest shuffle (taken as the input
    size) and at least two per core; scan splits of 256 MB above 1 TB of
    input; AQE targets the same partition size and splits skewed partitions
    above 4x that.  Example: 100 TB on 8,000 cores -> 409,600 shuffle
    partitions (AQE coalesces the small ones at run time)."""
    target = target_partition_mb * MB
    partitions = max(2 * total_cores, -(-int(input_bytes) // target))
    split = 256 * MB if input_bytes > 1024 ** 4 else 128 * MB
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def ensure_session_conf(spark: SparkSession) -> None:
    """Apply the settings lotquery depends on to an existing session."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a shared file system path set by the operator (the
    context picks it up at start); an unset value there is an error, because
    executors would write to machine-local folders that readers cannot see.
    Only on a local master with nothing set, as in tests, do we use a fresh
    local temp folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not is_local_master(sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set on master {sc.master!r}: "
                               "name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lotquery-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def is_local_master(master: str) -> bool:
    """True for ``local`` and ``local[...]``: driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique folder below the shared checkpoint folder for staged outputs and
    streaming state.  The URI scheme is kept, so the path means the same on
    every machine whatever the default file system is."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/lotquery/{name}-{uuid.uuid4().hex}"
