"""S5 ``export_report`` and staged (all-or-nothing) multi-output writes."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotquery.session import scratch_path


def export_report(df: DataFrame, path: str, partition_col: str | None = None, fmt: str = "parquet",
                  mode: str = "overwrite", replace: str = "partitions") -> None:
    """Write a report, partitioned by its date column so later readers prune
    partitions.  The write is distributed: each task writes its own files.

    Overwriting a partitioned report replaces the partitions that ``df`` has rows
    of and leaves the others (a rerun for one day replaces that day);
    ``replace="all"`` replaces the whole folder."""
    if replace not in ("partitions", "all"):
        raise ValueError(f"replace must be 'partitions' or 'all', not {replace!r}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_col:
        writer = writer.partitionBy(partition_col).option(
            "partitionOverwriteMode", "dynamic" if replace == "partitions" else "static")
    writer.save(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if there is no such path.  Other
    errors are raised."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where) if s.isDirectory())


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in ``path``; none if there is no such path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where) if s.isFile())


def file_states_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, length and time of change of the files at ``paths`` (files, or
    folders of files)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(conf)
        if system.exists(where):
            out += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in system.listStatus(where)]
    return tuple(sorted(out))


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class CommitConflict(RuntimeError):
    """Another writer made the commit that this one wanted to make."""


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with ``text``, whole and at once; False if there
    already is one.  Of several writers one succeeds: a hard link on a local
    file system, elsewhere a rename that doesn't overwrite, which HDFS and
    file systems like it do atomically."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    target = system.makeQualified(target)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    finally:
        system.delete(draft, False)
    return True


def newest_commit(spark: SparkSession, root: str) -> int:
    """Number of the newest commit under ``root``; 0 if there is none."""
    return max((int(n.removesuffix(".json")) for n in files(spark, f"{root.rstrip('/')}/_commits") if n.endswith(".json")), default=0)


def commit_staged(spark: SparkSession, outputs: dict[str, DataFrame], root: str, after: int | None = None) -> dict[str, str]:
    """Write several outputs so readers see all of them or none.

    Each batch has a folder of its own, ``root/batch-<id>/<name>``; last a
    commit that names its paths is made as ``root/_commits/<number>.json``.
    A batch that fails on the way leaves the commits before it as they were
    (the reference gets the same from a DB transaction).  Task retries and lost
    executors are handled by Spark's output committer.

    ``after``: the newest commit that the outputs were computed from.  If another
    writer has made the next one meanwhile, nothing is committed and
    ``CommitConflict`` is raised; the caller computes again from the newer state.
    Without it the outputs don't depend on earlier ones and take the next free number."""
    root = root.rstrip("/")
    batch = f"{root}/batch-{uuid.uuid4().hex}"
    paths = {name: f"{batch}/{name}" for name in outputs}
    for name, df in outputs.items():
        df.write.parquet(paths[name])
    number = 1 + (newest_commit(spark, root) if after is None else after)
    while not _publish(spark, f"{root}/_commits/{number:012d}.json", json.dumps(paths)):
        if after is not None:
            delete_folder(spark, batch)
            raise CommitConflict(f"commit {number} under {root} was made by another writer")
        number += 1
    return paths


def write_staged(spark: SparkSession, outputs: dict[str, DataFrame], root: str) -> dict[str, str]:
    """``commit_staged`` of outputs that don't depend on earlier commits."""
    return commit_staged(spark, outputs, root)


def commits(spark: SparkSession, root: str, upto: int | None = None) -> list[dict[str, str]]:
    """The paths of each commit under ``root``, oldest first."""
    root = root.rstrip("/")
    last = newest_commit(spark, root) if upto is None else upto
    names = [f"{root}/_commits/{n:012d}.json" for n in range(1, last + 1)]
    if not names:
        return []
    lines = spark.read.text(names, wholetext=True).withColumn("file", F.input_file_name())  # a small line each
    return [json.loads(r["value"]) for r in lines.orderBy("file").collect()]


def read_staged(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The outputs of the newest commit under ``root``."""
    made = commits(spark, root)
    if not made:
        raise RuntimeError(f"no committed outputs under {root}")
    return {name: spark.read.parquet(path) for name, path in made[-1].items()}


def read_committed(spark: SparkSession, root: str, name: str, upto: int | None = None) -> DataFrame | None:
    """The rows of output ``name`` of all commits (or those up to one); None if
    there are none."""
    paths = [c[name] for c in commits(spark, root, upto) if name in c]
    return spark.read.parquet(*paths) if paths else None


# Month partition column per time-keyed fact (partition pruning on time filters).
MONTH_PARTITIONS = {"ticket": "entry_time", "payment": "payment_time", "parking_log": "action_time",
                    "slot_event": "event_time", "auth_event": "event_time"}


def write_canonical_tables(spark: SparkSession, tables, root: str, names: list[str] | None = None,
                           buckets: dict[str, tuple[str, int]] | None = None, database: str | None = None,
                           partition_by_month: bool = True) -> dict[str, DataFrame]:
    """Store canonical tables for repeated querying at scale.

    * time-keyed facts get a ``month`` partition column, so a day or month
      filter reads only its partitions;
    * ``buckets`` maps a table to (key, n): the table is saved bucketed and
      sorted by its join key, so joins between tables bucketed the same way
      (ticket / payment / parking_log on ticket_id) run without a shuffle.
      Bucketed tables are registered in the session catalog (``database``).
    Returns the stored tables as DataFrames."""
    buckets = buckets or {}
    out = {}
    for name in names or tables.names():
        df = getattr(tables, name)
        if df is None:
            continue
        path = f"{root.rstrip('/')}/{name}"
        writer_df = df
        parts = []
        if partition_by_month and name in MONTH_PARTITIONS:
            writer_df = writer_df.withColumn("month", F.date_trunc("month", MONTH_PARTITIONS[name]).cast("date"))
            parts = ["month"]
        if name in buckets:
            key, n = buckets[name]
            table = f"{database}.{name}" if database else name
            w = writer_df.write.mode("overwrite").option("path", path).bucketBy(n, key).sortBy(key)
            if parts:
                w = w.partitionBy(*parts)
            w.saveAsTable(table)
            out[name] = spark.table(table)
        else:
            w = writer_df.write.mode("overwrite")
            if parts:
                w = w.partitionBy(*parts)
            w.parquet(path)
            out[name] = spark.read.parquet(path)
    return out


def purge_expired(spark: SparkSession, path: str, ts_col: str, days: int, as_of: str | dt.datetime) -> dict[str, list[str]]:
    """P7 as deletion, on a table stored by ``write_canonical_tables`` in month
    partitions: rows older than ``days`` before ``as_of`` go.

    A month that ended by the cut-off is dropped as a folder, unread; the month
    that the cut-off lies in is read and rewritten alone; later months and rows
    without a time (a folder of their own) stay untouched.  The rows to keep are
    stored apart before their month is replaced, so a purge that fails
    can be run again.  Returns the names of the folders dropped and rewritten."""
    path = path.rstrip("/")
    now = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    cutoff = now - dt.timedelta(days=days)
    boundary = f"month={cutoff:%Y-%m}-01"
    months = [f for f in folders(spark, path) if f.startswith("month=") and f != "month=__HIVE_DEFAULT_PARTITION__"]
    dropped = [m for m in months if m < boundary]
    for month in dropped:
        delete_folder(spark, f"{path}/{month}")
    rewritten = []
    if boundary in months and cutoff != cutoff.replace(day=1, hour=0, minute=0, second=0, microsecond=0):
        table = spark.read.parquet(path).filter(F.col("month") == F.lit(boundary.removeprefix("month=")).cast("date"))
        kept = scratch_path(spark, "purge")
        table.filter(F.col(ts_col) >= F.lit(cutoff).cast("timestamp_ntz")).write.parquet(kept)
        rows = spark.read.schema(table.schema).parquet(kept)
        if rows.limit(1).count():
            export_report(rows, path, "month")
            rewritten.append(boundary)
        else:
            delete_folder(spark, f"{path}/{boundary}")
            dropped.append(boundary)
    return {"dropped": dropped, "rewritten": rewritten}
