"""Session helpers: tables, shared storage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "heaplake", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of the session, once, so that nothing has to be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="heaplake-code-")
    archive = os.path.join(folder, "heaplake_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for where, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(where, f)
                    z.write(path, os.path.join("heaplake", os.path.relpath(path, root)))
    context.addPyFile(archive)  # the driver serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Only a session on one machine gets a temporary folder where neither is set; on a cluster that is an error, because
    executors would write where the others can't read.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known:
        return known
    if not is_local(spark):
        raise RuntimeError(f"master {context.master}: set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="heaplake-")
    context.setCheckpointDir(folder)
    atexit.register(shutil.rmtree, folder, True)
    return context.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        if path.startswith("table:"):
            spark.sql(f"drop table if exists {path[6:]}")
            return
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        if path.startswith("file:"):
            path = path[5:]
        if os.path.isdir(path):
            shutil.rmtree(path, True)


_kept: list[tuple[SparkSession, str]] = []


def discard() -> None:
    """Remove all intermediate tables written so far; results that still read them must be written before.

    Runs when the process ends; a session that runs for long calls it between its jobs.
    """
    while _kept:
        _delete(*_kept.pop())


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder under the shared one when the process ends, or with :func:`discard`."""
    if not _kept:
        atexit.register(discard)
    _kept.append((spark, path))


def drop_at_exit(spark: SparkSession, table: str) -> None:
    """Forget a table of the session's catalog when the process ends, or with :func:`discard`; its files have their own folder."""
    if not _kept:
        atexit.register(discard)
    _kept.append((spark, f"table:{table}"))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/heaplake-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged (a shuffle join follows).

    ``df`` is counted first, so it should be cheap to read twice: a materialised table, or one of few rows.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def join_few(df: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = 100_000, salts: int = 32, rows: int | None = None) -> DataFrame:
    """``df`` joined with the few rows of ``few``, one per key, whatever share of ``df`` a key holds.

    Up to ``max_rows`` rows are broadcast. Beyond that each row of ``few`` goes to ``salts`` places and the rows of a key
    in ``df`` are spread over them, so that no key is one task's work. ``how``: inner, left, left_semi or left_anti.
    ``rows``: the rows of ``few``, where they are known.
    """
    if (few.count() if rows is None else rows) <= max_rows:
        return df.join(F.broadcast(few), list(keys), how)
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    whole_row = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])  # repeatable, unlike a random number
    salted = df.withColumn("_salt", F.pmod(whole_row, F.lit(salts)).cast("int"))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
