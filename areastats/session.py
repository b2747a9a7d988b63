"""Spark session and shared-folder helpers.

The library never creates a session for a caller who already has one. ``local_session``
exists for tests, the bench and the command line; on a cluster the caller's session (and
its ``spark.checkpoint.dir``) is used as it is.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "areastats") -> SparkSession:
    """A local session configured like the production one: AQE on, UI off."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("AREASTATS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """The application id (from the conf, so it also works without a SparkContext handle)."""
    v = spark.conf.get("spark.app.id", None)
    if v:
        return v
    return spark.sparkContext.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint directory). Where none is
    set, a run on one machine (a ``local`` master: tests, the bench) gets a fresh folder of its
    own; on a cluster this raises, because a folder of one machine is not shared.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001 - no SparkContext handle (remote session)
            d = None
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="areastats-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder (never reused, never cleared)."""
    return f"{shared_dir(spark)}/areastats/{name}-{uuid.uuid4().hex}"
