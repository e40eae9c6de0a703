"""Spark session defaults and the shared scratch location.

Everything that writes (sinks, CSV round trips, streaming checkpoints,
lineage cuts) goes below the checkpoint root the cluster names in
``spark.checkpoint.dir``.  A private directory is created only when the
session has none, which is the case in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_CLEANED: set[str] = set()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "fleetlens", driver_memory: str = "8g") -> SparkSession:
    """Session with the settings the operators assume (UTC, AQE, ANSI, no UI)."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint directory of this session (set one only if unset)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = sc.applicationId
    if key not in _LOCAL_ROOT:
        _LOCAL_ROOT[key] = tempfile.mkdtemp(prefix="fleetlens-ckpt-")
        sc.setCheckpointDir(_LOCAL_ROOT[key])
    return sc.getCheckpointDir() or _LOCAL_ROOT[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused directory below the checkpoint root; the
    application's directories are removed when it ends."""
    sc = spark.sparkContext
    top = f"{checkpoint_root(spark).rstrip('/')}/fleetlens/{sc.applicationId}"
    if top not in _CLEANED:
        path = sc._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        _CLEANED.add(top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"
