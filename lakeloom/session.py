"""Session construction and shared-folder helpers.

Everything that must survive executor loss (checkpoints, staged tables,
stream state) goes under the folder named by ``spark.checkpoint.dir``.
On a cluster that setting is provided by the deployment; we only fill it
in when it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings every job relies on: UTC for timestamp arithmetic, AQE for runtime
# re-planning (partition coalescing, skew splitting, broadcast conversion).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "lakeloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def session_key(spark: SparkSession):
    """Identity of a running session, for per-session plan caches."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - no SparkContext handle (remote session)
        return id(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when unset."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the server owns the context
        pass
    if not path and sc is not None:
        path = sc.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        path = tempfile.mkdtemp(prefix="lakeloom-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def spread(df, min_partitions: int | None = None):
    """Rebalance before CPU-heavy per-row work only when the input is split more
    coarsely than the cluster can run (e.g. one large file): a no-op on a
    cluster scan with thousands of splits, a round-robin shuffle otherwise."""
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the plan alone
        return df
    return df.repartition(want) if have < want else df


def small_batches(spark: SparkSession, rows: int, size: int) -> None:
    """At most ``rows`` rows and about ``size`` bytes in a batch that Spark hands to Python.  Without a bound
    on bytes a batch of long values grows with the input until it holds 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, kind, uuid.uuid4().hex)
    return path


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 * 1024 * 1024,
                 shuffle_ratio: float = 0.5) -> dict[str, str]:
    """Settings sized for an input of ``input_bytes`` on ``total_cores`` cores.

    Scan splits of ``target_partition_bytes``; shuffle partitions sized so an
    expected shuffle of ``shuffle_ratio * input_bytes`` lands at about the same
    bytes per partition (AQE coalesces the small ones and splits skewed ones),
    never fewer than three waves of tasks.  The chunked ordered scans take their
    chunk count from the shuffle partition count.
    """
    scan_bytes = str(target_partition_bytes)
    shuffle_parts = max(3 * total_cores, int(input_bytes * shuffle_ratio // target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": scan_bytes,
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": scan_bytes,
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
    }


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> str | None:
    """Send this package to the executors (``addPyFile`` of a zip), once per
    application, so Python UDFs defined here import on every worker."""
    key = session_key(spark)
    if key in _SHIPPED:
        return None
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="lakeloom-pkg-"), "lakeloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    try:
        spark.sparkContext.addPyFile(out)
    except Exception:  # noqa: BLE001 - remote sessions ship code with spark.addArtifacts instead
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)
    return out
