"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of the package relies on. ANSI mode keeps PG's
# "raise on bad cast / overflow / division by zero" behaviour.
BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for large inputs, applied by :func:`apply_scale_defaults` only where the
# session does not already set a value. AQE coalesces the many initial shuffle
# partitions down to ~advisory-size pieces and splits skewed ones.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_scale_defaults(spark: SparkSession, overrides: dict | None = None) -> dict:
    """Set :data:`SCALE_DEFAULTS` on an existing (cluster) session for every
    key the session has not set explicitly; returns what was set. Values the
    cluster configured are kept."""
    applied = {}
    for k, v in {**SCALE_DEFAULTS, **(overrides or {})}.items():
        if spark.conf.get(k, None) is None:  # None: not set explicitly
            spark.conf.set(k, v)
            applied[k] = v
    ensure_checkpoint_dir(spark)
    return applied


def cluster_session() -> SparkSession:
    """The session of this process as it was submitted: master and settings come
    from spark-submit or the cluster, the scale defaults fill what is unset."""
    spark = SparkSession.builder.getOrCreate()
    apply_scale_defaults(spark)
    return spark


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "claimlens", extra: dict | None = None) -> SparkSession:
    """Local session of tests and the bench; jobs use :func:`cluster_session`."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is. Only a local
    master (tests, local runs) without the setting gets a fresh scratch
    folder; a cluster without it is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder every executor "
                               "can reach (HDFS / object store) before running claimlens jobs")
        d = tempfile.mkdtemp(prefix="claimlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some sessions reject core keys; the context setting suffices
            pass
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()
