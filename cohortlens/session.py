"""Session helpers: a tuned builder for tests/bench and the shared scratch location."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes, coalesces small
# shuffle partitions and splits skewed join partitions.  Broadcast decisions are left to
# AQE's measured sizes (autoBroadcastJoinThreshold), never forced on data that grows.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cohortlens") -> SparkSession:
    """Build (or reuse) a session with the tuning above; used by tests and bench."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in TUNING.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("COHORTLENS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names (``spark.checkpoint.dir``).

    Only a local-mode session without one (tests) gets a folder of ours; on a cluster a folder of
    one machine would be lost to the others, so the missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master or "").startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = os.path.join("/tmp", "cohortlens-checkpoints")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends.  Otherwise they stay until the driver happens to
    collect its garbage, so that the disk holds those of all queries of a long run."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def delete_at_exit(spark: SparkSession, path: str) -> str:
    """Have the path removed when the application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder; removed when the application ends."""
    root = ensure_checkpoint_dir(spark)
    path = "/".join([root.rstrip("/"), "cohortlens", *parts, uuid.uuid4().hex])
    return delete_at_exit(spark, path)
