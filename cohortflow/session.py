"""SparkSession construction and shared-storage locations.

Production runs get their session (and ``spark.checkpoint.dir``) from the
cluster; ``get_session`` only fills in settings that are unset, so it is safe
to call on a configured cluster and convenient in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the report relies on. Adaptive execution re-plans joins from
# runtime sizes (broadcast only when the measured side is small), coalesces
# tiny shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Size-checked broadcast: the planner broadcasts a join side only when its
    # estimated (static) or measured (adaptive) size is below these limits.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cohortflow", extra: dict | None = None) -> SparkSession:
    """The running session, or a new one.

    A key of ``DEFAULT_CONF`` is set only where the deployment (or the running
    session) has not set it. ``shuffle_partitions`` and ``extra`` are the
    caller's own wishes and are always set. Results need the zone UTC: a
    session with another zone is refused.
    """
    wanted = dict(extra or {})
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        # what a running context cannot change any more; on a cluster that is the deployment's business
        launch = {k: v for k, v in DEFAULT_CONF.items() if not k.startswith("spark.sql.")}
        for k, v in {**(launch if (master or "").startswith("local") else {}), **wanted}.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
    else:
        for k, v in wanted.items():
            spark.conf.set(k, v)
    given = {k for k, _ in spark.sparkContext.getConf().getAll()} | set(wanted)
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql.") and k not in given and _is_default(spark, k):
            spark.conf.set(k, v)
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise RuntimeError(f"spark.sql.session.timeZone is {zone}; the report's dates need UTC")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_default(spark: SparkSession, key: str) -> bool:
    """Whether the running session still has Spark's own value of ``key``."""
    fresh = spark.newSession()          # starts from the deployment's settings
    return spark.conf.get(key, None) == fresh.conf.get(key, None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system path).
    Only when it is unset -- local tests -- a private folder is created.
    """
    global _LOCAL_FALLBACK
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder every executor "
                               "can read and write (HDFS, object store, shared mount)")
        if _LOCAL_FALLBACK is None:  # local mode only: one machine, a private folder is shared
            _LOCAL_FALLBACK = tempfile.mkdtemp(prefix="cohortflow-ckpt-")
        path = _LOCAL_FALLBACK
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


_LOCAL_FALLBACK: str | None = None


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for sinks and cut lineage)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def work_path(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables under the shared one."""
    return shared_path(spark, "cohortflow-work", spark.sparkContext.applicationId)


def table_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file, or of all files of a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as an intermediate table of this application and read it back.

    Cuts the lineage at a table every executor can read again. ``release`` removes it.
    """
    path = os.path.join(work_path(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Remove the intermediate tables of this application; call it when all results have been read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_path(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
