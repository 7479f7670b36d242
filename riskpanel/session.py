"""Session helper.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; we
read it from the session and only set our own when it is unset (tests).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskpanel", extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if (master or "").startswith("local[") and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskpanel-ckpt-"))  # one machine only
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, or the folder the
    session's context was given. There is no fallback, since a folder of our own
    choice might be local to one machine of a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return d


_WRITTEN: list[str] = []


def materialize(df):
    """Cut lineage by writing the frame as a parquet table under the shared
    checkpoint folder and reading it back (survives executor loss; never a
    machine-local checkpoint). Unlike an RDD checkpoint, the plan runs once,
    and later readers get column pruning and filter pushdown. The job runs
    now; ``release`` deletes the tables when their readers are done."""
    import uuid
    spark = df.sparkSession
    root = checkpoint_dir(spark).rstrip("/")
    path = f"{root}/riskpanel-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _WRITTEN.append(path)
    table = spark.read.parquet(path)
    table._riskpanel_path = path
    return table


def discard(*tables) -> None:
    """Delete tables that ``materialize`` returned, once all that was made of them is itself a table or a result."""
    for table in tables:
        path = table._riskpanel_path
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote in this process so far."""
    n = 0
    while _WRITTEN:
        n += _delete(spark, _WRITTEN.pop())
    return n
