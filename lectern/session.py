"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def get_session(app: str = "lectern", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests, a laptop)
    a temporary folder is made and registered as the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder, deleted when the driver ends."""
    if not _written:
        atexit.register(_clean)
    path = f"{scratch_root(spark)}/lectern/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the rereading of files, never
    a recomputation of what led to them.
    """
    return written(df, label)[0]


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """What materialise() returns, and its path for drop_scratch()."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_scratch(df_path: str) -> None:
    """Delete a scratch path early."""
    spark = _written.pop(df_path, None)
    if spark is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(df_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean() -> None:
    for path in list(_written):
        try:
            drop_scratch(path)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            _written.pop(path, None)
