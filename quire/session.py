"""Reading tables and cutting lineage, for any session the caller hands over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only when it is known to stay under this many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as it is. Only where nothing is set (tests,
    a laptop) a temporary folder is taken, which is fine since driver and executors are then one process.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = gone_at_exit(spark, tempfile.mkdtemp(prefix="quire-"))
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; later reads survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, so that the join shuffles."""
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which the file system deletes when the application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, for tables that one job writes and reads again; it goes when the
    application ends."""
    return gone_at_exit(spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
