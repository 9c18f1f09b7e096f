"""Where jobs put tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session whose tasks all run in the driver's process (master ``local``) gets a folder of
    its own; on a cluster that is an error, since executors would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="iotrace-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: Shared tables written by each application and not yet cleaned up.
_WRITTEN: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete the shared tables that this application has written through ``shared_path``; their number.

    For use once results are written: frames read from these tables, unless collected, can no longer be.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, a table of totals, with the named decimal columns as bigint, each if all its values fit; else it stays as it is.

    Sums of times in nanoseconds pass 2**63 in large traces: such a sum is taken as a decimal, which loses nothing.
    """
    df = materialize(df, "totals")
    beyond = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("bigint").isNull()).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns if not beyond[c]})
