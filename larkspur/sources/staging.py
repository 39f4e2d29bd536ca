"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder is set only where it names none and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/larkspur/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read again: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more (intermediate rounds of a loop)."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged, once its results are written: frames that read it are of no use after."""
    _delete(spark, _own(spark))


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out anew where it has fewer partitions than there are cores and megabytes, as a table of one file may."""
    plan = df._jdf.queryExecution()
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, plan.optimizedPlan().stats().sizeInBytes() >> 20)
    return df.repartition(wanted) if plan.toRdd().getNumPartitions() < wanted else df
