"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the library relies on; sizes are left to the cluster."""
    return (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the call-site capture costs several round trips per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    A local session that names none (a test run) gets a temporary one; on a cluster that
    is an error, as every executor would write to a disk of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="clauseloom-checkpoint-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and go on from the written copy.

    A table rather than an RDD checkpoint, so that later reads prune columns and
    later joins know the size.  It is packed more tightly than by default: most of what is
    written is text.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, "cut")
    frame.write.parquet(path, compression="zstd")
    return spark.read.schema(frame.schema).parquet(path)


def fan_out(frame: DataFrame, *keys: Column) -> DataFrame:
    """Hash rows over all shuffle partitions before work that is heavy for its bytes.

    The number is given, so that size-based coalescing does not undo it.
    """
    width = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(width, *keys)
