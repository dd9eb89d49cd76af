"""Written intermediate tables, names that cannot clash, and code shipping."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root, name = os.path.split(_PACKAGE)
        bundle = shutil.make_archive(os.path.join(tempfile.mkdtemp(), f"{name}_llm"), "zip", root, name)
        spark.sparkContext.addPyFile(bundle)
        _SHIPPED.add(application)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    A local session that names none (tests) gets a folder of its own; a cluster that
    names none is an error, as executors would each write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="clauseloom-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(frame: DataFrame, name: str = "cut") -> DataFrame:
    """Write the frame to the shared folder and go on from the written table."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames uses (Spark compares without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(frame: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return frame["`" + name.replace("`", "``") + "`"]


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two longs, never null, that tell documents apart even where ids are null or repeat.

    Rows alike in id and text share the pair; they are copies and are treated alike.
    """
    return F.coalesce(doc_id.cast("long"), F.lit(-1).cast("long")), F.xxhash64(doc_id, text)
