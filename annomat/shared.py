"""The folder that driver and executors share, for intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from annomat.errors import AnnotatedMatrixError


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session may do without one and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise AnnotatedMatrixError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="annomat-")


def mounted_folder(spark: SparkSession) -> str:
    """The same as a path that plain file operations reach, which layouts of single files need."""
    path = shared_folder(spark).removeprefix("file://")
    if "://" in path:
        raise AnnotatedMatrixError(f"{path} can't be reached as a mounted folder; set spark.checkpoint.dir to one")
    return path


def stored(df: DataFrame) -> DataFrame:
    """A copy as Parquet in the shared folder, for large tables that are read by columns."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which the context keeps once it is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
