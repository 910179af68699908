"""Row chunks as a stream: a growing matrix store is profiled or copied as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annomat.operators.layout import chunk_start


def chunks(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The triples of a Parquet matrix table as a stream, some files for each trigger."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_profile(stream: DataFrame, size: int) -> DataFrame:
    """(row_offset, nnz, total) of each chunk of ``size`` rows so far; state grows with the number of chunks only."""
    return stream.groupBy(chunk_start(F.col("obs_idx"), size).alias("row_offset")).agg(F.count("*").alias("nnz"), F.sum("value").alias("total"))


def copy(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a Parquet table, exactly once, until all that is there has been copied."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
