"""Documents as they arrive: a file stream and the batch readers on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, *, files_per_batch: int = 100) -> DataFrame:
    """doc and content of files that arrive below ``path``."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.col("path").alias("doc"), "content")


def ingest(spark: SparkSession, path: str, checkpoint: str, read: Callable[[DataFrame], DataFrame], out: str, **options):
    """Start a query that parses arriving documents with a batch reader (``dicom.read_doses``, ...)
    and appends its rows to Parquet at ``out``. Each micro-batch writes its own folder, over again
    after a failure, so a batch that is run twice is there once."""

    def write(batch: DataFrame, number: int) -> None:
        read(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, path, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
