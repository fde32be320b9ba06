"""What several operators share: reading, Arrow batch sizes, prefix sums over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID, TEXT = "doc_id", "text"

# Rows and bytes of one Arrow batch sent to a Python worker: a worker holds a few of these at most.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def tune(spark: SparkSession) -> None:
    """Batch sizes for Python stages; a batch of very long texts is cut by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_part() -> int:
    """Number of the partition that the running task works on."""
    return TaskContext.get().partitionId()


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that results wider than their input stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc32_id(name: str = ID):
    """crc32 of an id's decimal text; NULL ids count as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
