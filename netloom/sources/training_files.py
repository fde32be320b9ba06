"""Labelled training CSVs with the public headers or our own."""

from __future__ import annotations

import logging
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.ranking import shuffled_head
from netloom.operators.training import clean_lenient, clean_strict, harmonise, unite
from netloom.session import stage

log = logging.getLogger(__name__)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _first_lines(batches):
    """The first line of a file, if this task's split is the file's first; reads one batch of it."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            if batch.column("start")[0].as_py() == 0:
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(0, 1), batch.column("value").slice(0, 1)], ["path", "header"])
            return


def _headers(spark: SparkSession, folder: str, recursive: bool) -> list[tuple[str, str]]:
    """(path, first line) of the CSVs of a folder, by one job with a task for each split that reads no more than its beginning."""
    packed, size = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = (
        spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", str(recursive).lower()).text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    )
    spark.conf.set("spark.sql.files.openCostInBytes", size)  # no two files in one task
    try:
        return sorted(tuple(r) for r in lines.mapInArrow(_first_lines, "path string, header string").collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", packed)


def _by_header(spark: SparkSession, folder: str, recursive: bool, encoding: str) -> list[DataFrame]:
    """One frame per distinct header: files with the same header are read together."""
    groups: dict[str, list[str]] = {}
    for path, header in _headers(spark, folder, recursive):
        groups.setdefault(header, []).append(path)
    if not groups:
        raise FileNotFoundError(f"no CSV files in {folder}")
    read = spark.read.option("header", True).option("encoding", encoding)
    return [read.csv(ps) for ps in groups.values()]


def load_public_flows(spark: SparkSession, folder: str, time_scale: float = 1.0) -> DataFrame:
    """All CSVs of one folder (Latin-1), strictly cleaned, with ``is_attack``."""
    frames = [harmonise(df, time_scale=time_scale) for df in _by_header(spark, folder, False, "ISO-8859-1")]
    return clean_strict(unite(*frames))


def load_mixed_flows(spark: SparkSession, folder: str, max_samples: int | None = None) -> DataFrame:
    """CSVs of a folder tree, either header style; files without label are left out."""
    frames = []
    for df in _by_header(spark, folder, True, "UTF-8"):
        one = harmonise(df)
        if "label" in one.columns:
            frames.append(one)
        else:
            log.warning("no label column in %s", df.inputFiles())
    if not frames:
        raise ValueError("no labelled CSV files")
    united = unite(*frames)
    if max_samples:
        # A written row number tells copies of a row apart, so that the choice has the exact size.
        numbered = stage(united.withColumn("_row", F.monotonically_increasing_id()), "rows")
        united = shuffled_head(numbered, max_samples, ["_row"]).drop("_row")
    return clean_lenient(united)
