"""The flows / alerts / incidents store: Parquet tables partitioned by event date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.schemas import ALERT_SCHEMA, INCIDENT_SCHEMA, RETRAIN_SCHEMA

TIME_OF = {"flows": "flow_end", "alerts": "alert_ts", "incidents": "start_time"}


def payload(df: DataFrame) -> Column:
    """The whole row as JSON text."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def read_payload(stored: DataFrame, schema: T.StructType, column: str = "raw_json", keep: Sequence[str] = ()) -> DataFrame:
    return stored.select(*keep, F.from_json(column, schema).alias("r")).select(*keep, "r.*")


def append_rows(df: DataFrame, root: str, name: str, with_payload: bool = False) -> None:
    """Appends to table ``name`` below ``root``, one folder per event date."""
    out = df.withColumn("raw_json", payload(df)) if with_payload else df
    out = out.withColumn("event_date", F.to_date(TIME_OF[name]))
    # Rows of a date meet before the write, but a busy date may fill several files.
    out.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(f"{root}/{name}")


def append_alerts(alerts: DataFrame, root: str, with_payload: bool = False) -> None:
    """Alerts in the fixed column set; columns not yet known read NULL."""
    cols = [(F.col(f.name) if f.name in alerts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ALERT_SCHEMA]
    append_rows(alerts.select(*cols), root, "alerts", with_payload)


def read_table(spark: SparkSession, root: str, name: str, since: str | None = None) -> DataFrame:
    """Table ``name``; ``since`` (a date) prunes whole folders. Older files may lack newer columns."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
    return df.where(F.col("event_date") >= F.lit(since).cast("date")) if since else df


def recent_rows(spark: SparkSession, root: str, name: str, n: int = 2000, tie: str = "alert_id") -> DataFrame:
    """The newest ``n`` rows of a table in chronological order."""
    from netloom.operators.ranking import newest

    return newest(read_table(spark, root, name), n, TIME_OF[name], tie)


def clear_table(spark: SparkSession, root: str, name: str, schema: T.StructType) -> None:
    """Leaves an empty table with the same columns."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_labelled(flows: DataFrame, label: str, path: str) -> None:
    """Flows of one capture with a constant label, added to a training folder."""
    from netloom.schemas import FEATURE_COLS

    flows.select(*FEATURE_COLS, F.lit(label).alias("label")).write.mode("append").option("header", True).csv(path)


def append_history(spark: SparkSession, path: str, row: dict) -> None:
    """One line per retraining run."""
    spark.createDataFrame([tuple(row[f.name] for f in RETRAIN_SCHEMA)], RETRAIN_SCHEMA).write.mode("append").json(path)
