"""Statistics of a running detection, merged batch by batch.

A sink reduces each micro-batch to small rows that add up: counts by kind and item, counts by second for the rolling
rates, and the newest scores. The state after a batch is the state after the batch before plus these rows, and is
written under the batch's number, so a batch that is repeated after a failure replaces itself. Flows and alerts have
a state of their own, as they come through different queries; a snapshot reads the newest of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.analytics import alert_distributions, port_distribution, score_summary
from netloom.session import stage

_COUNTS, _SECONDS, _SCORES = "kind string, item string, n bigint", "second bigint, n bigint", "alert_ts timestamp, alert_id bigint, score double"
LAST_SCORES = 1000


def _path(root: str, name: str, part: str, batch_id: int) -> str:
    return f"{root}/stats_{name}/{part}/batch={batch_id}"


def _before(spark: SparkSession, root: str, name: str, part: str, schema: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_path(root, name, part, batch_id - 1))


def _record(rows: DataFrame, counts: DataFrame, ts: str, root: str, name: str, batch_id: int, window_seconds: float) -> None:
    spark = rows.sparkSession
    total = rows.agg(F.lit("total").alias("kind"), F.lit(name).alias("item"), F.count(F.lit(1)).alias("n"))
    merged = _before(spark, root, name, "counts", _COUNTS, batch_id).unionByName(counts.unionByName(total))
    merged.groupBy("kind", "item").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(_path(root, name, "counts", batch_id))
    second = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000)
    seconds = rows.where(F.col(ts).isNotNull()).groupBy(second.alias("second")).agg(F.count(F.lit(1)).alias("n"))
    ring = stage(_before(spark, root, name, "seconds", _SECONDS, batch_id).unionByName(seconds).groupBy("second").agg(F.sum("n").alias("n")), "ring")
    newest = ring.agg(F.max("second")).scalar()
    ring.where(F.col("second") >= newest - int(window_seconds)).write.mode("overwrite").parquet(_path(root, name, "seconds", batch_id))


def record_flows(flows: DataFrame, root: str, batch_id: int, window_seconds: float = 300.0) -> None:
    ports = port_distribution(flows).select(F.lit("port").alias("kind"), F.col("port").cast("string").alias("item"), "n")
    _record(flows, ports, "flow_end", root, "flows", batch_id, window_seconds)


def record_alerts(alerts: DataFrame, root: str, batch_id: int, window_seconds: float = 300.0) -> None:
    if "score" not in alerts.columns:
        alerts = alerts.withColumn("score", F.lit(None).cast("double"))
    counts = alert_distributions(alerts).select(F.col("dimension").alias("kind"), "item", "n")
    _record(alerts, counts, "alert_ts", root, "alerts", batch_id, window_seconds)
    scores = alerts.select(F.col("alert_ts").cast("timestamp").alias("alert_ts"), "alert_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    newest = _before(alerts.sparkSession, root, "alerts", "scores", _SCORES, batch_id).unionByName(scores)
    newest.orderBy(F.desc("alert_ts"), F.desc("alert_id")).limit(LAST_SCORES).write.mode("overwrite").parquet(_path(root, "alerts", "scores", batch_id))


def _newest(spark: SparkSession, root: str, name: str, part: str, schema: str) -> DataFrame:
    """The state after the last batch; empty before the first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/stats_{name}/{part}")
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [str(s.getPath().getName()) for s in files.listStatus(hadoop)] if files.exists(hadoop) else []
    numbers = [int(f.split("=")[1]) for f in folders if f.startswith("batch=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hadoop, f"{f}/_SUCCESS"))]
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_path(root, name, part, max(numbers)))


def snapshot(spark: SparkSession, root: str, window_seconds: float = 300.0) -> DataFrame:
    """(kind, item, value): totals, attack rate, counts, score figures, and rates over the last ``window_seconds`` before the newest row."""
    counts = [_newest(spark, root, name, "counts", _COUNTS) for name in ("flows", "alerts")]
    values = counts[0].unionByName(counts[1])
    of = lambda item: F.coalesce(F.sum(F.when((F.col("kind") == "total") & (F.col("item") == item), F.col("n"))), F.lit(0))
    totals = values.agg(of("flows").alias("total_flows"), of("alerts").alias("total_alerts"))
    totals = totals.withColumn("attack_rate_pct", F.round(F.col("total_alerts") / F.greatest("total_flows", F.lit(1)).cast("double") * 100, 2))
    seconds = [_newest(spark, root, name, "seconds", _SECONDS).select(F.lit(name).alias("name"), "second", "n") for name in ("flows", "alerts")]
    ring = seconds[0].unionByName(seconds[1])
    since = ring.agg(F.max("second") - int(window_seconds)).scalar()
    rate = lambda name: F.round(F.coalesce(F.sum(F.when((F.col("name") == name) & (F.col("second") >= since), F.col("n"))), F.lit(0)) / window_seconds, 3)
    rates = ring.agg(rate("flows").alias("flows_per_sec"), rate("alerts").alias("alerts_per_sec"))

    def long(kind: str, row: DataFrame) -> DataFrame:
        cells: list[Column] = [F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in row.columns]
        return row.select(F.explode(F.array(*cells)).alias("e")).select("e.*")

    single = values.where("kind != 'total'").select("kind", "item", F.col("n").cast("double").alias("value"))
    scores = score_summary(_newest(spark, root, "alerts", "scores", _SCORES), LAST_SCORES)
    return single.unionByName(long("total", totals)).unionByName(long("score", scores)).unionByName(long("rate", rates))
