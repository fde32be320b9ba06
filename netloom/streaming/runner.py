"""Running streams: sinks, fan-out to tables and handlers, rule reload, restart."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.functions.net import skips_enrichment
from netloom.functions.times import to_micros
from netloom.functions.values import severity_name, severity_rank
from netloom.operators.alerts import with_rules_only_score
from netloom.operators.incidents import INTEL, incident_id
from netloom.operators.intel import enrich
from netloom.operators.rules import first_match
from netloom.operators.alerts import raise_alerts
from netloom.plans.detect import DetectConfig
from netloom.session import run_dir, stage
from netloom.sources.rulefile import RuleFile
from netloom.streaming import live_stats

log = logging.getLogger(__name__)

# Topics a handler can subscribe to.
TOPICS = ("alert", "flow", "stats", "error", "incident_update")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with its change log in the checkpoint; needed by the stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Topics:
    """Handlers by topic. They get a DataFrame per micro-batch; one that fails does not stop the others."""

    def __init__(self):
        self._handlers: dict[str, list[Callable[[DataFrame], None]]] = {t: [] for t in TOPICS}

    def subscribe(self, topic: str, handler: Callable[[DataFrame], None]) -> None:
        if topic not in self._handlers:
            raise ValueError(f"unknown topic {topic!r}")
        self._handlers[topic].append(handler)

    def publish(self, topic: str, rows: DataFrame) -> None:
        for handler in self._handlers.get(topic, ()):
            try:
                handler(rows)
            except Exception:
                log.exception("handler of topic %r failed", topic)


def write_batch(rows: DataFrame, root: str, name: str, batch_id: int) -> None:
    """One folder per micro-batch, so that a batch repeated after a failure replaces itself."""
    rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")


def to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts a stream that takes what is there now and then ends."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drain(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over the data there is and returns what it wrote."""
    spark = df.sparkSession
    use_rocksdb(spark)
    root = run_dir(spark, name)
    query = to_parquet(df, f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def drain_in_turns(df: DataFrame, name: str, feeds: Iterable[Callable[[], None]]) -> DataFrame:
    """Like :func:`drain`, but runs the stream once after each feed; state and watermark go on from run to run."""
    spark = df.sparkSession
    use_rocksdb(spark)
    root = run_dir(spark, name)
    for feed in feeds:
        feed()
        to_parquet(df, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark over the query's recent batches."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def start_flow_sink(flows: DataFrame, root: str, checkpoint: str, cfg: DetectConfig, rule_file: RuleFile | None = None,
                    topics: Topics | None = None, **trigger) -> StreamingQuery:
    """Closed flows -> scored flow table and raw alert table, with the rules as they are at each batch."""
    topics = topics or Topics()

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = (cfg.scorer or with_rules_only_score)(batch).persist()  # models score a flow once
        try:
            rules = rule_file.current() if rule_file else cfg.rules
            write_batch(scored, root, "flows", batch_id)
            live_stats.record_flows(scored, root, batch_id)
            topics.publish("flow", scored)
            write_batch(raise_alerts(scored, first_match(scored, rules)), root, "raw_alerts", batch_id)
        except Exception:
            topics.publish("error", batch.limit(0))
            raise
        finally:
            scored.unpersist()

    return flows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_alert_sink(fired: DataFrame, root: str, checkpoint: str, cfg: DetectConfig, blocklist_path: str | None = None,
                     geo_path: str | None = None, topics: Topics | None = None, **trigger) -> StreamingQuery:
    """Firing alerts -> enriched alert table and live incident table. Intel is re-read at each batch."""
    from netloom.sources.feeds import current_blocklist, read_geo

    topics = topics or Topics()
    spark = fired.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        if blocklist_path and geo_path:
            batch = enrich(batch, current_blocklist(spark, blocklist_path), read_geo(spark, geo_path))
        batch.persist()
        try:
            found = upsert_incidents(spark, batch, root, batch_id, cfg.incident_seconds, cfg.incident_lateness_seconds)
            write_batch(with_incident(batch, found), root, "alerts", batch_id)
            live_stats.record_alerts(batch, root, batch_id)
            topics.publish("alert", batch)
            topics.publish("incident_update", closed_incidents(spark, root, batch_id))
            topics.publish("stats", live_stats.snapshot(spark, root))
        finally:
            batch.unpersist()

    return fired.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


_PARTS = "src_ip string, first_us bigint, last_us bigint, n bigint, rank int, country string, city string, asn string, threat_level string, intel_us bigint"
_LIVE = f"incident_id bigint, {_PARTS}, closed_by bigint"

def _as_parts(alerts: DataFrame) -> DataFrame:
    """Alerts of a batch combined per source and second."""
    for name in INTEL:
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast("string"))
    us = F.unix_micros(F.col("alert_ts").cast("timestamp"))
    seen = ~skips_enrichment(F.col("_src_ip"))
    rows = alerts.select(F.coalesce("_src_ip", F.lit("unknown")).alias("src_ip"), us.alias("us"), severity_rank(F.col("severity")).alias("rank"),
                         F.when(seen, us).alias("intel_us"), *INTEL)
    return rows.groupBy("src_ip", F.floor(F.col("us") / 1_000_000).alias("s")).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"),
        *[F.max_by(c, "intel_us").alias(c) for c in INTEL], F.max("intel_us").alias("intel_us")).drop("s")


def _snapshot(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """Incidents that an alert could still reach, as the batch before left them."""
    empty = spark.createDataFrame([], _LIVE).drop("closed_by")
    if batch_id == 0:
        return empty
    return spark.read.schema(empty.schema).parquet(f"{root}/incidents_open/batch={batch_id - 1}")


def upsert_incidents(spark: SparkSession, alerts: DataFrame, root: str, batch_id: int, window_seconds: float, lateness_seconds: float) -> DataFrame:
    """Extends, merges or opens incidents by the alerts of a batch, in whatever order they come.

    An incident keeps its id when it grows to either side. If alerts bridge several, the one that began
    first goes on and the others get a last version that names it (``closed_by``). Written are the changed
    versions and a snapshot of what later alerts can reach; a batch reads the snapshot before it alone.
    Returns (src_ip, s, incident_id) by source and second of the batch.
    """
    gap, late = to_micros(window_seconds), to_micros(lateness_seconds)
    new = _as_parts(alerts).withColumns({"incident_id": F.lit(None).cast("bigint"), "s": F.floor(F.col("first_us") / 1_000_000)})
    before = _snapshot(spark, root, batch_id)
    reach = new.groupBy("src_ip").agg((F.min("first_us") - gap).alias("lo"), (F.max("last_us") + gap).alias("hi"))
    near = before.join(reach, "src_ip").where("last_us >= lo AND first_us <= hi").drop("lo", "hi")
    rows = new.unionByName(near.withColumn("s", F.lit(None).cast("bigint")))
    order = Window.partitionBy("src_ip").orderBy("first_us", "last_us")
    prior = F.max("last_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first_us") - prior > gap, F.lit(True)).cast("int")
    cut = rows.withColumn("opens", opens).withColumn("session", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("src_ip", "session")
    known = F.min(F.when(F.col("incident_id").isNotNull(), F.struct("first_us", "incident_id"))).over(whole)["incident_id"]
    fresh = incident_id(F.col("src_ip"), F.min("first_us").over(whole))
    marked = stage(cut.withColumn("goes_on", F.coalesce(known, fresh)), "live-parts")

    changed = marked.groupBy(F.col("goes_on").alias("incident_id"), "src_ip", "session").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"), F.max("rank").alias("rank"),
        *[F.max_by(c, "intel_us").alias(c) for c in INTEL], F.max("intel_us").alias("intel_us")).drop("session")
    absorbed = marked.where("incident_id != goes_on").withColumn("closed_by", F.col("goes_on"))
    names = [c.split()[0] for c in _LIVE.split(", ")]
    write_batch(changed.withColumn("closed_by", F.lit(None).cast("bigint")).select(names).union(absorbed.select(names)), root, "incidents", batch_id)

    stays = before.join(marked.where("incident_id IS NOT NULL").select("incident_id"), "incident_id", "left_anti")
    reachable = stays.unionByName(changed)
    newest, prior_newest = reachable.agg(F.max("last_us")).scalar(), before.agg(F.max("last_us")).scalar()
    # Closed by this batch: taken over by another, or silent for longer than the window as of the newest alert.
    silent = reachable.where(F.col("last_us") < newest - gap).join(changed.select("incident_id", F.lit(True).alias("touched")), "incident_id", "left")
    silent = silent.where(F.coalesce("touched", F.lit(False)) | F.coalesce(F.col("last_us") >= prior_newest - gap, F.lit(True)))
    closed = silent.select("incident_id", F.lit("closed").alias("status"), F.lit(None).cast("bigint").alias("closed_by")).union(
        absorbed.select("incident_id", F.lit("closed"), "closed_by"))
    write_batch(closed, root, "incident_updates", batch_id)
    write_batch(reachable.where(F.col("last_us") >= newest - (late + gap)), root, "incidents_open", batch_id)
    return marked.where("s IS NOT NULL").select("src_ip", "s", F.col("goes_on").alias("incident_id"))


def with_incident(alerts: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the id of the incident that each alert of a batch belonged to when it came."""
    keyed = alerts.withColumns({"_source": F.coalesce("_src_ip", F.lit("unknown")), "_second": F.floor(F.unix_micros(F.col("alert_ts").cast("timestamp")) / 1_000_000)})
    named = found.select(F.col("src_ip").alias("_source"), F.col("s").alias("_second"), "incident_id")
    return keyed.join(named, ["_source", "_second"], "left").drop("_source", "_second")


def closed_incidents(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """(incident_id, status, closed_by): the incidents that a batch closed."""
    return spark.read.schema("incident_id bigint, status string, closed_by bigint").parquet(f"{root}/incident_updates/batch={batch_id}")


def incident_names(stored: DataFrame) -> DataFrame:
    """(incident_id, live_id): for each incident that was taken over, the one that goes on in the end.

    One incident may be taken over by another that is itself taken over later. Every round looks two steps as far
    as the one before (pointer jumping), so the number of rounds grows with the logarithm of the longest chain.
    """
    newest = stored.groupBy("incident_id").agg(F.max_by("closed_by", "batch").alias("live_id")).where("live_id IS NOT NULL")
    now = stage(newest, "taken-over")
    while True:
        further = now.select(F.col("incident_id").alias("live_id"), F.col("live_id").alias("next"))
        moved = stage(now.join(further, "live_id", "left").select("incident_id", F.coalesce("next", "live_id").alias("live_id"), F.col("next").isNotNull().alias("moved")), "taken-over")
        now = moved.select("incident_id", "live_id")
        if moved.where("moved").isEmpty():
            return now


def current_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Stored alerts with the id of the incident that they belong to now."""
    alerts = spark.read.parquet(f"{root}/alerts").drop("batch")
    names = incident_names(_stored(spark, root))
    return alerts.join(names, "incident_id", "left").withColumn("incident_id", F.coalesce("live_id", "incident_id")).drop("live_id")


def compact_incidents(spark: SparkSession, root: str) -> int:
    """Writes the newest version of every incident as one table, which later readers start from; gives its batch number.

    What was taken over names the incident that goes on. The versions by batch stay where they are.
    """
    stored = _stored(spark, root)
    last = stored.agg(F.max("batch")).first()[0]
    if last is None:
        return -1
    columns = [c for c in stored.columns if c not in ("incident_id", "batch")]
    newest = stored.groupBy("incident_id").agg(F.max_by(F.struct(*columns), "batch").alias("v")).select("incident_id", "v.*")
    named = newest.join(incident_names(stored), "incident_id", "left").withColumn("closed_by", F.coalesce("live_id", "closed_by")).drop("live_id")
    named.withColumn("batch", F.lit(last).cast("bigint")).write.mode("overwrite").parquet(f"{root}/incidents_compact/upto={last}")
    return last


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Versions of incidents: the newest compacted table, and the batches after it."""
    schema = _LIVE + ", batch bigint"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/incidents_compact")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(str(s.getPath().getName()).split("=")[1]) for s in files.listStatus(path)
            if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if files.exists(path) else []
    later = spark.read.schema(schema).parquet(f"{root}/incidents")
    if not done:
        return later
    compact = spark.read.schema(schema).parquet(f"{root}/incidents_compact/upto={max(done)}")
    return compact.unionByName(later.where(F.col("batch") > max(done)))


def latest_parts(stored: DataFrame) -> DataFrame:
    """The newest version of each incident that no other one has taken over."""
    newest = stored.groupBy("incident_id").agg(F.max_by(F.struct(*[c for c in stored.columns if c not in ("incident_id", "batch")]), "batch").alias("v"))
    return newest.select("incident_id", "v.*").where("closed_by IS NULL").drop("closed_by")


def live_incidents(spark: SparkSession, root: str, as_of, window_seconds: float) -> DataFrame:
    """Incidents with their status at ``as_of`` (a timestamp, or a Column)."""
    stored = _stored(spark, root)
    end = F.timestamp_micros("last_us")
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    idle = F.unix_micros(now.cast("timestamp")) - F.col("last_us")
    return latest_parts(stored).select(
        "incident_id", F.timestamp_micros("first_us").alias("start_time"), end.alias("end_time"),
        "src_ip", F.col("n").alias("alert_count"), severity_name(F.col("rank")).alias("max_severity"),
        F.when(idle > to_micros(window_seconds), "closed").otherwise("active").alias("status"), *INTEL)
