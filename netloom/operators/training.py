"""Training tables: harmonise, clean, label, unite, balance, evaluate."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.values import INF
from netloom.operators.features import online_features
from netloom.operators.ranking import newest
from netloom.schemas import FEATURE_COLS

# Header of the public flow data set -> our column.
PUBLIC_HEADERS = {
    "Destination Port": "dst_port",
    "Flow Duration": "duration",
    "Total Length of Fwd Packets": "src_bytes",
    "Total Length of Bwd Packets": "dst_bytes",
    "Total Fwd Packets": "fwd_count",
    "Total Backward Packets": "bwd_count",
    "Packet Length Mean": "avg_packet_len",
    "Packet Length Std": "std_packet_len",
    "Flow Bytes/s": "flow_bytes_per_sec",
    "Flow Packets/s": "flow_packets_per_sec",
    "Fwd Packet Length Max": "fwd_packet_len_max",
    "Bwd Packet Length Max": "bwd_packet_len_max",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Flow IAT Max": "flow_iat_max",
    "Flow IAT Min": "flow_iat_min",
    "FIN Flag Count": "fin_flag_count",
    "SYN Flag Count": "syn_flag_count",
    "RST Flag Count": "rst_flag_count",
    "PSH Flag Count": "psh_flag_count",
    "ACK Flag Count": "ack_flag_count",
    "Label": "label",
}
TIME_COLS = ["duration", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min"]
MIN_ALERTS, MIN_ROWS = 20, 50


def harmonise(raw: DataFrame, keep: tuple[str, ...] = (), time_scale: float = 1.0) -> DataFrame:
    """Blanks off the headers, our names, total packet count where its two parts exist, label as
    trimmed text; only known columns (and ``keep``) stay. ``time_scale`` converts time units."""
    df = raw.toDF(*[c.strip() for c in raw.columns]).withColumnsRenamed(PUBLIC_HEADERS)
    if {"fwd_count", "bwd_count"} <= set(df.columns):
        df = df.withColumn("packet_count", F.col("fwd_count").cast("double") + F.col("bwd_count").cast("double"))
    cols: list[Column] = []
    for name in FEATURE_COLS:
        if name in df.columns:
            value = _to_double(df, name)
            cols.append((value * time_scale if name in TIME_COLS and time_scale != 1.0 else value).alias(name))
    if "label" in df.columns:
        cols.append(F.trim(F.col("label").cast("string")).alias("label"))
    return df.select(*keep, *cols)


def _to_double(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    return F.trim(col).try_cast("double") if df.schema[name].dataType.typeName() == "string" else col.cast("double")


def binarise(df: DataFrame) -> DataFrame:
    """Adds ``is_attack``: 0 for BENIGN in any case, 1 for every other label."""
    return df.withColumn("is_attack", (F.upper(F.trim("label")) != "BENIGN").cast("int"))


def _features_in(df: DataFrame) -> list[str]:
    return [c for c in FEATURE_COLS if c in df.columns]


def clean_strict(df: DataFrame) -> DataFrame:
    """Rows with an infinite, NaN or missing feature, or without label, are dropped."""
    # NaN sorts above infinity, so one comparison rules out NULL, NaN and both infinities.
    finite = [F.abs(c) < INF for c in _features_in(df)]
    return binarise(df.where(reduce(and_, finite, F.col("label").isNotNull())))


def clean_lenient(df: DataFrame) -> DataFrame:
    """Infinities become 0; rows with a NaN or missing feature, or without label, are dropped."""
    cols = _features_in(df)
    known = [F.col(c) <= INF for c in cols]
    kept = df.where(reduce(and_, known, F.col("label").isNotNull()))
    return binarise(kept.withColumns({c: F.when(F.abs(c) < INF, F.col(c)).otherwise(0.0) for c in cols}))


def unite(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns go by name and absent ones read NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("is_attack").agg(F.count(F.lit(1)).alias("n"))


def class_gate(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row: n_benign, n_attack, and whether there is enough of both to train."""
    c = df.agg(F.count_if(F.col("is_attack") == 0).alias("n_benign"), F.count_if(F.col("is_attack") == 1).alias("n_attack"))
    ok = (F.col("n_benign") > 0) & (F.col("n_attack") > 0) & (F.col("n_benign") + F.col("n_attack") > min_rows)
    return c.withColumn("trainable", ok)


def online_set(alerts: DataFrame, flows: DataFrame, ts: str = "_logged_at", tie: str = "flow_id",
               max_alerts: int = 5000, max_benign: int = 5000, low_score: float = 0.3) -> DataFrame:
    """Newest alerts as attacks plus low-scored flows among the newest as benign, cleaned features."""
    attacks = newest(alerts, max_alerts, ts, tie).withColumn("is_attack", F.lit(1))
    recent = newest(flows, 3 * max_benign, ts, tie)
    if "score" in flows.columns:
        recent = recent.where(F.col("score") < low_score)
    benign = recent.orderBy(ts, tie).limit(max_benign).withColumn("is_attack", F.lit(0))
    return online_features(unite(attacks, benign), keep=("is_attack",))


def online_gate(alerts: DataFrame, training: DataFrame, min_alerts: int = MIN_ALERTS, min_rows: int = MIN_ROWS) -> bool:
    """Is there enough logged to retrain? Looks at no more rows than the two limits."""
    return alerts.limit(min_alerts).count() >= min_alerts and training.limit(min_rows).count() >= min_rows


def confusion(df: DataFrame, truth: str = "is_attack", pred: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    t, p = F.col(truth).cast("int"), F.col(pred).cast("int")
    return df.agg(*[F.count_if((t == a) & (p == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def class_report(df: DataFrame, truth: str = "is_attack", pred: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) for both classes; an empty denominator reads 0."""
    c = confusion(df, truth, pred)

    def part(name, hit, wrong, missed):
        hit, wrong, missed = F.col(hit), F.col(wrong), F.col(missed)
        div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
        return F.struct(
            F.lit(name).alias("class"), F.round(div(hit, hit + wrong), 6).alias("precision"), F.round(div(hit, hit + missed), 6).alias("recall"),
            F.round(div(2 * hit, 2 * hit + wrong + missed), 6).alias("f1"), (hit + missed).alias("support"))

    return c.select(F.explode(F.array(part("Benign", "tn", "fn", "fp"), part("Attack", "tp", "fp", "fn"))).alias("r")).select("r.*")
