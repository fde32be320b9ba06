"""Scores -> labels -> severities -> alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.values import clip

# Lowest score of each severity, highest first.
SEVERITY_FLOORS = [("high", 0.92), ("medium", 0.80), ("low", 0.65)]
ATTACK_SCORE = 0.5
RF_WEIGHT, AE_WEIGHT = 0.65, 0.35


def severity_of(score: Column, floors=SEVERITY_FLOORS) -> Column:
    """Severity name, NULL below the lowest floor; NaN and NULL scores have none."""
    score = F.when(~F.isnan(score), score)
    name = F.lit(None).cast("string")
    for severity, floor in reversed(floors):
        name = F.when(score >= F.lit(floor), severity).otherwise(name)
    return name


def score_label(score: Column, cut: float = ATTACK_SCORE) -> Column:
    return F.when(score >= F.lit(cut), "ATTACK").otherwise("BENIGN")


def combine_scores(rf: Column | None, ae: Column | None, rf_weight: float = RF_WEIGHT, ae_weight: float = AE_WEIGHT) -> Column:
    """Weighted score in [0, 1]; with one model alone its score counts fully."""
    if rf is None and ae is None:
        raise ValueError("no model to score with")
    if ae is None:
        mixed = rf
    elif rf is None:
        mixed = ae
    else:
        mixed = rf * F.lit(rf_weight) + ae * F.lit(ae_weight)
    return clip(mixed, 0.0, 1.0)


def score_mode(rf: bool, ae: bool) -> str:
    return {(True, True): "ensemble", (True, False): "rf_only", (False, True): "ae_only"}.get((rf, ae), "unloaded")


def with_rules_only_score(flows: DataFrame) -> DataFrame:
    """Scores of a run without models."""
    return flows.withColumns({
        "score": F.lit(0.0), "rf_score": F.lit(None).cast("double"), "ae_score": F.lit(None).cast("double"),
        "label": F.lit("UNCERTAIN"),
    })


def with_scores(flows: DataFrame, rf: Column | None = None, ae: Column | None = None, **weights) -> DataFrame:
    zero = F.lit(0.0)
    scored = flows.withColumns({
        "rf_score": rf if rf is not None else zero,
        "ae_score": ae if ae is not None else zero,
    }).withColumn("score", combine_scores(
        F.col("rf_score") if rf is not None else None, F.col("ae_score") if ae is not None else None, **weights))
    return scored.withColumn("label", score_label(F.col("score")))


def raise_alerts(
    scored: DataFrame,
    signature: Column | None = None,
    rule_severity: Column | None = None,
    floors=SEVERITY_FLOORS,
) -> DataFrame:
    """Rows over a score floor or with a signature; each is labelled ATTACK.

    ``signature`` is any string column of the row, NULL for no match. A match makes the alert high,
    unless ``rule_severity`` gives another severity for it.
    """
    sig = signature if signature is not None else F.lit(None).cast("string")
    rows = scored.withColumns({"signature_match": sig, "_sev": severity_of(F.col("score"), floors)})
    rows = rows.where(F.col("_sev").isNotNull() | F.col("signature_match").isNotNull())
    matched = rule_severity if rule_severity is not None else F.lit("high")
    severity = F.when(F.col("signature_match").isNotNull(), matched).otherwise(F.coalesce("_sev", F.lit("low")))
    return rows.withColumns({
        "alert_id": F.col("flow_id"), "alert_ts": F.col("flow_end"),
        "severity": severity, "label": F.lit("ATTACK"),
    }).drop("_sev")
