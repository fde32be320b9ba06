"""The detection pipeline: packets -> flows -> scores -> alerts -> fired, enriched, correlated."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.alerts import raise_alerts, with_rules_only_score
from netloom.operators.dedup import deduplicate
from netloom.operators.flows import aggregate_flows
from netloom.operators.incidents import assign_incidents, correlate
from netloom.operators.intel import enrich
from netloom.operators.rules import Rule, default_rules, first_match


@dataclass
class DetectConfig:
    gap_seconds: float = 20.0
    dedup_seconds: float = 60.0
    incident_seconds: float = 180.0
    home_nets: Iterable[str] = ()
    rules: Sequence[Rule] = field(default_factory=default_rules)
    scorer: Callable[[DataFrame], DataFrame] = with_rules_only_score
    incident_lateness_seconds: float = 86400.0  # how far behind the newest alert a streamed one may come


def detect_flows(packets: DataFrame, cfg: DetectConfig) -> DataFrame:
    return cfg.scorer(aggregate_flows(packets, cfg.gap_seconds, cfg.home_nets))


def detect_alerts(scored: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Every alert, before suppression."""
    return raise_alerts(scored, first_match(scored, cfg.rules))


def finish_alerts(alerts: DataFrame, cfg: DetectConfig, blocklist: DataFrame | None = None, geo: DataFrame | None = None) -> DataFrame:
    """Suppression, then enrichment, then the incident of each alert that fired."""
    fired = deduplicate(alerts, cfg.dedup_seconds)
    if blocklist is not None and geo is not None:
        fired = enrich(fired, blocklist, geo)
    return assign_incidents(fired, cfg.incident_seconds)


def incidents_of(alerts: DataFrame, cfg: DetectConfig, as_of: Column | None = None) -> DataFrame:
    return correlate(alerts, cfg.incident_seconds, as_of)
