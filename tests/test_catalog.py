"""Catalogue queries against their SQL. All of them with NETLOOM_ALL=1, otherwise a cross-section."""

import os

import compare
import pytest

from netloom.plans import catalog, checks

SOME = ["flows_all", "flows_multi_sensor", "rules_as_data", "alerts_dedup", "incidents_all", "cidr_longest", "blocked_ips", "label_join", "train_union", "stratified_split", "stats_snapshot", "stream_incidents"]
NAMES = list(checks.SQL) if os.environ.get("NETLOOM_ALL") else SOME
SF = os.environ.get("NETLOOM_SF", "sf0.001")


def test_every_sql_has_a_query():
    assert set(checks.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    sf = f"{compare.DATA}/{SF}"
    got = compare.run_spark(catalog.QUERIES[name], spark, sf)
    assert compare.differences(got, compare.run_sql(checks.SQL[name], sf)) == []
