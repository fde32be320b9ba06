"""Runs a catalogue query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("NETLOOM_DATA", "/root/testdata")


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    return str(v)


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return abs(a - b) <= 1.1e-6 * max(1.0, abs(a) * 1e-3)
    return a == b


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda t: [(x is not None, str(type(x)), str(x)) for x in t])


def run_sql(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(names, cur.fetchall())


def run_spark(fn, spark, sf_dir: str):
    df = fn(spark, sf_dir)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def differences(got, want, limit: int = 3) -> list[str]:
    (gn, gr), (wn, wr) = got, want
    if gn != wn:
        return [f"columns {gn} != {wn}"]
    if len(gr) != len(wr):
        only = [r for r in gr if r not in set(wr)][:limit], [r for r in wr if r not in set(gr)][:limit]
        return [f"{len(gr)} rows != {len(wr)}", f"only spark {only[0]}", f"only sql {only[1]}"]
    bad = [(g, w) for g, w in zip(gr, wr) if not all(_same(a, b) for a, b in zip(g, w))]
    exact = sum(g != w for g, w in zip(gr, wr))
    out = [f"{len(bad)} rows differ: {g} != {w}" for g, w in bad[:limit]]
    if not bad and exact:
        out.append(f"INEXACT {exact} rows differ in the last digit: {next((g, w) for g, w in zip(gr, wr) if g != w)}")
    return out


def most_rows(df) -> int:
    """Runs a DataFrame and gives the largest number of rows that any step of its plan put out."""
    spark = df.sparkSession
    store = spark._jsparkSession.sharedState().statusStore()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    number = store.executionsList().last().executionId()
    nodes, values, most = store.planGraph(number).allNodes(), store.executionMetrics(number), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for k in range(metrics.size()):
            if metrics.apply(k).name() == "number of output rows" and values.contains(metrics.apply(k).accumulatorId()):
                most = max(most, int(values.apply(metrics.apply(k).accumulatorId()).replace(",", "")))
    return most
