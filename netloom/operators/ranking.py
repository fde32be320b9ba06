"""Exact ranks without sorting a table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import stage


def top_counts(df: DataFrame, column: str, n: int, count_name: str = "n") -> DataFrame:
    """The ``n`` most frequent values; ties go to the smaller value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
    return counts.orderBy(F.col(count_name).desc(), F.col(column)).limit(n)


def newest(df: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """The ``n`` newest rows in chronological order."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n).orderBy(ts, tie)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """(p, value): quantiles with linear interpolation between neighbours, exact.

    Equal values are merged, the rest is range-partitioned and written; counts by part and their prefix
    sums tell which part holds each rank, and only those parts are counted through, each by itself.
    """
    vals = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    merged = vals.groupBy("v").agg(F.count(F.lit(1)).alias("c")).repartitionByRange("v")
    held = stage(merged.withColumn("part", F.spark_partition_id()), "quantiles")
    parts = held.groupBy("part").agg(F.sum("c").alias("rows"))  # a row for each partition
    upto = F.sum("rows").over(Window.orderBy("part"))
    placed = parts.withColumns({"before": upto - F.col("rows"), "n": F.sum("rows").over(Window.partitionBy())})
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    at = placed.select("part", "rows", "before", "n", F.explode(wanted).alias("w")).select(
        "part", "rows", "before", "w.i", "w.p", ((F.col("n") - 1) * F.col("w.p")).alias("at"))
    ends = at.select("*", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    inside = ends.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("rows")))
    running = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    counted = held.join(inside.select("part").distinct(), "part", "left_semi").withColumn("upto", running)
    picked = inside.join(counted, "part").where(F.col("before") + F.col("upto") > F.col("rank")).groupBy("i", "p", "at", "rank").agg(F.min("v").alias("v"))
    both = picked.groupBy("i", "p", "at").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    return both.select("p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"))


def order_hash(ids: Sequence[str], seed: int) -> Column:
    """Hex digest that orders rows at random but the same way on every run."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


DIGITS = 4  # hex digits that one pass counts by
RANKED_ROWS = 1 << 16  # rows that are ranked in one task


def rank_cuts(df: DataFrame, group: Column, digest: Column, keep: Column, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """(g, cut): the digest of the ``keep``-th row of each group in digest order.

    Rows are counted by the first four hex digits; the prefix that holds the wanted row is counted by the next four,
    and so on until it holds no more than ``ranked_rows`` rows, which are ranked. ``keep`` is an expression over ``n``.
    """
    rows = df.select(group.alias("g"), digest.alias("h"))
    counts = rows.groupBy("g", F.substring("h", 1, DIGITS).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("g")
    edge = _edge(counts.withColumn("n", F.sum("c").over(whole)).withColumn("k", keep))
    digits = DIGITS
    while digits < 32 and (edge.agg(F.max("c")).first()[0] or 0) > ranked_rows:
        inside = rows.withColumn("p", F.substring("h", 1, digits)).join(edge.select("g", "p", F.col("need").alias("k")), ["g", "p"])
        digits += DIGITS
        counts = inside.groupBy("g", F.substring("h", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("c"), F.first("k").alias("k"))
        edge = _edge(counts)
    rank = F.row_number().over(Window.partitionBy("g", "p").orderBy("h"))
    if digits >= 32:  # all rows left of a group have one digest
        return edge.select("g", F.col("p").alias("cut"))
    in_edge = rows.withColumn("p", F.substring("h", 1, digits)).join(edge.select("g", "p", "need"), ["g", "p"])
    return in_edge.withColumn("r", rank).where(F.col("r") == F.col("need")).select("g", F.col("h").alias("cut"))


def _edge(counts: DataFrame) -> DataFrame:
    """Of prefixes with their counts, the one that holds each group's ``k``-th row, and that row's place in it."""
    upto = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(upto))
    held = placed.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
    return stage(held.select("g", "p", "c", (F.col("k") - F.col("upto") + F.col("c")).alias("need")), "rank-edge")


def stratified_split(df: DataFrame, label: str, ids: Sequence[str], train: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: floor(train * n) rows of each of the label's two classes, in digest order."""
    digest = order_hash(ids, seed)
    cuts = stage(rank_cuts(df, F.col(label), digest, F.floor(F.col("n") * F.lit(float(train)) + F.lit(1e-9))), "cuts")  # once, not by every reader
    # One entry per class of a binary label.
    by_class = cuts.agg(F.map_from_entries(F.collect_list(F.struct("g", "cut")))).scalar()
    cut = F.try_element_at(by_class, F.col(label))
    return df.withColumn("is_train", F.coalesce(digest <= cut, F.lit(False)))


def shuffled_head(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """A random but repeatable choice of ``n`` rows (all rows if there are fewer)."""
    digest = order_hash(ids, seed)
    cut = rank_cuts(df, F.lit(0), digest, F.least(F.col("n"), F.lit(n))).agg(F.max("cut")).scalar()
    return df.where(digest <= cut)


def exact_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc, positives, negatives): the probability that a positive row scores above a negative one, ties counting half.

    Rows are counted by score; the different scores are range-partitioned and written, and prefix sums over partitions
    and inside them give the negatives below each score. Rows without score or label are left out; without both
    classes the AUC is NULL.
    """
    counts = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) != 0).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    held = stage(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "auc")
    parts = held.groupBy("part").agg(F.sum("neg").alias("neg"))  # a row for each partition
    before = F.coalesce(F.sum("neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = held.withColumn("below", inside).join(parts.select("part", before.alias("before")), "part")
    won = F.col("pos").cast("decimal(38,1)") * (F.col("before") + F.col("below") + F.col("neg") / F.lit(2)).cast("decimal(20,1)")
    total = below.agg(F.sum(won.cast("decimal(38,1)")).alias("won"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return total.select(F.when(pairs > 0, F.col("won").cast("double") / pairs).alias("auc"), "positives", "negatives")
