"""Exact duplicates by sorting contents.

Sampled splitters range-partition the normalised texts, every partition is sorted (Spark's external
sort), equal texts become neighbours and each text is compared in full with the one before it. A text
shared by very many rows spans several partitions, as the identifier is part of the range key; only the
first and last run of each partition can continue elsewhere, and these few are matched by full text.

Splitters are sampled to the driver, so the range key is bounded: the first bytes of the text, a 64-bit
hash and the identifier. Both are functions of the text, so equal texts stay neighbours; within a
partition the sort compares whole texts.

Defined results: NULL text counts as empty text; NULL identifiers are never kept beside a non-NULL one;
`distinct_documents` keeps exactly one of equal rows, `duplicate_groups` marks every row that has the kept
identifier; an empty table gives an empty result; other columns play no part,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import common
from netloom.session import stage

PREFIX_CHARS = 24  # of the text, in the range key
_RUN_BITS = 40  # a run's number: partition above these bits, order within it below


def _lower_ascii(column: str):
    def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pc.ascii_lower(batch.column(at)))

    return lowered


def _sorted_contents(docs: DataFrame, text: str, ident: str, keep: str, whole_rows: bool) -> DataFrame:
    """(_id, _norm[, _row]) range-partitioned and sorted, the row to keep first among equal texts."""
    rows = docs.select(
        F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_norm"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if whole_rows else []))
    rows = rows.mapInArrow(_lower_ascii("_norm"), rows.schema)
    first = F.desc_nulls_last("_id") if keep == "max" else F.asc_nulls_last("_id")
    # The text alone would leave a hot text in one partition; the row's place splits even equal identifiers.
    rows = rows.withColumns({
        "_head": F.substring("_norm", 1, PREFIX_CHARS), "_hash": F.xxhash64("_norm"), "_place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("_head", "_hash", first, "_place")
    return rows.sortWithinPartitions("_head", "_hash", "_norm", first, "_place")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the rows at which a new text begins, by full comparison with the row before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("_norm")
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or text[0].as_py() != last
        last = text[-1].as_py()
        yield batch, new


_GROUP_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()),
    T.StructField("text_sha256", T.StringType()), T.StructField("run", T.LongType()), T.StructField("edge_text", T.StringType())])


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its run's kept id and size; then the partition's first and last run again, with their text."""
    names = [f.name for f in _GROUP_SCHEMA]
    base, runs, edge = common.numbered_part() << _RUN_BITS, 0, None
    ids: list[np.ndarray] = []
    valid: list[np.ndarray] = []
    text = ""

    def close():
        nonlocal edge
        values, known = np.concatenate(ids), np.concatenate(valid)
        n, kept = len(values), int(values[0]) if known[0] else None
        columns = [pa.array(values, mask=~known), pa.array([kept] * n, pa.int64()), pa.array(np.full(n, n)),
                   pa.array([hashlib.sha256(text.encode()).hexdigest()] * n), pa.array(np.full(n, base + runs)), pa.nulls(n, pa.string())]
        edge = [None, kept, n, None, base + runs, text]
        return pa.RecordBatch.from_arrays(columns, names)

    def edge_rows():
        return pa.RecordBatch.from_arrays([pa.array([v], c.type) for v, c in zip(edge, _arrow_fields(), strict=True)], names)

    waiting, rows = [], 0
    for batch, new in _runs(batches):
        id_column = batch.column("_id")
        known = id_column.is_valid().to_numpy(zero_copy_only=False)
        values = pc.fill_null(id_column, 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        for start, end in zip(bounds := [0, *(np.flatnonzero(new[1:]) + 1), len(new)], bounds[1:], strict=False):
            if new[start] and ids:
                waiting.append(done := close())
                rows += done.num_rows
                if runs == 0:
                    yield edge_rows()
                ids, valid, runs = [], [], runs + 1
            if new[start]:
                text = batch.column("_norm")[int(start)].as_py()
            ids.append(values[start:end])
            valid.append(known[start:end])
            if rows >= 4096:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, rows = [], 0
    if ids:
        waiting.append(close())
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        yield edge_rows()


def _arrow_fields() -> list[pa.Field]:
    kinds = {T.LongType: pa.int64(), T.StringType: pa.string()}
    return [pa.field(f.name, kinds[type(f.dataType)]) for f in _GROUP_SCHEMA]


def duplicate_groups(docs: DataFrame, text: str = common.TEXT, ident: str = common.ID, keep: str = "min") -> DataFrame:
    """One row per document: doc_id, keep_id (the identifier that stays), group_size, kept, text_sha256.

    ``keep`` is "min" or "max". Identifiers are integers.
    """
    common.tune(docs.sparkSession)
    found = stage(_sorted_contents(docs, text, ident, keep, False).mapInArrow(_group_rows, _GROUP_SCHEMA), "content-runs")
    # At most two rows for each partition of the sort, whatever the data: small enough to broadcast.
    edges = found.where("edge_text IS NOT NULL").select("run", "edge_text", "keep_id", "group_size").distinct()
    best = F.max("keep_id") if keep == "max" else F.min("keep_id")
    joined = (edges.groupBy("edge_text").agg(best.alias("all_keep"), F.sum("group_size").alias("all_size"), F.collect_list("run").alias("runs"))
              .where("size(runs) > 1").select(F.explode("runs").alias("run"), "all_keep", "all_size"))
    rows = found.where("edge_text IS NULL").join(F.broadcast(joined), "run", "left")
    return rows.select(
        "doc_id", (keep_id := F.coalesce("all_keep", "keep_id")).alias("keep_id"), F.coalesce("all_size", "group_size").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep_id, F.lit(False)).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, text: str = common.TEXT, ident: str = common.ID, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one row for each different text."""
    common.tune(docs.sparkSession)
    ordered = _sorted_contents(docs, text, ident, keep, True)
    row = ordered.schema["_row"]
    schema = T.StructType([T.StructField("_row", row.dataType), T.StructField("run", T.LongType()), T.StructField("edge_text", T.StringType())])

    def heads(batches):
        base, runs, first, last = common.numbered_part() << _RUN_BITS, -1, None, None
        kind = None
        for batch, new in _runs(batches):
            at = np.flatnonzero(new)
            kind = batch.column("_row").type
            if len(at):
                if first is None:
                    first = batch.column("_norm")[0].as_py()
                last = batch.column("_norm")[int(at[-1])].as_py()
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("_row"), pa.array(base + runs + 1 + np.arange(len(at))), pa.nulls(len(at), pa.string())], schema.names)
                runs += len(at)
        if first is not None:
            edges = {base: first, base + runs: last}
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(edges), kind), pa.array([*edges], pa.int64()), pa.array([*edges.values()], pa.string())], schema.names)

    found = stage(ordered.mapInArrow(heads, schema), "content-heads")
    edges = found.where("edge_text IS NOT NULL").select("run", "edge_text")
    # Runs that continue one from an earlier partition; at most one for each partition of the sort.
    later = (edges.groupBy("edge_text").agg(F.collect_list("run").alias("runs")).where("size(runs) > 1")
             .select(F.explode(F.filter("runs", lambda r: r > F.array_min("runs"))).alias("run")))
    kept = found.where("edge_text IS NULL").join(F.broadcast(later), "run", "left_anti")
    return kept.select([F.col("_row").getField(c).alias(c) for c in docs.columns])
