"""Token counts of documents through a table of counts by content digest.

A text's digest and the tokenizer's version digest are the key. Texts whose key is stored take the stored
count; of all others one copy of each different text is encoded, and its count is appended to the table.
The table is a folder of Parquet files, one sub-folder for each tokenizer version, so runs over other
corpora add to it and a new tokenizer never meets old counts.

Copies are merged before the shuffle (one row for each task and digest). The counts are joined back to
(identifier, digest) rows without texts; a digest that very many rows share is split by the adaptive join.

Defined results: NULL text counts as empty text (0 bytes, 0 tokens); contents are not normalised beyond
that, as any change of the text could change its count; repeated rows are returned as often as they come;
an empty table gives an empty result and leaves the cache as it is; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import bytebpe, common
from netloom.session import stage

_STORED = "digest binary, n_tokens long"


def stored_counts(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty if there is no cache yet."""
    spark = docs.sparkSession
    path = f"{cache}/version={version}"
    try:
        return spark.read.schema(_STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def append_missing(docs: DataFrame, cache: str, tokenizer: str, ranks: str | None = None, text: str = common.TEXT) -> None:
    """Encodes the different texts of ``docs`` that the cache lacks, and appends their counts."""
    version = bytebpe.version_digest(tokenizer)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = bytebpe.encoder(tokenizer, ranks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([encoder.count(t.as_py()) for t in batch.column("content")], pa.int64())], ["digest", "n_tokens"])

    texts = docs.select(_digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    missing = texts.groupBy("digest").agg(F.first("content").alias("content")).join(stored_counts(docs, cache, version), "digest", "left_anti")
    missing.mapInArrow(counted, _STORED).write.mode("append").parquet(f"{cache}/version={version}")


def token_counts(docs: DataFrame, cache: str, tokenizer: str, ranks: str | None = None, limit: int = 1024,
                 text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """One row per document: identifier, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is a file of the `tokenizers` library on every executor; ``ranks`` may name a rank file of the
    same vocabulary, which is checked, for faster merges.
    """
    if ranks and not bytebpe.same_vocabulary(tokenizer, ranks):
        raise ValueError(f"{ranks} has another vocabulary than {tokenizer}")
    common.tune(docs.sparkSession)
    append_missing(docs, cache, tokenizer, ranks, text)
    # Two runs may append the same digest; one count is as good as the other. Written, so that the join below
    # reads both sides from plain exchanges, whose hot partitions the adaptive join can split.
    counts = stage(stored_counts(docs, cache, bytebpe.version_digest(tokenizer)).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")), "counts")
    rows = docs.select(F.col(ident), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), _digest(text).alias("digest"))
    return rows.join(counts, "digest", "left").select(ident, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
