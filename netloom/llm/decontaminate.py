"""Benchmark passages in training documents, found through an FM-index of every shard.

A shard is what a task reads up to about a million words. Its words become numbers by the benchmark's
vocabulary; other words, and runs too short to hold any test phrase, can be no part of an occurrence and
become separators. The phrases (each ``width`` consecutive words of an item; a shorter item is one phrase)
are searched backward through wavelet-tree ranks, all at once, and located by sampled suffix positions.
Overlapping occurrences are merged into removal spans.

The benchmark is streamed through the driver in blocks of at most ``BLOCK_BYTES`` of text; each block is one
pass over the documents, to which it adds its spans and items. Documents are never shuffled.

Defined results: NULL text has no words; an item without words has no phrases; items with equal phrases are
all reported; an item whose identifier is NULL marks words but is not named; repeated rows each get their
result; empty tables give empty results or no hits; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import common
from netloom.llm.fm_index import FMIndex
from netloom.session import stage

BLOCK_BYTES, SHARD_WORDS, SLICE_BYTES = 16 << 20, 1 << 20, 1 << 20

# A-Z fall to lower case; ASCII letters, digits and every byte above ASCII belong to words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _word_numbers(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Number of each word, 0 outside the vocabulary; a long text is taken slice by slice."""
    folded = text.encode().translate(_FOLD)
    parts, at = [], 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= SLICE_BYTES else folded.find(b" ", at + SLICE_BYTES)
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        parts.append(np.fromiter(map(vocabulary.get, words, repeat(0)), dtype=np.int32, count=len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


class Phrases:
    """A block of the benchmark: vocabulary, different phrases (reversed, padded with 0) and their items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            words = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            for at in range(max(1, len(words) - width + 1) if words else 0):
                named = found.setdefault(words[at : at + width], [])
                if item is not None and item not in named[-1:]:
                    named.append(item)
        self.items = list(found.values())
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        self.reversed = np.zeros((len(found), width), dtype=np.int64)
        for i, phrase in enumerate(found):
            self.reversed[i, : len(phrase)] = phrase[::-1]


def _shard_hits(numbers: list[np.ndarray], phrases: Phrases) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Merged spans of words, and items, by document of the shard."""
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    if not phrases.shortest or not numbers:
        return spans, items
    heads = np.cumsum([0, *(len(n) + 1 for n in numbers[:-1])])
    every = np.concatenate([x for n in numbers for x in (n, np.zeros(1, dtype=np.int32))])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], every != 0, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= phrases.shortest
    if not long.any():
        return spans, items
    change = np.zeros(len(every) + 2, dtype=np.int32)
    change[starts[long]] += 1
    change[ends[long] + 1] -= 1  # the separator after a run stays
    at = np.flatnonzero(np.cumsum(change)[: len(every)])
    index = FMIndex(every[at])
    low, high = index.search(phrases.reversed, phrases.lengths)
    hit = np.flatnonzero(low < high)
    many = (high - low)[hit]
    if not len(hit):
        return spans, items
    phrase = np.repeat(hit, many)
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
    place = index.locate(rows)
    doc = np.searchsorted(heads, at[place], side="right") - 1
    for d, p in np.unique(np.stack([doc, phrase]), axis=1).T.tolist():
        items.setdefault(d, set()).update(phrases.items[p])
    change = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + phrases.lengths[phrase], -1)
    covered = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    edges = np.flatnonzero(np.diff(covered.astype(np.int8)))
    for start, end in zip(at[edges[::2]].tolist(), edges[1::2] - edges[::2], strict=True):
        d = int(np.searchsorted(heads, start, side="right") - 1)
        spans.setdefault(d, []).append((start - int(heads[d]), start - int(heads[d]) + int(end)))
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _search(phrases: Phrases):
    """Adds a block's spans and items to documents, shard by shard."""

    def done(batches: list[pa.RecordBatch], numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        spans, items = _shard_hits(numbers, phrases)
        at = 0
        for batch in batches:
            own = range(at, at := at + batch.num_rows)
            columns = {c: batch.column(c) for c in batch.schema.names}
            old = zip(own, columns["spans"].to_pylist(), columns["items"].to_pylist(), strict=True)
            rows = [(_merged([*((s["start"], s["end"]) for s in a), *spans.get(i, [])]), sorted({*b, *items.get(i, ())})) for i, a, b in old]
            columns["n_words"] = pa.array([len(numbers[i]) for i in own], pa.int64())
            columns["spans"] = pa.array([[{"start": a, "end": b} for a, b in r[0]] for r in rows], columns["spans"].type)
            columns["items"] = pa.array([r[1] for r in rows], columns["items"].type)
            yield pa.RecordBatch.from_pydict(columns)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, words = [], [], 0
        for batch in common.pieces_of(batches):
            own = [_word_numbers(t.as_py() or "", phrases.vocabulary) for t in batch.column("content")]
            held.append(batch)
            numbers += own
            words += sum(map(len, own))
            if words >= SHARD_WORDS:
                yield from done(held, numbers)
                held, numbers, words = [], [], 0
        yield from done(held, numbers)

    return searched


def _blocks(benchmark: DataFrame, item: str, text: str, width: int) -> Iterator[Phrases]:
    block, size, any_ = [], 0, False
    for row in benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("content")).toLocalIterator():
        if row["content"]:
            if block and size + len(row["content"]) > BLOCK_BYTES:
                yield Phrases(block, width)
                block, size, any_ = [], 0, True
            block.append((row["item"], row["content"]))
            size += len(row["content"])
    if block or not any_:
        yield Phrases(block, width)


def mark_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep_rows: bool = False,
                   ident: str = common.ID, text: str = common.TEXT, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, content, n_words, spans (start and end word of each removal), items[, row: the whole input row]."""
    common.tune(docs.sparkSession)
    marked = docs.select(
        F.col(ident).alias("doc_id"), F.col(text).alias("content"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_rows else []))
    for number, phrases in enumerate(_blocks(benchmark, item, item_text, width)):
        marked = (stage(marked, "marked") if number else marked).mapInArrow(_search(phrases), marked.schema)
    return marked


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, **names: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words in removal spans), n_items, items_sha256, contaminated, spans."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return mark_documents(docs, benchmark, width, **names).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, **names: str) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark phrase."""
    marked = mark_documents(docs, benchmark, width, keep_rows=True, **names).where("size(spans) = 0")
    return marked.select([F.col("row").getField(c).alias(c) for c in docs.columns])


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of its removal spans, and without what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)] if spans else []
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join(out) + text[at:]
