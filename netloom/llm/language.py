"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds its
letters' vectors, each permuted (rotated) by its place, by multiplication; a text's vector bundles (adds) the
vectors of all its n-grams. A language's prototype is the bundle of all its texts, less the mean direction of
all languages, so that what they share does not count. A text gets the language of the closest prototype by
cosine.

An n-gram is bound once for each batch and weighted by its counts, which is the same sum. Prototypes are
summed by task, then by language and place in Spark; the driver gets languages x dimensions numbers, and at
most ``MAX_LANGUAGES`` languages are accepted.

Defined results: a text that is NULL or has no letters is ``und`` with score 0; so is every text if nothing
could be learned. Ties go to the first language in alphabetical order. Rows without a label teach nothing.
Repeated rows are treated like others; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm import common

DIMENSIONS, GRAM, SEED, MAX_LANGUAGES = 1024, 3, 7, 1000
UNKNOWN, SLICE_CHARS, BLOCK = "und", 1 << 20, 1024

_LETTERS: list[np.ndarray] = []
_VECTORS: dict[tuple[int, int, int], np.ndarray] = {}


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def _vector(letter: int, dimensions: int, seed: int) -> np.ndarray:
    key = (letter, dimensions, seed)
    if key not in _VECTORS:
        _VECTORS[key] = (np.random.default_rng([seed, letter]).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)
    return _VECTORS[key]


def _symbols(text: str) -> Iterator[np.ndarray]:
    """Lower-case letters as code points, one space for whatever stands between; long texts come in slices."""
    last = np.array([32], dtype=np.uint32)
    for at in range(0, len(text), SLICE_CHARS):
        points = np.frombuffer(text[at : at + SLICE_CHARS].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.concatenate([last, np.where(_is_letter()[points], points, 32), [] if at + SLICE_CHARS < len(text) else [32]]).astype(np.uint32)
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        yield points
        last = points[-(GRAM - 1) :]


def _bundle(parts: list[tuple[int, np.ndarray]], rows: int, gram: int, dimensions: int, seed: int) -> np.ndarray:
    """(rows x dimensions) sums of n-gram vectors; parts are (row, symbols)."""
    out = np.zeros((rows, dimensions), dtype=np.float32)
    parts = [p for p in parts if len(p[1]) >= gram]
    if not parts:
        return out
    symbols = np.concatenate([p[1] for p in parts])
    place = np.zeros(int(symbols.max()) + 1, dtype=np.int64)
    place[symbols] = 1
    alphabet = np.flatnonzero(place)
    place[alphabet] = np.arange(len(alphabet))
    coded = place[symbols]
    grams = np.zeros(len(symbols) - gram + 1, dtype=np.int64)
    for k in range(gram):
        grams = grams * len(alphabet) + coded[k : len(coded) - gram + 1 + k]
    row = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])[: len(grams)]
    inside = np.ones(len(grams), dtype=bool)  # n-grams never span two parts
    for end in np.cumsum([len(p[1]) for p in parts])[:-1]:
        inside[end - gram + 1 : end] = False
    grams, row = grams[inside], row[inside]
    if (span := len(alphabet) ** gram) <= 1 << 22:
        seen = np.zeros(span, dtype=np.int64)
        seen[grams] = 1
        different = np.flatnonzero(seen)
        seen[different] = np.arange(len(different))
        number = seen[grams]
    else:
        different, number = np.unique(grams, return_inverse=True)
    vectors = np.stack([_vector(int(c), dimensions, seed) for c in alphabet])
    turned = [np.roll(vectors, gram - 1 - k, axis=1) for k in range(gram)]
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    for at in range(0, len(different), BLOCK):
        part = different[at : at + BLOCK]
        bound = turned[gram - 1][part % len(alphabet)]
        for k in range(gram - 2, -1, -1):
            bound = bound * turned[k][part // len(alphabet) ** (gram - 1 - k) % len(alphabet)]
        lo, hi = np.searchsorted(number, [at, at + len(part)])
        counts = np.bincount(row[lo:hi] * len(part) + number[lo:hi] - at, minlength=rows * len(part)).reshape(rows, len(part))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def text_vectors(texts: list[str | None], owner: list[int], rows: int, gram: int = GRAM, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Bundles of texts; texts with the same owner (a row number) are added up."""
    out, parts, held = np.zeros((rows, dimensions)), [], 0
    for row, text in zip(owner, texts, strict=True):
        for symbols in _symbols(text or ""):
            if (symbols != 32).any():
                parts.append((row, symbols))
                held += len(symbols)
            if held >= SLICE_CHARS:
                out += _bundle(parts, rows, gram, dimensions, seed)
                parts, held = [], 0
    return out + _bundle(parts, rows, gram, dimensions, seed)


def learn(docs: DataFrame, label: str = "lang", text: str = common.TEXT, gram: int = GRAM, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (of length 1), from all rows with a label."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.pieces_of(batches):
            labels = batch.column("label").to_pylist()
            names = sorted(set(labels))
            found = text_vectors(batch.column("content").to_pylist(), [names.index(v) for v in labels], len(names), gram, dimensions, seed)
            for name, vector in zip(names, found, strict=True):
                sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions)), pa.array(vector)], ["label", "place", "amount"])

    rows = docs.select(F.col(label).alias("label"), F.col(text).alias("content")).where("label IS NOT NULL AND content IS NOT NULL")
    sums = rows.mapInArrow(summed, "label string, place long, amount double").groupBy("label", "place").agg(F.sum("amount").alias("amount"))
    found: dict[str, np.ndarray] = {}
    for r in sums.limit(MAX_LANGUAGES * dimensions + 1).collect():
        found.setdefault(r["label"], np.zeros(dimensions))[r["place"]] = r["amount"]
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(n for n, v in found.items() if v.any())
    if not names:
        return [], np.zeros((0, dimensions))
    profiles = np.stack([found[n] / np.linalg.norm(found[n]) for n in names])
    if len(names) > 1:
        profiles = profiles - profiles.mean(axis=0)
    return names, profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)


def _predictor(names: list[str], profiles: np.ndarray, gram: int, seed: int):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces_of(batches):
            texts = batch.column("content").to_pylist()
            vectors = text_vectors(texts, list(range(len(texts))), len(texts), gram, profiles.shape[1], seed)
            norm = np.linalg.norm(vectors, axis=1)
            known = (norm > 0) & bool(names)
            close = vectors @ profiles.T / np.maximum(norm, 1e-12)[:, None] if names else np.zeros((len(texts), 1))
            best = close.argmax(axis=1)
            columns = {c: batch.column(c) for c in batch.schema.names if c != "content"}
            columns["lang_pred"] = pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string())
            columns["score"] = pa.array(np.where(known, np.clip(close.max(axis=1), 0, 1), 0.0))
            yield pa.RecordBatch.from_pydict(columns)

    return predicted


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray, extra: dict[str, Column], text: str = common.TEXT, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """The columns of ``extra`` with lang_pred and score (cosine, 0 to 1)."""
    rows = docs.select(*(c.alias(name) for name, c in extra.items()), F.col(text).alias("content"))
    fields = [f for f in rows.schema if f.name != "content"]
    schema = rows.schema.__class__(fields).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_predictor(names, profiles, gram, seed), schema)


def held_out(ident: str = common.ID) -> Column:
    """Rows that are kept from learning: crc32 of the identifier's text leaves 2 when divided by 4."""
    return common.crc32_id(ident) % 4 == 2


def identify(docs: DataFrame, label: str = "lang", text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Held-out documents teach nothing."""
    common.tune(docs.sparkSession)
    names, profiles = learn(docs.where(~held_out(ident)), label, text)
    return predict(docs, names, profiles, {"doc_id": F.col(ident), "held_out": held_out(ident)}, text)


def accepted_documents(docs: DataFrame, languages: list[str] | None = None, least_score: float = 0.0, sure_chars: int = 256,
                       label: str = "lang", text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """The rows of ``docs`` whose predicted language is one of ``languages`` (None: any that was learned), all columns unchanged.

    Texts without any letter go. So do texts of ``sure_chars`` characters or more that are not even ``least_score`` close to the
    best language: the cosine of an unknown language scatters about 0 by 1 / sqrt(dimensions), 0.03 for 1024. Shorter texts
    hold too few n-grams to tell and follow their prediction alone. If no label is there to learn from, nothing can be
    rejected and all rows stay.
    """
    common.tune(docs.sparkSession)
    names, profiles = learn(docs.where(~held_out(ident)), label, text)
    if not names:
        return docs
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = predict(docs, names, profiles, {"row": row, "size": F.char_length(F.col(text))}, text)
    accepted = F.col("lang_pred").isin(names if languages is None else languages) & ((F.col("score") >= least_score) | (F.col("size") < sure_chars))
    return found.where(accepted).select([F.col("row").getField(c).alias(c) for c in docs.columns])
