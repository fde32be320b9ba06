"""Byte-level BPE encoding and decoding by a rank file, in numpy matrices.

A text is split by the tokenizer's pattern. The matches that a worker does not remember are encoded
together: those of similar length are the rows of one padded matrix of token numbers, beside a matrix of the
ranks of neighbouring pairs. In each round every row merges its leftmost pair of least rank, closes the gap,
and looks up the two pairs that are new, in a hash table of all pairs; rows without a pair are taken out.

A match of more than ``LONG`` bytes would need a round for each of its merges. It is a row of its own, and
each round merges the occurrences of its least pair from the left, up to the first whose new neighbours make
a pair of lower rank: until then one round gives what as many single merges would.

The pattern runs in the `regex` module, whose letters, numbers and white space may be those of another
Unicode version than `tiktoken`'s. :func:`class_differences` asks both libraries about every code point; a
text with a code point on which they differ is split with one in its place on which they agree.

Decoding joins the bytes of the tokens. Nothing is shuffled; a worker holds the matches of one stretch of a
text, and remembers at most ``2 * WORDS`` short ones.

Defined results: NULL text and NULL ids count as empty (no tokens, no bytes); special strings are ordinary text; repeated
rows are returned as often as they come; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import common

LONG = 96  # bytes of a match that is a row of its own
WORDS, REMEMBERED = 200_000, 64  # matches that a worker remembers, and characters of the longest of them
STRETCH = 200_000  # matches that are encoded at a time
CELLS = 1 << 20  # of one matrix
_NONE = np.int32(2**31 - 1)  # rank of a pair that is no token


class PairTable:
    """Rank of the token that a pair of tokens makes, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(4 * max(len(left), 1)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):  # those that find a free slot are in, those that lose it to another move on
            free = self.keys[slot[waiting]] < 0
            self.keys[slot[waiting[free]]] = keys[waiting[free]]
            placed = self.keys[slot[waiting]] == keys[waiting]
            self.ranks[slot[waiting[placed]]] = rank[waiting[placed]]
            waiting = waiting[~placed]
            slot[waiting] = (slot[waiting] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; negative numbers stand for no token."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], _NONE)
        at = np.flatnonzero((there != keys) & (there >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[at]]
            hit = there == keys[at]
            out[at[hit]] = self.ranks[slot[at[hit]]]
            at = at[~hit & (there >= 0)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class Vocabulary:
    """Tokens and pairs of a rank file. A token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        get, pairs = self.ranks.get, []
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left, right = get(token[:at]), get(token[at:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
        left, right, rank = np.array(pairs or np.zeros((0, 3)), dtype=np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)

    # ---------------------------------------------------------------- encoding

    def _rows(self, matches: list[bytes]) -> list[bytes]:
        """Packed ids of matches of similar length, one round after the other for all of them."""
        width, out = max(map(len, matches)), [b""] * len(matches)
        lengths = np.array([len(m) for m in matches])
        ids = np.full((len(matches), width + 1), -1, dtype=np.int32)
        inside = np.arange(width + 1) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(matches), dtype=np.uint8)]
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(matches), width)
        row = np.arange(len(matches))
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            if (done := least == _NONE).any():
                for i in np.flatnonzero(done):
                    out[row[i]] = ids[i, : lengths[row[i]]].astype("<u4").tobytes()
                row, ids, ranks, at, least = row[~done], ids[~done], ranks[~done], at[~done], least[~done]
                if not len(row):
                    return out
                width = int(lengths[row].max())
                ids, ranks = ids[:, : width + 1], ranks[:, :width]
            each = np.arange(len(row))
            after = np.arange(width) > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ids[each, at] = least
            ids[each, -1], ranks[each, -1] = -1, _NONE
            lengths[row] -= 1
            left = np.maximum(at - 1, 0)
            before = self.pairs(ids[each, left], least)
            ranks[each, left] = np.where(at > 0, before, ranks[each, left])
            ranks[each, at] = self.pairs(least, ids[each, at + 1])

    def _long(self, match: bytes) -> bytes:
        """Packed ids of one long match; tokens are linked to their neighbours until half of them are gone."""
        ids = self.byte_ids[np.frombuffer(match, dtype=np.uint8)]
        while True:
            n = len(ids)
            ids = np.append(ids, np.int32(-1))  # stands before the first and after the last
            after, before = np.append(np.arange(1, n + 1), 0), np.append(n, np.arange(n))
            ranks = np.append(self.pairs(ids[:-1], ids[1:]), _NONE)
            live = n
            while live > n // 2:
                least = ranks.min()
                if least == _NONE:
                    break
                at = np.flatnonzero(ranks == least)
                if len(at) > 1:  # equal tokens side by side: every other pair, from the left
                    joined = np.append(False, after[at[:-1]] == at[1:])
                    run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
                gone = after[at]
                merged = np.full(len(at), least)
                joined = np.append(False, after[gone[:-1]] == at[1:])
                lower = self.pairs(np.where(joined, least, ids[before[at]]), merged) < least
                lower |= self.pairs(merged, ids[after[gone]]) < least
                if lower.any():
                    at = at[: int(lower.argmax()) + 1]
                    gone = gone[: len(at)]
                ids[at], ids[gone], ranks[gone] = least, -1, _NONE
                after[at] = after[gone]
                before[after[at]] = at
                ranks[at] = self.pairs(ids[at], ids[after[at]])
                left = before[at]
                ranks[left] = self.pairs(ids[left], ids[at])
                live -= len(at)
            done = least == _NONE
            ids = ids[:-1][ids[:-1] >= 0]
            if done:
                return ids.astype("<u4").tobytes()

    def encode(self, matches: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each match. A match that is a token is that token."""
        out = list(map(self.packed.get, matches))
        rest = sorted((i for i, ids in enumerate(out) if ids is None), key=lambda i: len(matches[i]))
        start = 0
        while start < len(rest):
            size = len(matches[rest[start]])
            if size > LONG:
                out[rest[start]] = self._long(matches[rest[start]])
                start += 1
                continue
            end, wide = start, min(LONG, size + size // 4 + 1)
            while end < len(rest) and len(matches[rest[end]]) <= wide and (end - start) * (wide + 1) < CELLS:
                end += 1
            for i, ids in zip(rest[start:end], self._rows([matches[i] for i in rest[start:end]]), strict=True):
                out[i] = ids
            start = end
        return out

    # ---------------------------------------------------------------- decoding

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


# A character class, and a character of it that both libraries know; the last is of no class.
_CLASSES = [(r"\p{L}", "\u6587"), (r"\p{N}", "\u0e51"), (r"\s", "\u2003"), (None, "\ue000")]
_DIFFERENCES: list[tuple[int, int, str]] | None = None


def class_differences() -> list[tuple[int, int, str]]:
    """Ranges (first, last, stand-in) of code points that `regex` and `tiktoken` put into different classes."""
    global _DIFFERENCES
    if _DIFFERENCES is None:
        import regex
        import tiktoken

        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([b]): b for b in range(256)}
        stand_in, unlike = {}, set()
        for kind, letter in _CLASSES[:-1]:
            # An encoder keeps only what its pattern matches.
            there = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
            stand_in.update(dict.fromkeys(there, letter))
            unlike |= there ^ set(regex.findall(kind, every))
        ranges: list[tuple[int, int, str]] = []
        for c in sorted(map(ord, unlike)):
            letter = stand_in.get(chr(c), _CLASSES[-1][1])
            if ranges and ranges[-1][1] == c - 1 and ranges[-1][2] == letter:
                ranges[-1] = (ranges[-1][0], c, letter)
            else:
                ranges.append((c, c, letter))
        _DIFFERENCES = ranges
    return _DIFFERENCES


class Splitter:
    """Packed ids of texts; remembers the ids of short matches."""

    def __init__(self, path: str, pattern: str, unlike: list[tuple[int, int, str]]):
        import regex

        self.vocabulary, self.pattern = vocabulary(path), regex.compile(pattern)
        self.unlike = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in unlike) + "]") if unlike else None
        self.stand_in = {c: letter for a, b, letter in unlike for c in range(a, b + 1)}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, matches: list[str]) -> dict[str, bytes]:
        """Ids of matches that are not among the recent ones."""
        found = {m: self.older.get(m) for m in matches}
        new = [m for m, ids in found.items() if ids is None]
        found.update(zip(new, self.vocabulary.encode([m.encode() for m in new]), strict=True))
        if len(self.recent) + len(found) > WORDS:
            self.recent, self.older = {}, self.recent
        self.recent.update((m, ids) for m, ids in found.items() if len(m) <= REMEMBERED)
        return found

    def stretches(self, text: str) -> Iterator[list[str]]:
        shown = text
        if self.unlike and not text.isascii() and self.unlike.search(text):
            shown = text.translate(self.stand_in)
        if shown is text and len(text) < STRETCH:
            yield self.pattern.findall(text)
        else:
            matches = (text[slice(*m.span())] for m in self.pattern.finditer(shown))
            while part := list(islice(matches, STRETCH)):
                yield part

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; new matches of many short texts are encoded together."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            for part in self.stretches(text):
                waiting.append((i, part))
                held += len(part)
                if held >= STRETCH:
                    self._flush(waiting, out)
                    waiting, held = [], 0
        self._flush(waiting, out)
        return [b"".join(parts) for parts in out]

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        recent = self.recent
        new = {m for _, part in waiting for m in part if m not in recent}
        learnt = self._learn(sorted(new)) if new else {}
        known = {**recent, **learnt} if learnt and self.recent is not recent else recent
        long = {m: ids for m, ids in learnt.items() if len(m) > REMEMBERED}
        for i, part in waiting:
            ids = list(map(known.get, part))
            if long and None in ids:
                ids = [long[m] if x is None else x for m, x in zip(part, ids, strict=True)]
            out[i].append(b"".join(ids))


_VOCABULARIES: dict[str, Vocabulary] = {}
_SPLITTERS: dict[tuple, Splitter] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each rank file and worker process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def splitter(path: str, pattern: str, unlike: list[tuple[int, int, str]]) -> Splitter:
    """One for each rank file, pattern and worker process."""
    if (path, pattern) not in _SPLITTERS:
        _SPLITTERS[path, pattern] = Splitter(path, pattern, unlike)
    return _SPLITTERS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """One row per document: identifier, ids (little-endian 32-bit numbers as binary), n_tokens."""
    common.tune(docs.sparkSession)
    kind, unlike = docs.schema[ident].dataType.simpleString(), class_differences()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = splitter(ranks, pattern, unlike).packed(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(ident), pa.array(ids, pa.binary())], [ident, "ids"])

    rows = docs.select(F.col(ident), F.coalesce(F.col(text), F.lit("")).alias("content"))
    found = rows.mapInArrow(encoded, f"`{ident}` {kind}, ids binary")
    return found.select(ident, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def decode(rows: DataFrame, ranks: str, ids: str = "ids", ident: str = common.ID) -> DataFrame:
    """One row per row of ids: identifier, ids, decoded (bytes). An id that is no token is an error."""
    common.tune(rows.sparkSession)
    kind = rows.schema[ident].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoder = vocabulary(ranks)
            texts = [decoder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(ident), batch.column("ids"), pa.array(texts, pa.binary())], [ident, "ids", "decoded"])

    given = rows.select(F.col(ident), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return given.mapInArrow(decoded, f"`{ident}` {kind}, ids binary, decoded binary")
