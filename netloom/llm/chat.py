"""Conversations as training windows within a token budget.

A conversation is cut into stretches of ``STRETCH`` turn numbers, and a stretch that has more rows or longer texts
than ``PIECE_ROWS`` and ``PIECE_CHARS`` (repeated or missing turn numbers) into pieces as its sorted rows pass by.
A worker holds one piece, whatever the length of the conversation, and windows never cross its border. Within it, prefix sums of turn tokens choose
turn-aligned windows: each holds the conversation's system turn (if its first turn is one), a limited number
of turns before the window, and as many new turns as fit. Repeated turns are masked: an assistant turn is
under the loss mask once, in the window where it is new.

A turn's tokens are those of the turn as it is written, escapes and template included; turns end with a line end and begin
with "<", between which no token can span, so a window has as many tokens as its turns.

A turn reads ``<s>[INST] role [/INST]``, line end, text, line end, ``</s>``, line end. The template's control
strings never stand after a backslash; those inside texts and roles get one (and double the backslashes before
it), which :func:`unescape` takes back.

Defined results: NULL text and NULL role count as empty, a NULL turn number as -1; rows that share a turn number
are ordered by role, then text; NULL conv_id is a conversation of its own; a turn that does not fit the budget
stands alone with the system turn; an empty table gives no windows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import bytebpe, common

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")  # fixed values
_OPEN, _ROLE_END, _CLOSE = "<s>[INST] ", " [/INST]\n", "\n</s>\n"
_ANY = "|".join(map(re.escape, CONTROLS))
_PLAIN, _ESCAPED = re.compile(rf"(\\*)({_ANY})"), re.compile(rf"(\\+)({_ANY})")
STRETCH = 256  # turn numbers in a stretch
PIECE_ROWS, PIECE_CHARS = 1024, 8 << 20
_WINDOWS = "conv_id long, stretch long, window int, formatted string, repeated int, loss array<struct<start:int,end:int>>, n_tokens long"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def render(turns: list[tuple[str, str]], new_from: int, target: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Formatted turns (role, text), and the spans of the target role's texts from turn ``new_from`` on."""
    out, at, spans = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = _OPEN + escape(role) + _ROLE_END, escape(text)
        if i >= new_from and role == target:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + _CLOSE)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        role_end = formatted.index(_ROLE_END, at)
        text_end = formatted.index(_CLOSE, role_end)
        turns.append((unescape(formatted[at + len(_OPEN) : role_end]), unescape(formatted[role_end + len(_ROLE_END) : text_end])))
        at = text_end + len(_CLOSE)
    return turns


def _spans(tokens: np.ndarray, new_from: int, fixed: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(first repeated turn, first new turn, end) of each window; turns before ``new_from`` are only repeated."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    start = new_from
    while start < len(tokens):
        room = max(1, budget - fixed)
        back = max(start - history, int(np.searchsorted(sums, sums[start] - room // 4)), 0)  # history takes a quarter at most
        end = int(np.searchsorted(sums, sums[back] + room, side="right")) - 1
        if end <= start:  # too long with its history
            back = start
            end = max(int(np.searchsorted(sums, sums[start] + room, side="right")) - 1, start + 1)
        yield back, start, end
        start = end


def windows(conversations: DataFrame, tokenizer: str, ranks: str | None = None, budget: int = 1024, history: int = 2) -> DataFrame:
    """conv_id, stretch, window, formatted, repeated (leading turns seen before), loss (spans in code points), n_tokens."""
    if ranks and not bytebpe.same_vocabulary(tokenizer, ranks):
        raise ValueError(f"{ranks} has another vocabulary than {tokenizer}")
    common.tune(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    # kind: -1 says that the stretch begins with the system turn, 0 is the system turn of an earlier stretch,
    # 1 a turn of the stretch before, 2 an own turn
    own = rows.select("conv_id", "stretch", F.lit(2).alias("kind"), "turn", "role", "content")
    before = rows.where(F.pmod("turn", F.lit(STRETCH)) >= STRETCH - history).select(
        "conv_id", (F.col("stretch") + 1).alias("stretch"), F.lit(1).alias("kind"), "turn", "role", "content")
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "content")).alias("first")).where("first.role = 'system'").select("conv_id", "first.*")
    stretches = rows.select("conv_id", "stretch").distinct()
    system = (stretches.withColumnRenamed("conv_id", "conv").join(first, F.expr("conv <=> conv_id"))
              .select("conv_id", "stretch", F.when(F.col("stretch") > F.floor(F.col("turn") / STRETCH), 0).otherwise(-1).alias("kind"), "turn", "role", "content"))
    dealt = own.union(before).union(system).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "kind", "turn", "role", "content")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bytebpe.encoder(tokenizer, ranks)
        done: list[tuple] = []

        def close(key, group, number):
            begins, system = group[0][0] == -1, [g[1:] for g in group if g[0] == 0]
            turns, new_from = [g[1:] for g in group if g[0] > 0], sum(g[0] == 1 for g in group)
            tokens = np.array([encoder.count(render([turn], 1)[0]) for turn in system + turns])
            fixed = int(tokens[0]) if begins or system else 0
            tokens = tokens[len(system) :]
            chars = 0
            for back, start, end in _spans(tokens, new_from, fixed, budget, history):
                lead = system or (turns[:1] if begins and back > 0 else [])
                repeated = len(lead) + start - back
                text, loss = render(lead + turns[back:end], repeated)
                done.append((*key, number, text, repeated, loss, int(tokens[back:end].sum()) + (fixed if lead else 0)))
                number += 1
                chars += len(text)
                if chars >= PIECE_CHARS:
                    yield _window_batch(done)
                    done.clear()
                    chars = 0
            return number

        key, group, own, chars, number = None, [], 0, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "stretch", "kind", "role", "content")]
            for conv, stretch, kind, role, content in zip(*columns, strict=True):
                if (conv, stretch) != key:
                    if group:
                        yield from close(key, group, number)
                    group, own, chars, number = [], 0, 0, 0
                elif own and (own >= PIECE_ROWS or chars + len(content) > PIECE_CHARS):
                    number = yield from close(key, group, number)
                    turns = [g[1:] for g in group if g[0] > 0]
                    group = [(0, *g[1:]) for g in group[:1] if g[0] < 1] + [(1, *t) for t in turns[max(0, len(turns) - history) :]]
                    own, chars = 0, 0
                key = (conv, stretch)
                group.append((kind, role, content))
                if kind == 1 and sum(g[0] == 1 for g in group) > history:  # only the last ones are ever repeated
                    del group[-history - 1]
                own += kind == 2
                chars += len(content) * (kind == 2)
            if done:
                yield _window_batch(done)
                done.clear()
        if group:
            yield from close(key, group, number)
        if done:
            yield _window_batch(done)

    return dealt.mapInArrow(formatted, _WINDOWS)


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), span, pa.int64()]
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[5] = [[{"start": a, "end": b} for a, b in loss] for loss in columns[5]]
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", _WINDOWS)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_back(found: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Both digests run over a whole conversation in order: its sorted windows stream through one task, which holds one
    batch of them and the two digests.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, loss = batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()
            turns = [parse(t)[r:] for t, r in zip(texts, batch.column("repeated").to_pylist(), strict=True)]
            columns = {c: batch.column(c) for c in ("conv_id", "stretch", "window")}
            columns["n_turns"] = pa.array([len(t) for t in turns], pa.int64())
            columns["turns"] = pa.array(["".join(f"{role}\n{text}\n" for role, text in t) for t in turns], pa.string())
            columns["loss"] = pa.array(["".join(unescape(t[s["start"] : s["end"]]) for s in own) for t, own in zip(texts, loss, strict=True)], pa.string())
            columns["chars"] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    parts = found.mapInArrow(read, "conv_id long, stretch long, window int, n_turns long, turns string, loss string, chars long")
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss", "chars")), strict=True):
                conv, n, turns, loss, chars = row
                if now is None or now[0] != conv:
                    if now:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += n
                now[2].update(turns.encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += chars
            if done:
                yield _digest_batch(done)
                done.clear()
        if now:
            yield _digest_batch([now])

    return dealt.mapInArrow(digest, _DIGESTS)


def _digest_batch(rows: list[list]) -> pa.RecordBatch:
    columns = [[x.hexdigest() if k in (2, 4) else x for x in c] for k, c in enumerate(zip(*rows, strict=True))]
    kinds = [pa.string() if k in (2, 4) else pa.int64() for k in range(6)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _DIGESTS.split(", ")])
