"""Chat formatting by columnar byte assembly.

A batch of turns is five segments a turn: mark, role, mark, text, mark. Their lengths are computed as
arrays, cumulative sums give each segment's place, and scatter indices copy marks and contents into
one preallocated buffer that becomes the Arrow string column as it is.

    <|turn|>ROLE<|says|>TEXT<|end|>\\n

In roles and texts a backslash becomes ``\\\\`` and ``<`` becomes ``\\(``, so no mark can occur inside them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, SAYS, END = b"<|turn|>", b"<|says|>", b"<|end|>\n"
_LEFT, _BACK = ord("<"), ord("\\")
#: Bytes of content assembled at once, but for a longer conversation.
CHUNK = 8_000_000


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contents and offsets of a string column without nulls."""
    a = column.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, back = data == _LEFT, data == _BACK
    more = np.concatenate([[0], np.cumsum(left | back)])
    out = np.empty(len(data) + int(more[-1]), np.uint8)
    at = np.arange(len(data)) + more[1:]
    out[at] = np.where(left, ord("("), data)
    out[at[left | back] - 1] = _BACK
    return out, offsets + more[offsets]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Conversations as one string column, and of each turn's text the start and end in it (code points).

    first: for each conversation the number of its first turn, then the number of turns.
    """
    n = len(roles)
    parts = [_escape(*_bytes_of(roles)), _escape(*_bytes_of(texts))]
    marks = [np.frombuffer(m, np.uint8) for m in (TURN, SAYS, END)]
    lengths = np.empty((n, 5), np.int64)
    for k, m in zip((0, 2, 4), marks, strict=True):
        lengths[:, k] = len(m)
    for k, (_, offsets) in zip((1, 3), parts, strict=True):
        lengths[:, k] = np.diff(offsets)
    places = np.concatenate([[0], np.cumsum(lengths.ravel())])
    starts = places[:-1].reshape(n, 5)
    buffer = np.empty(int(places[-1]), np.uint8)
    for k, m in zip((0, 2, 4), marks, strict=True):
        buffer[starts[:, k, None] + np.arange(len(m))] = m
    for k, (data, offsets) in zip((1, 3), parts, strict=True):
        buffer[np.repeat(starts[:, k] - offsets[:-1], lengths[:, k]) + np.arange(len(data))] = data
    ends = np.concatenate([starts[:, 0], [len(buffer)]])[first]
    formatted = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buffer)])
    points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
    base = np.repeat(points[ends[:-1]], np.diff(first))
    return formatted, points[starts[:, 3]] - base, points[starts[:, 4]] - base


def format_conversations(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant", partitions: int | None = None) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, formatted, and loss_spans, the places of the ``learned`` role's texts.

    Rows go by turn, then role and text where turns tie; a null turn comes first, null roles and texts are empty, repeated
    rows stay, a null conv_id is a conversation of its own, other columns are ignored. A conversation is one string,
    so one must stay under 2 GB.
    """
    rows = conversations.select(F.col(conv_id).alias("c"), F.col(turn).alias("k"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = rows.repartition(partitions, "c") if partitions else rows.repartition("c")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def done(some: pa.RecordBatch) -> pa.RecordBatch:
        ids = some.column("c").to_pylist()
        first = np.array([i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]] + [len(ids)])
        formatted, start, end = assemble(some.column("r"), some.column("t"), first)
        own = np.array([r == learned for r in some.column("r").to_pylist()])
        spans = [[{"start": int(start[i]), "end": int(end[i])} for i in range(a, b) if own[i]] for a, b in zip(first, first[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in first[:-1]], some.schema.field("c").type), pa.array(np.diff(first)), formatted, pa.array(spans, span)], ["conv_id", "n_turns", "formatted", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            some = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if not len(some):
                return
            ids = some.column("c").to_pylist()
            upto = len(ids)
            while not final and upto and ids[upto - 1] == ids[-1]:
                upto -= 1
            if upto:
                yield done(some.slice(0, upto).combine_chunks().to_batches()[0])
            if upto < len(ids):
                held.append(some.slice(upto).combine_chunks().to_batches()[0])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK and batch.num_rows:
                yield from cut(False)
                size = 0
        if held:
            yield from cut(True)

    kind = rows.schema["c"].dataType.simpleString()
    return dealt.sortWithinPartitions("c", "k", "r", "t").mapInArrow(run, f"conv_id {kind}, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


_ESCAPED = re.compile(r"\\([\\(])")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" if m[1] == "(" else "\\", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation: the exact inverse."""
    out = []
    for turn in formatted.split(END.decode())[:-1]:
        role, _, text = turn.removeprefix(TURN.decode()).partition(SAYS.decode())
        out.append((unescape(role), unescape(text)))
    return out


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of formatted conversations, from the output alone."""
    for b in batches:
        rows = []
        for c, text, spans in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    formatted = format_conversations(given.unionByName(more))
    return formatted.mapInArrow(read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


OP4_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(text)
                + length(regexp_replace(role || text, '[^<\\]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
