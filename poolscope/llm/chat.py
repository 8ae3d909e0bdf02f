r"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>[ROLE]role[/ROLE]text</s>``. Control strings inside roles and texts are made
harmless by a backslash after their first character, and where backslashes already stand there,
one is added; taking one away gives the text back.

Turns are dealt out by conversation and sorted by turn. A batch of turns is assembled at once:
numpy computes the lengths of all segments, their cumulative offsets and the scatter indices, and
headers and contents are copied into one preallocated buffer. Loss spans are byte ranges of the
texts of assistants. Conversations that go on over several batches are continued, so memory is
bounded by a batch and one conversation, whose formatted text is one value by nature.

Defined cases: a null text or role is empty; a null turn comes first; equal turns follow each other
by role and text, and repeated rows are turns of their own; rows without a conversation id form one
conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ensure_columns

# The strings that control a model's reading of a chat.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, MIDDLE, CLOSE = b"<s>[ROLE]", b"[/ROLE]", b"</s>"
LEARNED = "assistant"
SCHEMA = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"

_TAILS = b"|".join(re.escape(c[1:].encode()) for c in CONTROLS)
_PLAIN = re.compile(rb"([<\[])(\\*)(?=" + _TAILS + rb")")
_SAFE = re.compile(rb"([<\[])\\(\\*)(?=" + _TAILS + rb")")
_TURN = re.compile(re.escape(OPEN) + rb"(.*?)" + re.escape(MIDDLE) + rb"(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: bytes) -> bytes:
    return _PLAIN.sub(rb"\1\\\2", text) if b"<" in text or b"[" in text else text


def unescape(text: bytes) -> bytes:
    return _SAFE.sub(rb"\1\2", text) if b"\\" in text else text


def assemble(segments: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all rows' segments in order, and the offsets of the segments in it.

    ``segments`` has a column per segment of a row. The bytes of a column lie next to each other;
    each is scattered to where its row and column start.
    """
    rows, width = len(segments[0]), len(segments)
    lengths = np.empty((rows, width), dtype=np.int64)
    for k, column in enumerate(segments):
        lengths[:, k] = np.fromiter((len(s) for s in column), dtype=np.int64, count=rows)
    offsets = np.concatenate(([0], np.cumsum(lengths.ravel())))
    buffer = np.empty(int(offsets[-1]), dtype=np.uint8)
    starts = offsets[:-1].reshape(rows, width)
    for k, column in enumerate(segments):
        source = np.frombuffer(b"".join(column), dtype=np.uint8)
        size = lengths[:, k]
        shift = starts[:, k] - (np.cumsum(size) - size)
        buffer[np.repeat(shift, size) + np.arange(len(source))] = source
    return buffer, offsets


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id, n_turns, formatted`` and its ``loss`` spans in bytes."""
    ensure_columns(turns, "conv_id", "turn", "role", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list = []  # id, turns, parts, bytes so far, spans

        def finished() -> tuple:
            conv, n, parts, _, spans = current
            return conv, n, b"".join(parts).decode(), [{"start": a, "end": b} for a, b in spans]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            columns = list(zip(*done, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(span))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
                ["conv_id", "n_turns", "formatted", "loss"],
            )

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            ids = batch.column(0).to_pylist()
            roles = [(r or "").encode() for r in batch.column(1).to_pylist()]
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            columns = [[OPEN] * rows, [escape(r) for r in roles], [MIDDLE] * rows, [escape(t) for t in texts], [CLOSE] * rows]
            buffer, offsets = assemble(columns)
            whole = buffer.tobytes()
            edges = [0, *[i for i in range(1, rows) if ids[i] != ids[i - 1]], rows]
            done = []
            for a, b in zip(edges, edges[1:], strict=False):
                if current and current[0] != ids[a]:
                    done.append(finished())
                    current = []
                if not current:
                    current = [ids[a], 0, [], 0, []]
                begin, end = int(offsets[5 * a]), int(offsets[5 * b])
                for i in range(a, b):
                    if roles[i] == LEARNED.encode():
                        shift = current[3] - begin
                        current[4].append((int(offsets[5 * i + 3]) + shift, int(offsets[5 * i + 4]) + shift))
                current[1] += b - a
                current[2].append(whole[begin:end])
                current[3] += end - begin
            yield batch_of(done)
        if current:
            yield batch_of([finished()])

    dealt = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", F.col("turn").alias("turn"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return dealt.select("conv_id", "role", "text").mapInArrow(build, SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    return [
        (unescape(m[1]).decode(), unescape(m[2]).decode()) for m in _TURN.finditer(formatted.encode())
    ]


def learned_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped."""
    whole = formatted.encode()
    return b"".join(unescape(whole[a:b]) for a, b in spans).decode()


def chat_report(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_turns(formatted)
                digest = hashlib.sha256()
                for role, text in turns:
                    digest.update(f"{role}\n{text}\n".encode())
                learned = learned_text(formatted, [(s["start"], s["end"]) for s in spans])
                out.append((
                    conv, len(turns), digest.hexdigest(), len(learned),
                    hashlib.sha256(learned.encode()).hexdigest(), len(formatted),
                ))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "loss").mapInArrow(read, schema)
