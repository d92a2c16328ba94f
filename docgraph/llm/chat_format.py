"""Chat formatting by columnar byte assembly.

Each conversation becomes one text: per turn a header line ``### Role:``, the escaped content and an end
mark. Segment lengths, cumulative offsets and scatter indices are computed with numpy for a whole batch, and
headers, contents and marks are copied into one preallocated Arrow buffer. A second column gives the byte
spans of the assistant contents (the loss mask).

The template ``{"### Role: " name "\\n" content "\\n</turn>\\n"}`` is made reversible by doubling: a content
line that starts with any number of backslashes before ``###`` or ``</turn>`` gets one more backslash, so no
content line can be taken for a mark, and removing one restores the text. Names of roles are escaped alike
for line feeds.

Defined results: a null text is empty and a null role is the empty name; turns with equal numbers are ordered
by role and text, null numbers first; a null conversation id is a conversation; an empty table gives no rows;
other columns are not read. A conversation is assembled whole in one task, as its output is one value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MARK, END = b"### Role: ", b"\n", b"\n</turn>\n"
_ESCAPE = re.compile(rb"^(\\*(?:###|</turn>))", re.M)
_UNESCAPE = re.compile(rb"^\\(\\*(?:###|</turn>))", re.M)
_ROLE = re.compile(rb"[\\\n]")


def escape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"\\\1", text) if b"###" in text or b"</turn>" in text else text


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", text) if b"###" in text or b"</turn>" in text else text


def escape_role(role: bytes) -> bytes:
    return _ROLE.sub(lambda m: b"\\n" if m[0] == b"\n" else b"\\\\", role)


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], role)


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch in one buffer: the bytes, each turn's end, and each content's [start, end)."""
    roles, texts = [escape_role(r) for r in roles], [escape(t) for t in texts]
    n = len(roles)
    size = np.empty((n, 5), np.int64)  # head, role, mark, content, end
    size[:, 0], size[:, 2], size[:, 4] = len(HEAD), len(MARK), len(END)
    size[:, 1], size[:, 3] = [len(r) for r in roles], [len(t) for t in texts]
    ends = np.cumsum(size.ravel()).reshape(n, 5)
    starts = ends - size
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, piece in ((0, HEAD), (2, MARK), (4, END)):
        out[starts[:, k, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    for k, pieces in ((1, roles), (3, texts)):
        flat, length = np.frombuffer(b"".join(pieces), np.uint8), size[:, k]
        shift = starts[:, k] - (np.cumsum(length) - length)
        out[np.arange(len(flat)) + np.repeat(shift, length)] = flat
    return out, ends[:, 4], np.stack([starts[:, 3], ends[:, 3]], 1)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index(MARK, at)
        end = formatted.index(END, line)
        turns.append((unescape_role(formatted[at + len(HEAD) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END)
    return turns


FORMATTED = "conv_id long, formatted string, loss_spans array<int>"


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are start, end, start, end, ... in bytes of the UTF-8 text."""
    turns = rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t")
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: t["role"]).alias("roles"), F.transform("t", lambda t: t["text"]).alias("texts"))
    loss = loss_role.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows // max(1, batch.nbytes >> 23))
            for b in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                roles = b.column(1).flatten().cast(pa.binary()).to_pylist()
                texts = b.column(2).flatten().cast(pa.binary()).to_pylist()
                counts = np.array([len(x) for x in b.column(1)], np.int64)
                data, turn_end, span = assemble(roles, texts)
                last = np.cumsum(counts)
                conv_end = turn_end[last - 1] if len(turn_end) else np.empty(0, np.int64)
                conv_start = np.concatenate([[0], conv_end[:-1]]).astype(np.int64)
                keep = np.array([r == loss for r in roles], bool)
                of = np.repeat(np.arange(len(counts)), counts)
                spans = (span - conv_start[of, None])[keep].astype(np.int32)
                per = np.bincount(of[keep], minlength=len(counts)) * 2
                offsets = pa.py_buffer(np.concatenate([[0], conv_end]).astype(np.int32))
                formatted = pa.StringArray.from_buffers(len(counts), offsets, pa.py_buffer(data))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(spans.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), formatted, lists], ["conv_id", "formatted", "loss_spans"])

    return convs.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the loss text, parsed from the formatted conversations alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = b"".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True))
                whole = hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest()
                row = (conv_id, len(turns), whole, len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(text.decode()))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [f.split()[0] for f in DIGESTS.split(", ")])

    return formatted.mapInArrow(run, DIGESTS)
