"""Chat formatting by columnar byte assembly.

A batch of turns becomes one byte buffer: the lengths of all segments (marks, roles, texts) give cumulative offsets, the
offsets give scatter indices, and marks and contents are copied into one preallocated Arrow buffer by numpy.

    ### Assistant: text</turn>

Within roles and texts a backslash is written \\\\, `##` is `#\\#`, `</turn>` is `\\</turn>`, and in roles also `: ` is
`\\: `; reading back, a backslash stands for the character behind it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import partitions, ready, table
from loomstone.llm.textkernel import chars, text_bytes

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
#: The role whose texts bear the loss, and how the known roles are shown.
LOSS_ROLE = "assistant"
SHOWN = {"user": "User", "assistant": "Assistant", "system": "System"}
#: Bytes of formatted text in one piece of a conversation, about: longer conversations come in several.
PIECE_BYTES = 4 << 20

_TURN = re.compile(r"### ((?:[^\\:]++|\\.|:(?! ))*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    column = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "##", "#\\#")
    column = pc.replace_substring(column, "</turn>", "\\</turn>")
    return pc.replace_substring(column, ": ", "\\: ") if role else column


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, as they were before formatting."""
    known = {v: k for k, v in SHOWN.items()}
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        role = unescape(m[1])
        yield known.get(role, role[1:] if role.startswith("@") else role), unescape(m[2])
        at = m.end()


def assemble(segments: list[pa.Array | str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of segments, each a column or one string for all, end to end: the bytes, and the (n, segments + 1) byte offsets."""
    parts = [(s.encode(), None) if isinstance(s, str) else text_bytes(s) for s in segments]
    length = np.stack([np.full(n, len(d)) if at is None else np.diff(at) for d, at in parts], axis=1) if n else np.zeros((0, len(parts)), np.int64)
    ends = np.cumsum(length.ravel()).reshape(length.shape)
    start = ends - length
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (data, at) in enumerate(parts):
        if not len(data):
            continue
        if at is None:
            out[start[:, k, None] + np.arange(len(data))] = np.frombuffer(data, np.uint8)
        else:
            out[np.repeat(start[:, k] - at[:-1], length[:, k]) + np.arange(len(data))] = data
    return out, np.concatenate([start, ends[:, -1:]], axis=1) if n else np.zeros((0, len(parts) + 1), np.int64)


def _shown(role: pa.Array) -> pa.Array:
    """Known roles by their shown name; one that looks like a shown name, or like a mark for that, is marked with @."""
    names = pa.array(list(SHOWN))
    known = pc.index_in(role, names)
    shown = pc.take(pa.array(list(SHOWN.values())), known)
    clash = pc.or_(pc.is_in(role, pa.array(list(SHOWN.values()))), pc.starts_with(role, "@"))
    return pc.if_else(pc.is_valid(known), shown, pc.if_else(clash, pc.binary_join_element_wise("@", role, ""), role))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss_spans): the conversations in pieces of whole turns, in turn order.

    turns: conv_id, turn, role, text (other columns are not read). Null texts and roles are empty; a null turn comes
    first, a null conv_id is a conversation. Ties in turn go by role and text. loss_spans: start and end, in characters
    of the piece, of the texts under the loss mask. Pieces of a conversation sort by `piece`. Turns are range-partitioned
    by (conv_id, turn), so one endless conversation is spread over tasks. An empty table gives an empty table.
    """
    spark = ready(turns.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.select(*order).repartitionByRange(partitions(spark), "conv_id", "turn", "role").sortWithinPartitions(*order)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId() << 40
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            conv = b.column(0)
            role, text = (pc.fill_null(b.column(i), "") for i in (2, 3))
            data, at = assemble([OPEN, escape(_shown(role), True), BETWEEN, escape(text), CLOSE], n)
            new = np.ones(n, bool)
            key, null = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            big = (at[:, 0] - at[first, 0][group]) // PIECE_BYTES  # a long conversation is cut between turns
            new[1:] |= big[1:] != big[:-1]
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            offsets = np.append(at[first, 0], at[-1, -1])
            formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            code = np.concatenate([[0], np.cumsum(chars(data))])
            mask = np.flatnonzero(pc.equal(role, LOSS_ROLE).to_numpy(zero_copy_only=False))
            base = code[at[first, 0]][group[mask]]
            count = np.bincount(group[mask], minlength=len(first))
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(code[at[mask, 3]] - base), pa.array(code[at[mask, 4]] - base)], names=["start", "end"]))
            turns_in = np.diff(np.append(first, n))
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(piece + np.arange(len(first))), pa.array(turns_in), formatted, spans], names=["conv_id", "piece", "n_turns", "formatted", "loss_spans"])
            piece += len(first)

    return ranged.mapInArrow(kernel, "conv_id long, piece long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Read formatted pieces back: per conversation n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Hashes run on over pieces, one piece in memory at a time."""
    spark = formatted.sparkSession
    ordered = formatted.select("conv_id", "piece", "formatted", "loss_spans").repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "piece")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv, state) -> tuple:
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        now, conv, done = None, None, []
        for b in batches:
            for c, text, spans in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if now is None or c != conv:
                    if now is not None:
                        done.append(out(conv, now))
                    now, conv = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], c
                text = text.as_py()
                for role, said in read_turns(text):
                    now[0] += 1
                    now[1].update(f"{role}\n{said}\n".encode())
                for s in spans.as_py():
                    said = unescape(text[s["start"] : s["end"]])
                    now[2] += len(said)
                    now[3].update(said.encode())
                now[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
                done = []
        if now is not None:
            done.append(out(conv, now))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return ordered.mapInArrow(kernel, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_chats(format_chats(turns))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '\</turn>') AS esc,
         CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 ELSE length(role) END AS role_chars
  FROM turns)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(SUM(4 + role_chars + 2 + length(esc) + 8) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
