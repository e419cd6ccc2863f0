"""Chat formatting through a template that is only ever called, never read.

A template is any function from the turns of a conversation, as (role, text)
pairs, to a string. It is called for the conversation's first turn, its first
two, and so on, and each output is compared with the one before. Where the
output only grows, what it grew by is the turn's span. Where it changes earlier
text, the template rewrites history: the row tells how many characters were
replaced, so that rows applied in order still give the final text exactly, and
a loss mask over rewritten text can be refused.

Inside an assistant's span the text itself is found by two probes: the same
turn with the texts "a" and "b". Where their outputs first differ the text
begins, and what follows it in the probe ends the span. Spans whose ends don't
agree with the probes (the template changes what surrounds a text with the text)
get no loss, as do turns of rewriting templates.

Rows come by conversation and turn, sorted within tasks and streamed: no more
than `window` turns of a conversation are in memory, however long it is. A
template that looks back on more turns than that needs a larger window.
Conversations of up to `window` turns are rendered from their first turn; in
longer ones rendering begins anew, half a window back, whenever it is full.

Null texts and roles are empty. Turns sort with nulls first and, where equal,
by role and text; repeated rows are turns of their own. Rows without
conversation id make one conversation. An empty table gives no rows; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

OPEN, CLOSE = "<s>", "</s>"
#: Marks of a role: before the text and behind it.
ROLE_MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", CLOSE)}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
CONTROL = (OPEN, CLOSE, "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]")
ESCAPE = "\\"
_TO_ESCAPE = re.compile("|".join(re.escape(c) for c in (ESCAPE, *CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\] (?P<role>.*?) \[TEXT\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?)</s>", re.DOTALL)


def escaped(text: str) -> str:
    """The escape mark is doubled, and stands behind the first character of what would be a control string."""
    return _TO_ESCAPE.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruct_template(turns: Turns) -> str:
    """Marks each turn by its role; no control string is left inside a text."""
    out = [OPEN]
    for role, text in turns:
        if role in ROLE_MARKS:
            before, behind = ROLE_MARKS[role]
            out += [before, escaped(text), behind]
        else:
            out += [OTHER[0], escaped(role), OTHER[1], escaped(text), OTHER[2]]
    return "".join(out)


def turns_of(formatted: str) -> Turns:
    """Reads back what `instruct_template` has written, or a part of it that begins and ends with turns."""
    found, at = [], len(OPEN) if formatted.startswith(OPEN) else 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        if m["role"] is not None:
            found.append((unescaped(m["role"]), unescaped(m["other"])))
        else:
            found.append((m.lastgroup, unescaped(m[m.lastgroup])))
        at = m.end()
    return found


def common_length(a: str, b: str) -> int:
    """Characters that two strings share from the start."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def text_span(template: Template, before: Turns, role: str, out: str) -> tuple[int, int] | None:
    """Where the last turn's text stands in `out`, as far as probes can tell."""
    one, other = (template([*before, (role, probe)]) for probe in "ab")
    at = common_length(one, other)
    behind = one[at + 1 :]
    fits = one[at : at + 1] == "a" and other[at : at + 1] == "b" and other[at + 1 :] == behind
    if not fits or len(out) < at + len(behind) or out[:at] != one[:at] or not out.endswith(behind):
        return None
    return at, len(out) - len(behind)


def located(turns: Iterator[tuple[str, str]], template: Template, window: int, learned: str = "assistant") -> Iterator[tuple]:
    """(no, role, start, piece, rewritten, loss_from, loss_to) of each turn of a conversation.

    Cut to `start` characters and followed by the piece, the text so far becomes
    the text with this turn. The loss goes from and to characters of the piece.
    """
    held: Turns = []
    last = ""
    base = 0  # where the output of the turns held begins in the whole text, less what it has in front
    for no, (role, text) in enumerate(turns):
        if len(held) >= window:
            kept = template(held[-(window // 2) or len(held) :])
            base += len(last) - len(kept)
            held, last = held[-(window // 2) or len(held) :], kept
        out = template([*held, (role, text)])
        same = common_length(last, out)
        span = text_span(template, held, role, out) if role == learned and same == len(last) else None
        inside = span is not None and span[0] >= same
        yield no, role, base + same, out[same:], len(last) - same, span[0] - same if inside else None, span[1] - same if inside else None
        held.append((role, text))
        last = out


FORMATTED = "conv_id {}, no long, role string, start long, piece string, rewritten long, loss_from long, loss_to long"


def format_conversations(
    rows: DataFrame, template: Template = instruct_template, window: int = 64,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, no, role, start, piece, rewritten, loss_from, loss_to), a row for each turn.

    Rows of a conversation stand together and in order; `read_conversations`
    relies on that, so nothing should be shuffled between.
    """
    kind = rows.select(F.col(id_col)).schema[0].dataType
    ordered = (
        rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ((c, r, t) for batch in batches for c, r, t in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True))
        made = ((c, *row) for c, group in groupby(turns, lambda x: x[0]) for row in located(((r, t) for _, r, t in group), template, window))
        yield from in_batches(made, schema)

    schema = pa.schema([("conv_id", _arrow(kind)), ("no", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("piece", pa.string()), ("rewritten", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
    return ordered.mapInArrow(render, FORMATTED.format(kind.simpleString()))


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows in batches, which end early where texts are long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


TEXTS = "conv_id {}, n_turns long, text string, loss array<struct<from: long, to: long>>, rewrites boolean"


def formatted_texts(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text, loss, rewrites), a row for each conversation, whose text must fit a row.

    `loss` holds the spans to learn from, in order; it is empty where the template rewrites history.
    """
    kind = formatted.schema["conv_id"].dataType
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    schema = pa.schema([("conv_id", _arrow(kind)), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(span)), ("rewrites", pa.bool_())])

    def joined(group: Iterator[tuple]) -> tuple:
        pieces, loss, rewrites, n = [""], [], False, 0
        for start, piece, rewritten, low, high in group:
            n += 1
            if rewritten:
                rewrites, pieces = True, ["".join(pieces)[:start]]
            pieces.append(piece)
            if low is not None:
                loss.append({"from": start + low, "to": start + high})
        return n, "".join(pieces), [] if rewrites else loss, rewrites

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(((c, *joined(group)) for c, group in conversations(batches)), schema)

    return formatted.mapInArrow(join, TEXTS.format(kind.simpleString()))


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Each conversation of a stream of formatted rows, with (start, piece, rewritten, loss_from, loss_to) of its turns."""
    columns = ("conv_id", "start", "piece", "rewritten", "loss_from", "loss_to")
    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in columns), strict=True))
    for c, group in groupby(rows, lambda x: x[0]):
        yield c, (x[1:] for x in group)


READ = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted texts of `instruct_template` say of each conversation.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    Roles and texts come from the formatted text alone, the loss from
    under its mask. Digests run along the stream of a conversation's rows. Texts
    that a template has rewritten can't be read here; see `formatted_texts`.
    """
    kind = formatted.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", _arrow(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(group: Iterator[tuple]) -> tuple:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = end = 0
        for start, piece, rewritten, low, high in group:
            if rewritten:
                raise ValueError(f"the template rewrote {rewritten} characters")
            end = start + len(piece)
            for role, text in turns_of(piece):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            if low is not None:
                text = unescaped(piece[low:high])
                chars += len(text)
                loss.update(text.encode())
        return n, turns.hexdigest(), chars, loss.hexdigest(), end

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(((c, *digest(group)) for c, group in conversations(batches)), schema)

    return formatted.mapInArrow(read, READ.format(kind.simpleString()))


def oracle() -> str:
    """The same rows in SQL: texts as they are, and the length of marks and escapes."""
    pattern = "|".join(re.sub(r"([\[\]\\])", r"\\\1", c) for c in (ESCAPE, *CONTROL))
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{pattern}')) AS chars,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 23 + length(role) + len(regexp_extract_all(role, '{pattern}')) END AS marks
  FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars + marks) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""
