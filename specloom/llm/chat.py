"""Chat formatting with a grammar that reads its own output back.

A turn is ``<s>[INST]role[/INST]text</s>``. A text that holds a control string gets a backslash
after that string's first character, and one more wherever backslashes already stand there, so
every control string in the output is the template's own and the escape undoes itself. Each turn
is parsed again by the deterministic grammar and compared with its source.

Turns are pieces of output, in order, so a conversation of any length streams through its task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, rows

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
ESCAPABLE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))
MARK = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def parse(piece: str) -> tuple[str, str, int] | None:
    """Role, text and where the formatted text starts; None if the piece is not one turn."""
    if not piece.startswith(OPEN) or not piece.endswith(CLOSE):
        return None
    marks = [(m.start(), m[0]) for m in MARK.finditer(piece)]
    if [m for _, m in marks] != ["<s>", "[INST]", ROLE_END, CLOSE]:
        return None
    role_end, text_at = marks[2][0], marks[2][0] + len(ROLE_END)
    return unescape(piece[len(OPEN) : role_end]), unescape(piece[text_at : marks[3][0]]), text_at


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the place of its text; tried plain, then escaped, until it reads back."""
    for inner_role, inner in ((role, text), (escape(role), escape(text))):
        piece = f"{OPEN}{inner_role}{ROLE_END}{inner}{CLOSE}"
        if (found := parse(piece)) and found[:2] == (role, text):
            return piece, found[2], len(piece) - len(CLOSE)
    raise ValueError("a turn does not read back")


FORMATTED = "conv_id long, position long, piece string, loss_start int, loss_end int"


def format_turns(turns: DataFrame, learn_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position, piece, loss_start, loss_end: the pieces of each conversation in order.

    Concatenated by position they are the formatted conversation. The loss mask covers the text of
    turns of ``learn_role`` (code points inside the piece; equal ends elsewhere). Null role or text
    is empty; rows with the same turn keep an order by role and text; repeated rows stay; a null
    conversation id is a conversation of its own; an empty table gives no row.
    """
    kept = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])

    def run(batches):
        out, now, position = Rows(schema), object(), 0
        for conv, role, text in rows(batches, "conv_id", "role", "text"):
            now, position = conv, position + 1 if conv == now else 0
            piece, start, end = render(role, text)
            yield from out.add(conv, position, piece, start, end if role == learn_role else start, weight=len(piece))
        yield from out.flush()

    return ordered.mapInArrow(run, FORMATTED)


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from pieces alone."""
    ordered = pieces.select("conv_id", "position", "piece", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        out, now, state = Rows(schema), object(), None
        for conv, piece, start, end in rows(batches, "conv_id", "piece", "loss_start", "loss_end"):
            if conv != now:
                if state:
                    yield from out.add(now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            found = parse(piece)
            if found is None:
                raise ValueError(f"conversation {conv} does not parse")
            learned = unescape(piece[start:end])
            state[0] += 1
            state[1].update(f"{found[0]}\n{found[1]}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(piece)
        if state:
            yield from out.add(now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        yield from out.flush()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
