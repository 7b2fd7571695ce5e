"""Chat formatting with a grammar round trip.

Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Each rendered turn is
parsed again by the deterministic parser below and compared with its source; where
they differ the text's conflicting control strings are escaped, first only those that
the grammar knows, then every ``<|``-like string, until the two are identical. The
parser undoes escapes, so what it reads back is the source again.

Work on texts is done turn by turn wherever the turn lies. Only the last step, which
reads a conversation from its first character to its last, has the turns of one
conversation in one task; it streams over them in order and holds one turn at a time,
so that a conversation of any length takes bounded memory. (A SHA-256 over a
conversation can't be split further: its state passes from turn to turn.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.llm.common import in_batches

START, END = "<|im_start|>", "<|im_end|>"
#: An escaped control string has backslashes after its "<"; escaping adds one, reading takes one away.
KNOWN = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ANY = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
ROLE_READS = {v: k for k, v in ROLE_ESCAPES.items()}


class GrammarError(ValueError):
    pass


def escape(text: str, level: int) -> str:
    """Level 0: as it is. 1: control strings and their escaped forms. 2: every such beginning of a control string."""
    if not level:
        return text
    text = ANY.sub(r"<\1\\|", text) if level > 1 else KNOWN.sub(r"<\1\\|\2|>", text)
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def render(role: str, text: str, level: int = 0) -> str:
    role = re.sub(r"[\\\n|]", lambda m: ROLE_ESCAPES[m[0]], role)
    return f"{START}{role}\n{escape(text, level)}{END}\n"


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns (role, text, start, end) of a formatted conversation; start and end are the text's place in it.

    The grammar: conversation = turn*; turn = START role "\\n" text END "\\n", where
    neither role nor text holds START or END and the role holds no line break.
    """
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise GrammarError(f"no turn starts at {at}")
        line = formatted.find("\n", at)
        stop = formatted.find(END, at)
        if line < 0 or stop < line:
            raise GrammarError(f"the turn at {at} has no header or no end")
        start = line + 1
        if START in formatted[at + len(START) : stop] or formatted[stop + len(END) : stop + len(END) + 1] != "\n":
            raise GrammarError(f"the turn at {at} holds or is followed by something else")
        role = re.sub(r"\\[\\np]", lambda m: ROLE_READS[m[0]], formatted[at + len(START) : line])
        yield role, unescape(formatted[start:stop]), start, stop
        at = stop + len(END) + 1


def round_trip(role: str, text: str) -> tuple[str, int]:
    """The rendered turn that parses to exactly (role, text), and its escape level."""
    for level in (0, 1, 2):
        formatted = render(role, text, level)
        try:
            if [x[:2] for x in parse(formatted)] == [(role, text)]:
                return formatted, level
        except GrammarError:
            continue
    raise GrammarError("no escaping keeps this turn")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """Each turn as a segment of its conversation's formatted text: conv, turn, segment, escape_level, loss, source.

    A conversation's text is its segments joined in order of turn (null first); ties go
    by segment, and repeated rows are turns of their own. ``source`` is a digest of the
    turn as it came, for the reader of the whole to compare. ``loss`` is the place
    (start, end) in the segment of a text to learn from, null for other roles. A null
    role or text is the empty one, a text of any length is one turn; rows of a null
    conversation form one conversation; an empty table gives no rows. Only the four columns
    named reach the operator, so others may have any name.
    """
    rows = turns.select(turns[conv_col].cast("long").alias("conv"), turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("source", F.sha2(F.concat_ws("\n", "role", "text").cast("binary"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(role, *round_trip(role, text)) for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            loss = []
            for role, segment, _ in done:
                _, _, start, end = next(parse(segment))
                loss.append({"start": start, "end": end} if role == learn_role else None)
            kinds = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["turn"], batch["source"], pa.array([x[1] for x in done], pa.string()), pa.array([x[2] for x in done], pa.int32()), pa.array(loss, kinds)], ["conv", "turn", "source", "segment", "escape_level", "loss"])

    return in_batches(rows, run, "conv long, turn long, source string, segment string, escape_level int, loss struct<start:long,end:long>")


def read_back(segments: DataFrame) -> DataFrame:
    """What a reader of each formatted conversation finds in it, and that it is what went in.

    One row per conversation: conv, n_turns, turns_sha256 (role, line break, text, line
    break of each turn), loss_chars and loss_sha256 (the unescaped text under the loss
    mask), formatted_chars, escaped_turns. A conversation that does not read back as
    its source is an error, never a row.
    """
    ordered = segments.select("conv", "turn", "source", "segment", "escape_level", F.col("loss.start").alias("start"), F.col("loss.end").alias("end")).repartition("conv").sortWithinPartitions("conv", "turn", "segment")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped_turns"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        state: list | None = None

        def close() -> None:
            if state:
                rows.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]])

        for batch in batches:
            for conv, source, segment, level, start, end in zip(*(batch[x].to_pylist() for x in ("conv", "source", "segment", "escape_level", "start", "end")), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, sha256(), 0, sha256(), 0, 0]
                for said_by, said, _, _ in parse(segment):
                    if sha256(f"{said_by}\n{said}".encode()).hexdigest() != source:
                        raise GrammarError(f"conversation {conv} does not read back")
                    state[1] += 1
                    state[2].update(f"{said_by}\n{said}\n".encode())
                if start is not None:
                    learnt = unescape(segment[start:end])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(segment)
                state[6] += level > 0
            if len(rows) >= 1000:
                yield _rows(rows, names, kinds)
                rows = []
        close()
        yield _rows(rows, names, kinds)

    return in_batches(ordered, run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long")


def _rows(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def placed(segments: DataFrame) -> DataFrame:
    """``segments`` with ``begin``, their place in the conversation's formatted text, and ``loss`` in its code points."""
    before = Window.partitionBy("conv").orderBy("turn", "segment").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).cast("long")
    moved = F.when(F.col("loss").isNotNull(), F.struct((F.col("begin") + F.col("loss.start")).alias("start"), (F.col("begin") + F.col("loss.end")).alias("end")))
    return segments.withColumn("begin", begin).withColumn("loss", moved)
