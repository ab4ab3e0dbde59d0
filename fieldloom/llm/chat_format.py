"""Operator 3: chat formatting with a finite-state machine over roles and a declarative template.

A conversation's turns run through the machine in order. Each turn becomes three
segments (opening mark, text, closing mark), each with a loss flag. Control
strings inside a text are broken by an escape that can be undone, so the output
can be read back to the same turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Template:
    """How turns are written and which order is valid.

    ``opening`` may hold ``{role}``. ``machine`` maps a state to the roles allowed there and the state they lead to; a
    conversation is valid if it ends in one of ``final``. Segments of the roles in ``learned`` carry loss, text only.
    ``controls`` are the strings that may not appear inside a text.
    """

    opening: str = "<|turn|>{role}\n"
    closing: str = "<|end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple[str, ...] = ("answered",)
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escaped(self, text: str) -> str:
        """Double each backslash, then put ``\\.`` after the first character of every control string."""
        heads = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in self.controls)
        return re.sub(heads, lambda m: m[0] + "\\.", text.replace("\\", "\\\\"))

    def plain(self, text: str) -> str:
        """Undo ``escaped``; in a role a line feed is written as backslash and n."""
        return re.sub(r"\\([\\.n])", lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Read role and text of each turn back from a formatted conversation."""
        opening = re.escape(self.opening).replace(re.escape("{role}"), "(?P<role>.*?)")
        for m in re.finditer(opening + "(?P<text>.*?)" + re.escape(self.closing), formatted, re.DOTALL):
            yield self.plain(m["role"]), self.plain(m["text"])


def _by_conversation(work: Callable[[object, Iterable[dict]], Iterator[dict]], schema: pa.Schema, size: int = 2000) -> Callable:
    """Run ``work`` on the rows of each conversation as they stream by, ordered, never held together."""
    from itertools import groupby

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        out: list[dict] = []
        for key, own in groupby(rows, key=lambda r: r["conv_id"]):
            for row in work(key, own):
                out.append(row)
                if len(out) >= size:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation: conv_id, turn_index, part (0 opening, 1 text, 2 closing), segment, loss, valid, state.

    Turns are ordered by turn, ties by role and text; a null turn comes first. ``valid`` says whether the turns up to and
    including this one follow the machine, ``state`` is where it stands ("error" once left). A conversation whose turns
    break the order is formatted all the same; the caller decides by ``valid`` and the last ``state``. Null role and text
    count as empty, a null conv_id is one conversation, repeated rows are turns of their own. Other columns are left.

    Rows of a conversation meet in one task but stream through it in sorted order; none is collected.
    """
    template = template or Template()
    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("turn_index", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("segment", T.StringType()),
                           T.StructField("loss", T.BooleanType()), T.StructField("valid", T.BooleanType()), T.StructField("state", T.StringType())])

    def work(key: object, turns: Iterable[dict]) -> Iterator[dict]:
        state = "start"
        for i, row in enumerate(turns):
            state = template.machine.get(state, {}).get(row["role"], "error")
            role = template.escaped(row["role"]).replace("\n", "\\n")
            loss = row["role"] in template.learned
            for part, segment in enumerate((template.opening.replace("{role}", role), template.escaped(row["text"]), template.closing)):
                yield {"conv_id": key, "turn_index": i, "part": part, "segment": segment, "loss": loss and part == 1, "valid": state != "error", "state": state}
    return ordered.mapInArrow(_by_conversation(work, to_arrow_schema(schema)), schema)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each formatted conversation, from its segments alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, valid.

    The turns are parsed from the formatted text, the loss text from the flagged segments. ``segments`` must come straight
    from ``format_conversations``, whose order it keeps.
    """
    template = template or Template()
    kind = segments.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("valid", T.BooleanType())])

    def work(key: object, rows: Iterable[dict]) -> Iterator[dict]:
        turns, learned, n, chars, formatted, state, pending = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, "start", ""
        for row in rows:
            formatted += len(row["segment"])
            pending += row["segment"]
            state = row["state"]
            if row["loss"]:
                text = template.plain(row["segment"])
                chars += len(text)
                learned.update(text.encode())
            if row["part"] == 2:
                for role, text in template.turns(pending):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                pending = ""
        yield {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": learned.hexdigest(), "formatted_chars": formatted, "valid": state in template.final}
    return segments.mapInArrow(_by_conversation(work, to_arrow_schema(schema)), schema)
