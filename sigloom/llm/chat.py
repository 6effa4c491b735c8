"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows are dealt by conversation and sorted by turn, then streamed: the machine keeps one state, so a
conversation of any length needs no more memory than a row.  Every turn becomes segments (mark,
body, end), each with a loss flag.  Control strings inside a body are escaped with a backslash, so
the written output can be parsed back without loss.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATTED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("in_turn", pa.bool_()), ("state", pa.string())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as one Arrow batch; ids stay whole numbers, null or not."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, which roles may follow which state, and whose bodies carry loss."""

    opening: str = "### "
    colon: str = ": "
    end: str = "</turn>"
    after: str = "\n"
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset = frozenset({"assistant"})
    #: state -> role -> next state; a role that is missing is out of turn
    moves: dict = field(default_factory=lambda: {"start": {"system": "asked", "user": "user"}, "asked": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: frozenset = frozenset({"assistant"})

    @property
    def control(self) -> re.Pattern:
        marks = [re.escape(m) for m in (self.opening, self.end)]
        return re.compile(r"\\|(?=" + "|".join(marks) + ")")

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: "\\\\" if m[0] else "\\", text)

    @property
    def turn(self) -> re.Pattern:
        stop = re.escape(self.end)
        return re.compile(re.escape(self.opening) + r"((?:\\.|(?!" + re.escape(self.colon) + r")[^\\])*)" + re.escape(self.colon) + r"((?:\\.|(?!" + stop + r")[^\\])*)" + stop + re.escape(self.after), re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Mark, body and end of one turn with their loss flags.  A role without a name stands as JSON after a question mark."""
        name = self.names.get(role)
        if name is None:
            name = "?" + json.dumps(role).replace("\\", "\\\\").replace(":", "\\:")
        return [(f"{self.opening}{name}{self.colon}", False), (self.escape(text), role in self.loss), (self.end + self.after, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) of a formatted string; an error if anything else is in it."""
        back, out, at = {v: k for k, v in self.names.items()}, [], 0
        plain = lambda s: re.sub(r"\\(.)", r"\1", s, flags=re.S)
        while at < len(formatted):
            m = self.turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            name = m[1]
            out.append((json.loads(plain(name)[1:]) if name.startswith("?") else back[name], plain(m[2])))
            at = m.end()
        return out


def format_chats(rows: DataFrame, template: Template | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, position, role, segments (array of struct text, loss), in_turn, state.

    Turns are ordered by ``turn``, ties by role and text; null roles and texts are empty strings; a
    null conversation id is a conversation of its own.  ``in_turn`` is false where the machine has no
    move (its state then stays as it is); a conversation is valid if all its turns are in turn and
    its last state is final.  Repeated rows are turns like any other; other columns are ignored.
    """
    t = template or Template()
    base = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, state = object(), 0, "start"
        for batch in batches:
            out = []
            for c, r, x in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if c != now:
                    now, place, state = c, 0, "start"
                to = t.moves.get(state, {}).get(r)
                state = to or state
                out.append((c, place, r, [{"text": a, "loss": b} for a, b in t.segments(r, x)], to is not None, state))
                place += 1
            yield _batch(out, FORMATTED)

    dealt = base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id bigint, position bigint, role string, segments array<struct<text: string, loss: boolean>>, in_turn boolean, state string")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digest of each conversation, parsed from the formatted text and the loss flags alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.  Streams the rows of
    a conversation in order; only running digests are kept.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, held, loss, n, chars, marked, valid, state = none, None, None, 0, 0, 0, True, ""

        def closed():
            return (now, n, held.hexdigest(), marked, loss.hexdigest(), chars, bool(valid and state in t.final))

        for batch in batches:
            out = []
            for c, segments, ok, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if now is none or c != now:
                    if now is not none:
                        out.append(closed())
                    now, held, loss, n, chars, marked, valid = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
                whole = "".join(x["text"] for x in segments)
                for role, text in t.parse(whole):
                    held.update(f"{role}\n{text}\n".encode())
                    n += 1
                for x in segments:
                    if x["loss"]:
                        plain = re.sub(r"\\(.)", r"\1", x["text"], flags=re.S)
                        loss.update(plain.encode())
                        marked += len(plain)
                chars += len(whole)
                valid, state = valid and ok, s
            yield _batch(out, DIGEST)
        if now is not none:
            yield _batch([closed()], DIGEST)

    dealt = formatted.select("conv_id", "position", "segments", "in_turn", "state").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.select("conv_id", "segments", "in_turn", "state").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
