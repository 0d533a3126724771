"""Chat formatting by a finite-state machine over roles and a declarative template.

Turns are range-partitioned by conversation and turn, so that a conversation of any length spreads over tasks. A task
formats a run of turns as one fragment, which carries its text, its loss spans and the machine's transition from every
state; fragments are then joined in order, and the transitions composed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_limits, tidy


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles are learned, and which roles may follow in which state.

    A turn is open, role, mid, text, close. `moves` maps a state to the states that roles lead to; a role that is not
    there breaks the order, and the machine goes on from `restart`, so that one fault is counted once.
    """

    open: str = "<|im_start|>"
    mid: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    accept: frozenset[str] = frozenset({"answered"})
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    restart: dict[str, str] = field(default_factory=lambda: {"system": "primed", "user": "asked", "assistant": "answered"})

    def __post_init__(self):
        if not (self.open.startswith("<|") and self.close.startswith("<|") and self.mid and "\n" in self.mid):
            raise ValueError("open and close begin with the escaped control string <|, and a newline ends the role")

    def states(self) -> list[str]:
        return sorted({self.start, *self.moves, *self.restart.values(), *(t for m in self.moves.values() for t in m.values())})

    def step(self, state: str, role: str) -> tuple[str, int]:
        """The next state, and 1 where the role may not follow."""
        to = self.moves.get(state, {}).get(role)
        return (to, 0) if to is not None else (self.restart.get(role, state), 1)


CHATML = Template()


def escape(text: str) -> str:
    """No control string is left: each < that backslashes and a bar follow gets one more backslash behind it."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[%<\n]", lambda m: f"%{ord(m[0]):02X}", role)


def unescape_role(role: str) -> str:
    return re.sub(r"%(25|3C|0A)", lambda m: chr(int(m[1], 16)), role)


def segments(role: str, text: str, template: Template = CHATML) -> list[tuple[str, bool]]:
    """The (text, loss) segments of one turn. Of a learned role's turn the text counts, the marks don't."""
    return [(template.open + escape_role(role) + template.mid, False), (escape(text), role in template.loss_roles), (template.close, False)]


def parse(formatted: str, template: Template = CHATML) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; anything else is an error."""
    at = 0
    while at < len(formatted):
        mid = formatted.find(template.mid, at)
        end = formatted.find(template.close, mid + len(template.mid))
        if not formatted.startswith(template.open, at) or mid < 0 or end < 0:
            raise ValueError("not a formatted conversation")
        yield unescape_role(formatted[at + len(template.open) : mid]), unescape(formatted[mid + len(template.mid) : end])
        at = end + len(template.close)


FRAGMENT = "conv_id long, part long, fragment int, n_turns long, formatted string, loss array<struct<begin:int,end:int>>, moves array<struct<state:string,to:string,faults:int>>"
_LOSS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_MOVES = pa.list_(pa.struct([("state", pa.string()), ("to", pa.string()), ("faults", pa.int32())]))


def format_fragments(conversations: DataFrame, template: Template = CHATML, max_chars: int = 1 << 18) -> DataFrame:
    """Fragments of the formatted conversations: conv_id, (part, fragment) that orders those of one conversation, n_turns,
    formatted, loss (spans of code points in it that are learned), moves (the machine's transitions over the fragment).

    Turns are ordered by turn, then role and text; null texts and roles are empty, a null turn comes first, rows
    without conv_id are one conversation without id. A fragment is closed when it has `max_chars` code points.
    """
    arrow_limits(conversations.sparkSession)
    keys = ["conv_id", "turn", "role", "text"]
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*keys[:3]).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id().cast("long"))
    names = [x.split()[0] for x in FRAGMENT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), _LOSS, _MOVES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, number, turns, text, loss, size = None, 0, 0, 0, [], [], 0
        state: dict[str, tuple[str, int]] = {}
        begun = False

        def fragment() -> list:
            return [conv, part, number, turns, "".join(text), loss, [{"state": s, "to": t, "faults": n} for s, (t, n) in state.items()]]

        for b in batches:
            done = []
            for c, role, said, p in zip(b.column("conv_id").to_pylist(), b.column("role"), b.column("text"), b.column("part").to_pylist(), strict=True):
                if not begun or c != conv or size >= max_chars:
                    if begun:
                        done.append(fragment())
                    number = number + 1 if begun and c == conv else 0
                    conv, part, turns, text, loss, size, begun = c, p, 0, [], [], 0, True
                    state = {s: (s, 0) for s in template.states()}
                role = role.as_py()
                for piece, learned in segments(role, said.as_py(), template):
                    if learned and piece:
                        loss.append({"begin": size, "end": size + len(piece)})
                    text.append(piece)
                    size += len(piece)
                turns += 1
                for s, (t, n) in state.items():
                    to, fault = template.step(t, role)
                    state[s] = (to, n + fault)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True) if done else [[]] * 7, types, strict=True)], names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(fragment(), types, strict=True)], names)

    return rows.mapInArrow(tidy(run), FRAGMENT)


def chat_report(fragments: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, order_faults, complete of each
    conversation, all read back from the formatted fragments.

    A digest over a conversation needs its fragments one after the other: they stream through one task, one fragment in
    memory at a time.
    """
    arrow_limits(fragments.sparkSession)
    rows = fragments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "fragment")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, order_faults long, complete boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def result() -> list:
            conv, n, turns, chars, learned, size, state, faults = now
            return [conv, n, turns.hexdigest(), chars, learned.hexdigest(), size, faults, state in template.accept and not faults]

        for b in batches:
            done = []
            for conv, formatted, loss, moves in zip(b.column("conv_id").to_pylist(), b.column("formatted"), b.column("loss"), b.column("moves"), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(result())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, template.start, 0]
                formatted = formatted.as_py()
                for role, text in parse(formatted, template):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss.as_py():
                    text = unescape(formatted[span["begin"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode("utf-8", "surrogatepass"))
                now[5] += len(formatted)
                move = next(m for m in moves.as_py() if m["state"] == now[6])
                now[6], now[7] = move["to"], now[7] + move["faults"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True) if done else [[]] * 8, types, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(result(), types, strict=True)], names)

    return rows.mapInArrow(tidy(run), schema)
