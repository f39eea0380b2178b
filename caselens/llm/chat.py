"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template gives the
text segments, each with a loss flag.

A text cannot pass for markup: a backslash is doubled, and one is put into every control string inside a text; reading
back undoes both. Defined cases: a null text or role is the empty string; rows of one conversation are taken by turn
(null first), then role, then text, repeated rows included; a null conv_id is a conversation of its own; a role that the
template does not know is written with its name and trains nothing; turns in a wrong order are formatted all the same,
and ``valid`` and ``bad_turn`` (the place of the first wrong one) say so; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How turns of a role are written: markup before and after the text, and whether the text is trained on."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles with their markup, the markup of any other role, and the machine: state -> role -> next state."""

    roles: dict[str, Turn]
    other: tuple[str, str, str] = ("<ROLE>", "</ROLE>", "</TURN>")
    machine: dict[str, dict[str, str]] = field(default_factory=dict)
    start: str = "start"

    def controls(self) -> list[str]:
        marks = [m.strip() for t in self.roles.values() for m in (t.before, t.after)]
        return sorted({*marks, *self.other}, key=lambda m: (-len(m), m))


INST = Template(
    roles={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    machine={
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
)

SCHEMA = "formatted string, segments array<struct<start:int,end:int,loss:boolean>>, valid boolean, bad_turn int"


class Formatter:
    """Writes and reads conversations under a template."""

    def __init__(self, template: Template = INST):
        self.template = template
        self.control = re.compile("|".join(map(re.escape, template.controls())))
        self.opening = {t.before: (role, t) for role, t in template.roles.items()}

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def write(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]], bool, int | None]:
        """The formatted text, its segments (start, end, loss) without gaps, and what the machine says."""
        out: list[str] = []
        segments: list[tuple[int, int, bool]] = []
        at = 0

        def add(text: str, loss: bool) -> None:
            nonlocal at
            out.append(text)
            if loss or not (segments and not segments[-1][2]):
                segments.append((at, at + len(text), loss))
            else:
                segments[-1] = (segments[-1][0], at + len(text), False)
            at += len(text)

        open_role, close_role, end = self.template.other
        for role, text in turns:
            turn = self.template.roles.get(role)
            if turn:
                add(turn.before, False)
                add(self.escape(text), turn.loss)
                add(turn.after, False)
            else:
                add(open_role + self.escape(role) + close_role + self.escape(text) + end, False)
        bad = self.first_bad([r for r, _ in turns])
        return "".join(out), segments, bad is None, bad

    def first_bad(self, roles: list[str]) -> int | None:
        """The place of the first turn that the machine has no step for."""
        state = self.template.start
        for n, role in enumerate(roles):
            state = self.template.machine.get(state, {}).get(role)
            if state is None:
                return n
        return None

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a formatted text."""
        turns, at = [], 0
        open_role, close_role, end = self.template.other
        while at < len(formatted):
            for before, (role, turn) in self.opening.items():
                if formatted.startswith(before, at):
                    stop = formatted.index(turn.after, at + len(before))
                    turns.append((role, self.unescape(formatted[at + len(before) : stop])))
                    at = stop + len(turn.after)
                    break
            else:
                if not formatted.startswith(open_role, at):
                    raise ValueError(f"no turn begins at {at}")
                middle = formatted.index(close_role, at)
                stop = formatted.index(end, middle)
                turns.append((self.unescape(formatted[at + len(open_role) : middle]), self.unescape(formatted[middle + len(close_role) : stop])))
                at = stop + len(end)
        return turns

    def trained(self, formatted: str, segments) -> str:
        """All text under the loss mask, unescaped."""
        return "".join(self.unescape(formatted[s:e]) for s, e, loss in segments if loss)


def format_conversations(rows: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, formatted, segments, valid, bad_turn: one row per conversation of ``rows`` (conv_id, turn, role, text)."""

    @F.pandas_udf(SCHEMA)
    def write(turns: pd.Series) -> pd.DataFrame:
        form = Formatter(template)
        return pd.DataFrame([form.write([(t["role"], t["text"]) for t in c]) for c in turns], columns=["formatted", "segments", "valid", "bad_turn"])

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", text("role"), text("text")))).alias("turns"))
    return turns.withColumn("f", write("turns")).select("conv_id", "f.*")


def digests(formatted: DataFrame, template: Template = INST) -> DataFrame:
    """What the formatted texts and their segments hold, read back: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(formatted: pd.Series, segments: pd.Series) -> pd.DataFrame:
        form, out = Formatter(template), []
        for text, parts in zip(formatted, segments, strict=True):
            turns = form.read(text)
            loss = form.trained(text, [(s["start"], s["end"], s["loss"]) for s in parts])
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        return pd.DataFrame(out, columns=names)

    return formatted.withColumn("d", read("formatted", "segments")).select("conv_id", "d.*")
