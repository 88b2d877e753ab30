"""Chat formatting: a state machine over roles, and segments with loss flags from a declarative template.

All of it is built-in functions on one row per conversation. Defined results: turns are ordered by turn (null first),
then role, then text, so ties and repeated rows have a fixed order and all stay; a null text or role is empty; rows with
a null conv_id form one conversation; conversations in a wrong order of roles are formatted too and marked invalid; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilattice.llm.rows import pick


@dataclass(frozen=True)
class Template:
    """What is written around a turn, which roles are learned, and which role may follow which.

    A turn is ``open + role + after_role + text + close``. ``controls`` are all strings that a text or a role must not
    contain; inside them they are broken up behind their first sign by ``escape`` and a colon, and ``escape`` itself is
    doubled.
    """

    open: str = "<|turn|>"
    after_role: str = "<|text|>"
    close: str = "<|end|>\n"
    controls: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state; a pair that is absent leads to ``reject``, where a conversation stays.
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepted: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for mark in (self.open, self.after_role, self.close.strip()):
            if mark not in self.controls:
                raise ValueError(f"{mark!r} has to be one of the controls")
        for a in self.controls:
            if len(a) < 2 or self.escape in a or len(self.escape) != 1:
                raise ValueError(f"{a!r} can't be escaped")
            for b in self.controls:
                if any(a.endswith(b[:n]) for n in range(1, len(b))) and a != b:
                    raise ValueError(f"{a!r} and {b!r} can overlap")

    def escaped(self, text: Column) -> Column:
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        return F.regexp_replace(doubled, starts, f"$0{re.escape(self.escape)}:")

    def unescaped(self, text: Column) -> Column:
        e = re.escape(self.escape)
        return F.regexp_replace(text, f"{e}({e})|{e}:", "$1")

    def final_state(self, roles: Column) -> Column:
        moves = F.create_map(*[F.lit(x) for (a, role), b in self.moves.items() for x in (f"{a}\n{role}", b)])
        step = lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("reject"))
        return F.aggregate(roles, F.lit(self.start), step)


def conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: all turns of a conversation in order.

    A conversation is one training example and its output is one string, so its turns meet in one row.
    """
    rows = pick(table, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chat(grouped: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, valid, segments``: the output of a conversation as ``array<struct<text, loss>>`` in order.

    Each turn gives its frame and role without loss, its text with the loss flag of its role, and its close without.
    """
    t = template or Template()
    learned = lambda role: role.isin(*t.learned)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of_turn = lambda x: F.array(
        segment(F.concat(F.lit(t.open), t.escaped(x["role"]), F.lit(t.after_role)), F.lit(False)),
        segment(t.escaped(x["text"]), learned(x["role"])),
        segment(F.lit(t.close), F.lit(False)),
    )
    state = t.final_state(F.col("turns.role"))
    return grouped.select("conv_id", state.isin(*t.accepted).alias("valid"), F.flatten(F.transform("turns", of_turn)).alias("segments"))


def read_chat(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, valid, formatted, turns, learned``: what the output says, from its text and loss flags alone.

    ``turns`` are read from the joined text by the template's marks; ``learned`` are the segments under the loss mask.
    """
    t = template or Template()
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    parts = F.split(F.col("formatted"), re.escape(t.close))
    body = lambda p: F.split(F.substr(p, F.lit(len(t.open) + 1)), re.escape(t.after_role), 2)
    turn = lambda p: F.struct(t.unescaped(F.get(body(p), F.lit(0))).alias("role"), t.unescaped(F.get(body(p), F.lit(1))).alias("text"))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescaped(s["text"]))
    return formatted.select("conv_id", "valid", whole.alias("formatted"), learned.alias("learned")).select(
        "conv_id", "valid", "formatted", F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn).alias("turns"), "learned"
    )


def chat_digests(table: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation with digests of what is read back from its output."""
    back = read_chat(format_chat(conversations(table), template), template)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
