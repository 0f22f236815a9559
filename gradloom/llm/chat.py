"""Chat formatting with DataFrame functions only.

A template declares the markers, the roles that carry loss and the allowed turn
order as a finite-state machine. Turns of a conversation are folded through the
machine's transition map; the formatter emits text segments, each with a loss
flag, and their concatenation is the training text. Control strings inside
texts are escaped reversibly: ``<`` followed by any number of backslashes and
``|`` gets one more backslash, so that ``<|`` only ever occurs in markers.

Defined cases: a null text is empty, a null role is the empty role (never
allowed by the machine, but formatted); a null turn sorts first, and rows that
repeat a turn are ordered by role, then text, each formatted as its own turn;
rows without conv_id form one conversation; very long texts are formatted whole
(a conversation is one value of one task); an empty table gives no rows; other
columns are ignored, whatever their names. A conversation that breaks the turn order is formatted like any other
and marked by ``valid`` and ``first_bad_turn``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers must begin with ``<|`` and hold no backslash."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state. A role that has no entry in a state breaks the order for good.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "primed",
            ("start", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    ends: tuple[str, ...] = ("answered",)


DEFAULT = Template()
BROKEN = "broken"


def escaped(text: Column) -> Column:
    """Reversible: no ``<|`` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """Also without line breaks, which end a role."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    # Cut at doubled backslashes first, so that what follows one isn't read as a line break.
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def state_after(turns: Column, template: Template = DEFAULT) -> Column:
    """The machine folded over an array of turns: struct(state, n, bad), bad being the index of the first turn out of order."""
    pairs = [x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\x00{role}"), F.lit(to))]
    moves = F.create_map(*pairs)
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(-1).alias("bad"))

    def step(s: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(s["state"], F.lit("\x00"), turn["role"])), F.lit(BROKEN))
        return F.struct(to.alias("state"), (s["n"] + 1).alias("n"), F.when((s["bad"] < 0) & (to == BROKEN), s["n"]).otherwise(s["bad"]).alias("bad"))

    return F.aggregate(turns, start, step)


def format_chats(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>, valid, first_bad_turn."""
    t = template
    turns = rows.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(turn: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        head = F.concat(F.lit(t.before_role), escaped_role(turn["role"]), F.lit(t.after_role))
        return F.array(part(head, no), part(escaped(turn["text"]), turn["role"].isin(*t.loss_roles)), part(F.lit(t.after_text + t.after_turn), no))

    out = convs.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state_after(F.col("turns"), t).alias("machine"))
    return out.select(
        "conv_id",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        F.col("machine.state").isin(*t.ends).alias("valid"),
        F.when(F.col("machine.bad") >= 0, F.col("machine.bad")).alias("first_bad_turn"),
    )


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Parse formatted texts: adds turns array<struct<role, text>> and loss_text, both unescaped."""
    t = template
    pieces = F.filter(F.split(F.col("formatted"), _literal(t.before_role)), lambda p: p != "")

    def turn(piece: Column) -> Column:
        end = F.length(piece) - len(t.after_text + t.after_turn)
        at = F.instr(piece, t.after_role)
        body = F.substring(piece, at + len(t.after_role), end - at + 1 - len(t.after_role))
        return F.struct(unescaped_role(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescaped(body).alias("text"))

    loss = F.filter("segments", lambda s: s["loss"])
    return formatted.withColumns(
        {
            "turns": F.transform(pieces, turn),
            "loss_text": F.array_join(F.transform(loss, lambda s: unescaped(s["text"])), ""),
        }
    )


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|<>" else c for c in text)
