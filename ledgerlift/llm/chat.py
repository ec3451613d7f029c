"""Conversations to training texts with a loss mask, from a declarative template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How a conversation is written, and which orders of roles are right.

    A turn is ``opening``, role, line break, text, ``closing``, line break. Both marks begin with
    ``<|``. ``transitions`` is the machine: state to role to next state. The texts of
    ``trained`` roles carry loss; marks and roles never do.
    """

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "instructed", "user": "asked"},
        "instructed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })


CHATML = ChatTemplate()


def escaped(text: Column) -> Column:
    """Text in which no ``<|`` is left: each ``<``, any backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escaped_role(role: Column) -> Column:
    """A role on one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    marked = F.replace(role, F.lit("\\\\"), F.lit("\\\0"))
    return unescaped(F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\\\0"), F.lit("\\")))


def format_conversations(
    rows: DataFrame, template: ChatTemplate = CHATML, *,
    conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``valid``, ``problem``, ``segments``,
    ``formatted``.

    ``segments`` is an array of (text, loss); its texts joined are ``formatted``. The machine of the
    template runs over the roles: ``problem`` names the first turn it refuses (``turn 3: user``) or
    ``unfinished`` where it ends outside an accepting state; such conversations are formatted all the
    same, and ``valid`` says which to use. Control strings in texts are escaped reversibly.

    Turns are ordered by their number, ties by role and text, null numbers first. A null role or
    text counts as empty. A null id is an id of its own. Rows that repeat are turns like any other.
    An empty table gives no rows; other columns are ignored.

    A conversation becomes one text, so its rows meet in one task by definition; the shuffle is by
    conversation, and nothing larger than one conversation is ever held.
    """
    moves = F.create_map(*(
        F.lit(x) for state, to in template.transitions.items() for r, next_state in to.items()
        for x in (f"{state}\0{r}", next_state)
    ))
    turns = rows.select(
        F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def step(state: Column, one: Column) -> Column:
        goal = F.try_element_at(moves, F.concat(state["state"], F.lit("\0"), one["role"]))
        stuck = state["problem"].isNotNull()
        refused = F.concat(F.lit("turn "), state["n"].cast("string"), F.lit(": "), one["role"])
        return F.struct(
            F.coalesce(goal, state["state"]).alias("state"), (state["n"] + 1).alias("n"),
            F.when(stuck, state["problem"]).when(goal.isNull(), refused).alias("problem"),
        )

    begin = F.struct(
        F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("problem")
    )

    def end(state: Column) -> Column:
        done = state["state"].isin(*template.accepting)
        return F.when(state["problem"].isNotNull(), state["problem"]).when(~done, F.lit("unfinished"))

    def segments_of(one: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template.opening), _escaped_role(one["role"]), F.lit("\n")).alias("text"),
                     F.lit(False).alias("loss")),
            F.struct(escaped(one["text"]).alias("text"), one["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(f"{template.closing}\n").alias("text"), F.lit(False).alias("loss")),
        )

    checked = turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", begin, step, end).alias("problem"),
        F.flatten(F.transform("turns", segments_of)).alias("segments"),
    )
    return checked.select(
        "conv_id", "n_turns", F.col("problem").isNull().alias("valid"), "problem", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns (role, text) that a formatted text holds, unescaped."""
    turns = F.split(formatted, re.escape(f"{template.closing}\n").replace("\\\n", "\n"), -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def parse(turn: Column) -> Column:
        body = F.substring(turn, F.lit(len(template.opening) + 1), F.length(turn))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(_unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(turns, parse)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
