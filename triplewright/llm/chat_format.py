"""Chat formatting with a role state machine, in DataFrame expressions only.

A template is data: markers per role, which roles the loss covers, the transitions between roles and the
roles a conversation may end with. From it come

* ``segments``: array of (text, loss) in order; their texts joined are ``formatted``;
* ``valid`` and ``first_bad_turn`` (0-based, null when every turn follows the machine);
* ``read_back``: the turns and the text under the loss mask, recovered from the output alone.

Control strings inside a text are broken by a backslash after their first character, and each backslash
is doubled, so no control string survives in a text and the text comes back exactly.

Defined results: null texts and roles count as empty; turns are ordered by (turn, role, text), null turns
first; repeated rows are turns of their own; a role without markers of its own is written with its name; a
conversation of a single row, or one that breaks the machine, is formatted like any other and flagged; an
empty table gives an empty table; columns other than the four named ones are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, loss flags and turn order. ``roles``: name -> block; a block NAME is written [NAME]text[/NAME]."""

    roles: dict[str, str] = field(default_factory=lambda: {"system": "SYS", "user": "INST", "assistant": "OUT"})
    other: str = "TURN"
    role_end: str = "[ROLE]"
    begin: str = "<s>"
    end_after: dict[str, str] = field(default_factory=lambda: {"assistant": "</s>"})
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "<start>"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"<start>": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def blocks(self) -> list[str]:
        return [*self.roles.values(), self.other]

    def controls(self) -> list[str]:
        """Every string with a meaning in the output. Each starts with < or [ and has neither further on."""
        found = [self.begin, *self.end_after.values(), "</s>", self.role_end]
        found += [x for b in self.blocks() for x in (f"[{b}]", f"[/{b}]")]
        found = list(dict.fromkeys(found))
        if any(x[0] not in "<[" or set(x[1:]) & set("<[\\") for x in found):
            raise ValueError("a control string starts with < or [ and holds neither of them, nor a backslash, after that")
        return found


LLAMA_LIKE = ChatTemplate()


def _java(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def escape(text: Column, template: ChatTemplate = LLAMA_LIKE) -> Column:
    tails = {first: "|".join(_java(c[1:]) for c in template.controls() if c[0] == first) for first in "<["}
    starts = "|".join(rf"{_java(first)}(?=(?:{tail}))" for first, tail in tails.items() if tail)
    return F.regexp_replace(text, F.lit(rf"\\|{starts}"), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\(\\?)"), F.lit("$1"))


def _lookup(key: Column, pairs: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _segments(turn: Column, template: ChatTemplate) -> Column:
    """Opening marker, text, closing marker of one turn; only the text of a loss role is under the mask."""
    role, text = turn["role"], turn["text"]
    known = role.isin(*template.roles)
    opening = F.when(known, _lookup(role, {r: f"[{b}]" for r, b in template.roles.items()}, "")).otherwise(F.concat(F.lit(f"[{template.other}]"), escape(role, template), F.lit(template.role_end)))
    closing = F.concat(_lookup(role, {r: f"[/{b}]" for r, b in template.roles.items()}, f"[/{template.other}]"), _lookup(role, template.end_after, ""))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(seg(opening, F.lit(False)), seg(escape(text, template), role.isin(*template.loss_roles)), seg(closing, F.lit(False)))


def _machine(turns: Column, template: ChatTemplate) -> Column:
    """Fold of the roles: the state after the last turn, and the first turn that no move allows."""
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        role = turn["role"]
        allowed = F.lit(False)
        for state, to in template.moves.items():
            allowed = F.when(acc["state"] == state, role.isin(*to)).otherwise(allowed)
        return F.struct(role.alias("state"), (acc["at"] + 1).alias("at"), F.coalesce(acc["bad"], F.when(~allowed, acc["at"])).alias("bad"))

    return F.aggregate(turns, begin, step)


def format_chats(rows: DataFrame, template: ChatTemplate = LLAMA_LIKE) -> DataFrame:
    """One row per conv_id: segments, formatted, valid, first_bad_turn.

    The grouping keeps one output per conversation, so a conversation's own rows meet in one task; the
    map-side half of ``collect_list`` sends one row per conversation and task.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(begin, F.flatten(F.transform("turns", lambda t: _segments(t, template))))
    ran = chats.select("conv_id", segments.alias("segments"), _machine(F.col("turns"), template).alias("ran"))
    return ran.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("ran.bad").isNull() & F.col("ran.state").isin(*template.final)).alias("valid"),
        F.col("ran.bad").alias("first_bad_turn"),
    )


def read_back(chats: DataFrame, template: ChatTemplate = LLAMA_LIKE) -> DataFrame:
    """``chats`` of :func:`format_chats` with ``turns`` (role, text) parsed from ``formatted`` and ``loss_text`` from the mask."""
    block = rf"(?s)\[({'|'.join(re.escape(b) for b in template.blocks())})\](.*?)\[/\1\]"
    find = lambda group: F.regexp_extract_all("formatted", F.lit(block), F.lit(group))
    role_end = F.lit(template.role_end)

    def turn(kind: Column, body: Column) -> Column:
        cut = F.instr(body, template.role_end)
        named = kind == template.other
        role = F.when(named, unescape(F.substring(body, F.lit(1), cut - 1))).otherwise(_lookup(kind, {b: r for r, b in template.roles.items()}, ""))
        text = F.when(named, F.substring(body, cut + F.length(role_end), F.length(body))).otherwise(body)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    found = chats.withColumn("_kinds", find(1)).withColumn("_bodies", find(2))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return found.withColumn("turns", F.zip_with("_kinds", "_bodies", turn)).withColumn("loss_text", loss).drop("_kinds", "_bodies")


def digests(chats: DataFrame, template: ChatTemplate = LLAMA_LIKE) -> DataFrame:
    """Counts and SHA-256 digests of what :func:`read_back` recovers; ``first_bad_turn`` is -1 where there is none."""
    back = read_back(chats, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.coalesce(F.col("first_bad_turn").cast("long"), F.lit(-1)).alias("first_bad_turn"),
    )
