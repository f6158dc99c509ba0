"""Conversations to training text: turn order, marked turns, and a loss mask, from a declared template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are written, and which role may follow which.

    ``opening`` and ``closing`` stand around a turn, per role; ``{role}`` in them stands for the role, as
    for roles that the template does not list (``other``).  ``follows``: state -> role -> next
    state; ``final`` are the states in which a conversation may end.  ``learnt`` are the roles whose
    texts count in the loss.  Control strings must be two characters or more, hold no backslash, and
    begin with a character that occurs nowhere else in them.
    """

    opening: dict[str, str] = field(
        default_factory=lambda: {"system": "[SYS]", "user": "[INST]", "assistant": "[ASST]"}
    )
    closing: dict[str, str] = field(
        default_factory=lambda: {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    follows: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant",)
    learnt: tuple[str, ...] = ("assistant",)
    extra: tuple[str, ...] = ("<s>",)

    @property
    def controls(self) -> list[str]:
        return sorted({*self.opening.values(), *self.closing.values(), *self.other, *self.extra})

    def __post_init__(self) -> None:
        firsts = {control[0] for control in self.controls}
        for control in self.controls:
            if len(control) < 2 or ESCAPE in control or any(first in control[1:] for first in firsts):
                raise ValueError(f"Not usable as a control string: {control!r}")


def quoted(text: str) -> str:
    """A text as a regular expression that matches it."""
    return "".join(char if char.isalnum() else f"\\{char}" for char in text)


def replaced(text: Column, template: Template, change: str) -> Column:
    """Give every control string in a text another backslash (``change`` +) or take one (-)."""
    for first in sorted({control[0] for control in template.controls}):
        rests = "|".join(quoted(c[1:]) for c in sorted(template.controls, key=len, reverse=True) if c[0] == first)
        mark, lead = quoted(first), first if first.isalnum() else f"\\{first}"
        if change == "+":
            text = F.regexp_replace(text, f"{mark}(\\\\*)({rests})", f"{lead}\\\\$1$2")
        else:
            text = F.regexp_replace(text, f"{mark}\\\\(\\\\*)({rests})", f"{lead}$1$2")
    return text


def escape(text: Column, template: Template) -> Column:
    """``text`` without control strings: each one, and each one escaped before, gets one more backslash."""
    return replaced(text, template, "+")


def unescape(text: Column, template: Template) -> Column:
    """The text that escape() was given."""
    return replaced(text, template, "-")


def looked_up(role: Column, values: dict[str, str], default: Column) -> Column:
    found = F.create_map(*(F.lit(part) for pair in values.items() for part in pair))
    return F.coalesce(F.try_element_at(found, role), default)


def segments(turns: DataFrame, template: Template, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per turn with three segments: opening, text and closing, and whether the text is learnt.

    Every turn is formatted by itself, without a look at others.
    """
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    known = who.isin(list(template.opening))
    unknown = F.concat(F.lit(template.other[0]), escape(who, template), F.lit(template.other[1]))
    parts = F.array(
        F.struct(looked_up(who, template.opening, unknown).alias("text"), F.lit(False).alias("loss")),
        F.struct(
            escape(F.coalesce(F.col(text), F.lit("")), template).alias("text"),
            (known & who.isin(list(template.learnt))).alias("loss"),
        ),
        F.struct(looked_up(who, template.closing, F.lit(template.other[2])).alias("text"), F.lit(False).alias("loss")),
    )
    return turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), who.alias("role"), parts.alias("segments"),
        F.coalesce(F.col(text), F.lit("")).alias("plain"),
    )


def order_state(roles: Column, template: Template) -> Column:
    """The state that the machine reaches over an array of roles; ``error`` once no step is allowed."""
    steps = {f"{state} {role}": after for state, allowed in template.follows.items() for role, after in allowed.items()}
    return F.aggregate(
        roles, F.lit("start"), lambda state, role: looked_up(F.concat_ws(" ", state, role), steps, F.lit("error"))
    )


def format_chats(
    turns: DataFrame,
    template: Template | None = None,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Per conversation its id, ``formatted``, ``loss`` (array of start and length in ``formatted``) and ``valid``.

    Turns are ordered by number, then by role and text; a null number comes first.  ``valid`` says
    whether the roles follow the template's machine to a final state; other conversations are
    formatted as well.  Control strings inside texts and unknown roles are escaped reversibly.
    Null texts count as empty, null roles as the role of an empty name, a null id is a
    conversation.  Repeated rows are turns of their own.  Other columns are left out; an empty table
    gives no rows.  A conversation is one row of the result, so its turns meet in one task.
    """
    template = template or Template()
    rows = segments(turns, template, conversation, turn, role, text)
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63)).cast("bigint")).alias("turn"), "role", "plain", "segments")))
    chats = rows.groupBy("conversation").agg(ordered.alias("turns"))
    flat = F.flatten(F.col("turns.segments"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(state: Column, part: Column) -> Column:
        size = F.length(part["text"]).cast("bigint")
        span = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        spans = F.when(part["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    return chats.withColumn("flat", flat).select(
        F.col("conversation").alias(conversation),
        F.array_join("flat.text", "").alias("formatted"),
        F.aggregate("flat", start, add, lambda state: state["spans"]).alias("loss"),
        order_state(F.col("turns.role"), template).isin(list(template.final)).alias("valid"),
    )


def read_turns(formatted: Column, template: Template) -> Column:
    """The turns (role, text) of a formatted conversation, read back from its text alone.

    Control strings occur in it only as marks of turns, so a closing mark ends a turn wherever it stands.
    """
    closings = {*template.closing.values(), template.other[2]}
    ends = "|".join(quoted(mark) for mark in sorted(closings, key=len, reverse=True))
    pieces = F.filter(F.split(formatted, f"(?<={ends})", -1), lambda piece: piece != "")

    def turn(piece: Column) -> Column:
        first, middle, last = template.other
        inner = F.substring(piece, len(first) + 1, F.length(piece) - len(first) - len(last))
        name = F.substring_index(inner, middle, 1)
        rest = F.substring(inner, F.length(name) + len(middle) + 1, F.length(inner))
        read = F.struct(unescape(name, template).alias("role"), unescape(rest, template).alias("text"))
        for role, opening in template.opening.items():
            closing = template.closing[role]
            body = F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - (len(opening) + len(closing)))
            found = F.struct(F.lit(role).alias("role"), unescape(body, template).alias("text"))
            read = F.when(piece.startswith(opening), found).otherwise(read)
        return read

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column, template: Template) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(
        F.transform(loss, lambda span: unescape(F.substring(formatted, span["start"].cast("int") + 1, span["length"].cast("int")), template)),
        "",
    )


def digests(chats: DataFrame, template: Template | None = None, conversation: str = "conv_id") -> DataFrame:
    """Counts and digests of what the formatted conversations say, read back from them."""
    template = template or Template()
    text = F.col("formatted")
    read = chats.select(
        conversation, "formatted", "valid", read_turns(text, template).alias("turns"), read_loss(text, F.col("loss"), template).alias("learnt")
    )
    lines = F.array_join(F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))), "")
    return read.select(
        conversation,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )
