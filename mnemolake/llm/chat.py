"""Chat formatting by a declarative template.

A finite-state machine over roles says whether the turns of a conversation are in order, and where not. Each turn
becomes three segments (opening mark, escaped text, closing mark) with a loss flag each. The marks can't occur inside
escaped texts, so the formatted text reads back to exactly the turns that it was made from.

Everything is DataFrame expressions; the only shuffle gathers the rows of a conversation, which is also the unit of the
result: a formatted conversation is one value.

Defined results: a null text is the empty text, a null role the empty role, which no state accepts; rows are ordered by
turn (null first), then role, then text; repeated rows are turns of their own; conversations with turns out of order
are formatted too and marked invalid; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How roles are marked, which texts carry loss, and which role may follow which."""

    open_turn: str = "<turn>"
    after_role: str = "\n"
    close_turn: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (control string, its escape). The first is the escape sign itself; no other escape is made of an earlier string.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<turn>", "\\o"), ("</turn>", "\\c"), ("###", "\\h"))
    start: str = "start"
    #: state -> role -> next state.
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "opened", "user": "asked"},
            "opened": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "called"},
            "called": {"assistant": "answered"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def escape(self, text: Column) -> Column:
        for plain, escaped in self.escapes:
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, escaped in reversed(self.escapes):
            text = F.replace(text, F.lit(escaped), F.lit(plain))
        return text

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit(self.after_role), F.lit("\\n"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("\\n"), F.lit(self.after_role)))


def _state_after(template: Template, state: Column, role: Column) -> Column:
    """The next state; "error" where none is declared, and from then on."""
    out = F.lit("error")
    for at, moves in template.transitions.items():
        for accepted, to in moves.items():
            out = F.when((state == at) & (role == accepted), F.lit(to)).otherwise(out)
    return out


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conv_id: segments (text, loss), formatted, valid, first_bad_turn (its place from 0, null if none)."""
    t = template or Template()
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns"))
    run = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad")),
        lambda acc, x: F.struct(
            _state_after(t, acc["state"], x["role"]).alias("state"),
            (acc["seen"] + 1).alias("seen"),
            F.coalesce(acc["bad"], F.when(_state_after(t, acc["state"], x["role"]) == "error", acc["seen"])).alias("bad"),
        ),
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.open_turn), t.escape_role(x["role"]), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(t.escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.close_turn).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = grouped.select("conv_id", run.alias("run"), segments.alias("segments"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("run.bad").isNull() & F.col("run.state").isin(*t.final)).alias("valid"),
        F.col("run.bad").alias("first_bad_turn"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array of struct(role, text) from a formatted conversation."""
    t = template or Template()
    pieces = F.split(formatted, "\\Q" + t.close_turn + "\\E")
    bodies = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substr(p, F.lit(len(t.open_turn) + 1)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            t.unescape_role(F.substring_index(b, t.after_role, 1)).alias("role"),
            t.unescape(F.substr(b, F.locate(t.after_role, b) + F.lit(len(t.after_role)))).alias("text"),
        ),
    )


def loss_text(turns: Column, segments: Column) -> Column:
    """What the loss mask covers of turns that were read back, nothing between; a turn is three segments, its text the middle one."""
    return F.array_join(F.transform(F.filter(turns, lambda _, i: F.get(segments, 3 * i + 1)["loss"]), lambda x: x["text"]), "")


def conversation_digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """What formatted conversations read back to: one row for each conv_id."""
    rows = format_conversations(conversations, template)
    rows = rows.select("conv_id", "valid", "first_bad_turn", F.char_length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted"), template).alias("turns"), "segments")
    rows = rows.withColumn("loss", loss_text(F.col("turns"), F.col("segments")))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "first_bad_turn",
    )
