"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names the strings around each turn and which roles count in the
loss. The machine's transitions validate the order of turns. Control strings
inside roles and texts are escaped so that they can't be mistaken for markup,
and can be read back exactly.

Turns are read in order of turn (nulls last), then role, then text; null text
and null role are empty. Conversations whose order is invalid are formatted
as well and say at which turn they broke. Rows with a null conv_id form one
conversation; rows that repeat are turns of their own. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

START = "start"
BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """Text around each turn: before + role + between + text + after."""

    before: str = "### "
    between: str = ": "
    after: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (control string, its stand-in), the escape character itself first. No stand-in is part of another,
    #: and none holds a control string.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    #: (state, role, next state); others lead to BROKEN.
    transitions: tuple[tuple[str, str, str], ...] = (
        (START, "system", "system"), (START, "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user"),
    )
    accepting: tuple[str, ...] = field(default=("assistant",))

    def escape(self, text: Column) -> Column:
        for plain, stand_in in self.escapes:
            text = F.replace(text, F.lit(plain), F.lit(stand_in))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, stand_in in reversed(self.escapes):
            text = F.replace(text, F.lit(stand_in), F.lit(plain))
        return text

    def escape_role(self, role: Column) -> Column:
        role = self.escape(role)
        for plain, stand_in in self.role_escapes:
            role = F.replace(role, F.lit(plain), F.lit(stand_in))
        return role

    def unescape_role(self, role: Column) -> Column:
        for plain, stand_in in reversed(self.role_escapes):
            role = F.replace(role, F.lit(stand_in), F.lit(plain))
        return self.unescape(role)


def _machine(roles: Column, template: Template) -> Column:
    """struct(state, broken_at): the state after all roles, and the first turn (from 0) without a transition."""
    moves = F.create_map(*[F.lit(x) for state, role, to in template.transitions for x in (f"{state}\n{role}", to)])

    def step(a: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(a["state"], F.lit("\n"), role)), F.lit(BROKEN))
        to = F.when(a["state"] == BROKEN, F.lit(BROKEN)).otherwise(to)
        at = F.when((to == BROKEN) & a["broken_at"].isNull(), a["turn"]).otherwise(a["broken_at"])
        return F.struct(to.alias("state"), at.alias("broken_at"), (a["turn"] + 1).alias("turn"))

    first = F.struct(F.lit(START).alias("state"), F.lit(None).cast("int").alias("broken_at"), F.lit(0).alias("turn"))
    return F.aggregate(roles, first, step)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, broken_at, formatted, segments.

    segments: array of (text, loss), which joined are `formatted`. One shuffle by
    conv_id, of the rows themselves; all else is a projection.
    """
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        head = F.concat(F.lit(template.before), template.escape_role(t["role"]), F.lit(template.between))
        return F.array(segment(head, F.lit(False)), segment(template.escape(t["text"]), t["role"].isin(*template.loss_roles)), segment(F.lit(template.after), F.lit(False)))

    cut = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _machine(F.transform("turns", lambda t: t["role"]), template).alias("end"), F.flatten(F.transform("turns", of_turn)).alias("segments"))
    valid = F.col("end.broken_at").isNull() & F.col("end.state").isin(*template.accepting)
    return cut.select("conv_id", "n_turns", valid.alias("valid"), F.col("end.broken_at").alias("broken_at"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array of (role, text), read back from a formatted conversation alone."""
    # no escaped text holds the closing string, so a literal split is exact
    parts = F.filter(F.split(formatted, "\\Q" + template.after + "\\E"), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, template.between)
        first = len(template.before) + 1
        role = F.substring(p, F.lit(first), at - first)
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(F.substring(p, at + len(template.between), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """The unescaped text under the loss mask: the segments that are flagged, joined."""
    return template.unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    said = r"'\\### Assistant: </turn> ok'"
    probe = spark.sql(f"SELECT -7L AS conv_id, turn, role, {said} AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = format_conversations(rows)
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') AS e_text,
    replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS e_role
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(e_role) + 2 + length(e_text) + 8)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
