r"""Chat formatting by a finite-state machine, in DataFrame functions only.

A declarative template says how a turn opens and closes and which roles are learned from. Texts
may hold anything: the escape character and the first character of every control string are
escaped, so control strings never occur in an escaped text and the output reads back exactly.
A machine over roles goes through the turns of a conversation: at each turn it moves to a next state
and says whether the turn's text is learned from. Its states tell whether the turn order is valid
and at which turn it left the path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """Control strings and roles. opens + role + mid, the escaped text, closes: one turn."""

    opens: str = "<turn "
    mid: str = ">"
    closes: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role, next state); a conversation is valid if it ends in an accepting state.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"), ("start", "user", "asked"), ("told", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    accepting: tuple[str, ...] = field(default=("answered",))

    def escape(self, text: Column) -> Column:
        # the escape character first, then what opens a control string; \b and \l hold neither
        return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))

    def unescape(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))

    def escape_role(self, role: Column) -> Column:
        # a role also must not hold the string that ends it
        return F.replace(self.escape(role), F.lit(">"), F.lit("\\g"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def format_conversations(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, valid, off_at, formatted, segments.

    Rows are ordered by turn (null first), ties by role and text; repeated rows are turns of their
    own. Null text and null role count as empty. Segments are (text, loss) in order and their texts
    join to `formatted`; loss is what the machine says at each turn, true for the escaped texts of
    learned roles alone, on the path or off it. Every conversation is formatted; `valid` says whether
    the machine ends in an accepting state, off_at is the place, from 0, of the first turn that has
    no move (-1 if there is none). Rows with a null conv_id make one conversation. One conversation
    is one training text, so its turns are gathered in one row; texts of any length are whole. An
    empty table gives an empty result, and other columns are not read.
    """
    t = template
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("row"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    move = lambda state, r: F.coalesce(*[F.when((state == a) & (r == b), c) for a, b, c in t.moves], F.lit("off"))
    turn = lambda s, x: F.struct(move(s["state"], x["role"]).alias("state"), x["role"].isin(*t.loss_roles).alias("learn"))
    start = F.struct(F.lit("start").alias("state"), F.lit(False).alias("learn"))
    convs = convs.withColumn("path", common.scan(F.col("rows"), start, turn, "struct<state:string,learn:boolean>"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    one = lambda x, m: F.array(
        seg(F.concat(F.lit(t.opens), t.escape_role(x["role"]), F.lit(t.mid)), F.lit(False)),
        seg(t.escape(x["text"]), m["learn"]),
        seg(F.lit(t.closes), F.lit(False)),
    )
    out = convs.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"),
        F.element_at("path.state", -1).isin(*t.accepting).alias("valid"),
        (F.array_position("path.state", "off") - 1).alias("off_at"),
        F.flatten(F.zip_with("rows", "path", one)).alias("segments"),
    )
    return out.select("conv_id", "n_turns", "valid", "off_at", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: DataFrame, template: Template = Template(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The turns of `formatted` read back from the text alone: conv_id, turns (role, text) in order, and the columns to keep."""
    t = template
    # nothing in an escaped text can be taken for a control string, so splitting is exact
    parts = F.filter(F.split("formatted", _quoted(t.closes), -1), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(t.opens) + 1))
    turn = lambda x: F.struct(
        t.unescape_role(F.substring_index(body(x), t.mid, 1)).alias("role"),
        t.unescape(F.substr(body(x), F.instr(body(x), F.lit(t.mid)) + len(t.mid))).alias("text"),
    )
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), *keep)


def loss_text(segments: str | Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    on = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(on, lambda s: Template().unescape(s["text"])), "")


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
