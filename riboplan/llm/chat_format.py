"""Chat formatting: a finite-state machine over roles and a declarative template, in Spark expressions only.

A conversation is its turns in the order of (turn, role, text); repeated turns stay. The template gives
each role a prefix, a suffix and a loss flag. The machine's transitions say which role may follow which;
a conversation that leaves them is still formatted and has ``valid`` false.

Escapes: inside texts and roles every ``%`` becomes ``%25``, and the first character of every control
string becomes ``%`` and two hex digits. After that no control string can begin inside a text, and the
steps undone in reverse order give the text back, whatever it held.

Defined results: a null text is empty, a null role is the empty role (no transition admits it), a null
turn sorts first, a null conv_id is a conversation of its own, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers of a turn, the roles under the loss mask, and the machine (state -> roles that may come next)."""

    start: str = "<|im_start|>"
    head_end: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    reserved: tuple[str, ...] = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [self.start, self.end.strip(), *self.reserved]

    def escapes(self) -> list[tuple[str, str]]:
        """(string, its escape), in the order of application."""
        return [("%", "%25")] + [(c, f"%{ord(c[0]):02X}{c[1:]}") for c in self.controls()]

    def unescapes(self) -> list[tuple[str, str]]:
        firsts = sorted({c[0] for c in self.controls()})
        return [(f"%{ord(c):02X}", c) for c in firsts] + [("%0A", "\n"), ("%25", "%")]


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def _segments(t: Template) -> Column:
    """Segments of one turn: (text as written, loss flag)."""
    head = lambda x: F.concat(F.lit(t.start), F.replace(_replaced(x["role"], t.escapes()), F.lit("\n"), F.lit("%0A")), F.lit(t.head_end))
    seg = lambda s, flag: F.struct(s.alias("text"), flag.alias("loss"))
    no = F.lit(False)
    return F.flatten(
        F.transform(
            "_turns",
            lambda x: F.array(
                seg(head(x), no), seg(_replaced(x["text"], t.escapes()), x["role"].isin(*t.loss_roles)), seg(F.lit(t.end), no)
            ),
        )
    )


def _valid(t: Template) -> Column:
    """Run the machine: the state is the last role, or null after a move that the machine lacks."""
    allowed = [f"{a}>{b}" for a, bs in t.moves.items() for b in bs]
    step = lambda state, x: F.when(F.concat(state, F.lit(">"), x["role"]).isin(allowed), x["role"])
    return F.aggregate("_turns", F.lit(""), step, lambda s: F.coalesce(s.isin(*t.accepting), F.lit(False)))


def format_chats(df: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid, from rows (conv_id, turn, role, text)."""
    t = template or Template()
    blank = F.lit("")
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    return (
        df.select("conv_id", turn.alias("_t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
        .select("conv_id", _segments(t).alias("segments"), _valid(t).alias("valid"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")
    )


def read_back(df: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, valid, turns array<struct<role, text>> parsed from ``formatted`` alone, and loss_text,
    the unescaped text of the segments under the loss mask."""
    t = template or Template()
    parts = F.filter(F.split("formatted", rf"\Q{t.start}\E", -1), lambda _, i: i > 0)
    undone = lambda c: _replaced(c, t.unescapes())
    cut = len(t.head_end)

    def turn(p: Column) -> Column:
        head = F.instr(p, t.head_end)
        text = F.substring(p, head + cut, F.length(p) - head - cut + 1 - len(t.end))
        return F.struct(undone(F.substring(p, F.lit(1), head - 1)).alias("role"), undone(text).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: undone(s["text"]))
    return df.select("conv_id", "formatted", "valid", F.transform(parts, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))
