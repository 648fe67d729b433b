"""Chat formatting from a declarative template, in DataFrame functions alone.

A conversation's turns, in order, run through a finite-state machine over roles; each turn
becomes three text segments (opening, text, closing), and a flag on each segment says whether
the loss counts it. Inside texts and roles the characters that the template's markers begin with are
escaped, each by a backslash and a letter (for the template here ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and, in roles,
``>`` becomes ``\\g``). So no marker begins inside a text, and the texts can be read back. A template whose
fixed parts could be taken for, or run into, its closing is refused.

One conversation is one output row, so its turns meet in one task; conversations are
spread over tasks by hash.

Defined cases: null text and null role are empty; turns of one number are ordered by role
and text, and equal rows are kept; a null conversation id is a conversation of its own; an
unknown role or a turn out of order makes ``valid`` false but is formatted; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    opening: str = "<turn {role}>"
    closing: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    def __post_init__(self):
        if self.opening.count("{role}") != 1 or not self.closing or not self.parts[1]:
            raise ValueError("a template needs one {role}, some text after it, and a closing")
        before, after = self.parts
        if (before + after + self.closing).find(self.closing) < len(before + after) or self.closing in before or self.closing in after:
            raise ValueError(f"{self.opening!r} may be read as the closing {self.closing!r}")

    @property
    def parts(self) -> tuple[str, str]:
        before, after = self.opening.split("{role}")
        return before, after

    def codes(self, role: bool) -> list[tuple[str, str]]:
        """(character, what stands for it), in the order of replacing."""
        before, after = self.parts

        def goes_on(fixed: str) -> list[str]:
            """What would make the closing's beginning at the end of ``fixed`` go on."""
            return [self.closing[n] for n in range(1, len(self.closing)) if fixed.endswith(self.closing[:n])]

        of_text = ["\\", self.closing[0], *before[:1], *goes_on(before + after)]
        of_role = ["\\", self.closing[0], *before[:1], after[0], *goes_on(before)]
        first = list(dict.fromkeys([*of_text[:2], after[0], *of_text, *of_role]))
        letters = [c for c in "blgmnopqrstuvwxyzBLGMNOPQ" if c not in first]
        found = dict(zip(first, ("\\" + c for c in letters)))
        return [(c, to) for c, to in found.items() if c in (of_role if role else of_text)]


CHAT = Template()


def escape(text: Column, role: bool = False, template: Template = CHAT) -> Column:
    for char, code in template.codes(role):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, role: bool = False, template: Template = CHAT) -> Column:
    for char, code in reversed(template.codes(role)):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def state_after(turns: Column, template: Template) -> Column:
    """The machine's state after all turns; ``invalid`` from the first wrong role on."""
    moves = F.create_map(*[F.lit(x) for s, to in template.turns.items() for role, t in to.items() for x in (f"{s}\n{role}", t)])
    return F.aggregate(turns, F.lit(template.start), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), t["role"])), F.lit("invalid")))


def format_conversations(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, segments (text, loss), formatted, valid."""
    before, after = template.parts
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def three(t: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(before), escape(t["role"], True, template), F.lit(after)), F.lit(False)),
            segment(escape(t["text"], False, template), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.closing), F.lit(False)),
        )

    made = turns.select("conv_id", F.flatten(F.transform("turns", three)).alias("segments"), state_after(F.col("turns"), template).isin(*template.accepting).alias("valid"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    before, after = template.parts
    literally = "".join(f"\\x{{{ord(c):X}}}" for c in template.closing)
    parts = F.split(formatted, literally, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    head = len(before) + 1

    def turn(part: Column) -> Column:
        end = F.locate(after, part, head)
        role = F.substring(part, F.lit(head), end - head)
        return F.struct(unescape(role, True, template).alias("role"), unescape(F.substring(part, end + len(after), F.length(part)), False, template).alias("text"))

    return F.transform(parts, turn)


def digest(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What is read back from format_conversations(): counts and SHA-256 of turns and loss text."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], False, template)), "")
    got = formatted.select("conv_id", "valid", "formatted", read_back(F.col("formatted"), template).alias("turns"), loss.alias("loss_text"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
