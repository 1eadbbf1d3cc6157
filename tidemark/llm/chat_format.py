"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says which role may follow which, and what a turn looks like: a row of
parts, each a fixed string or a field of the turn, with the roles whose part is under
the loss.  The machine's states are the start and the role read last; a turn without
a transition makes the conversation invalid from there on.  Formatting a
conversation gives segments: text and whether it is under the loss.  Joined, they are
the formatted text; nothing else has to be kept to read the turns back.

Control strings begin with ``<|``.  In a text, ``<``, any number of backslashes and
``|`` get one backslash more, so an escaped text holds no ``<|`` and loses that
backslash again when it is read.  Roles are percent-encoded for ``%``, ``|`` and the
line feed, as a role ends at its line.

Everything is a column expression; a conversation is one row, as it is one sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state before the first turn, and the sink that an invalid turn leads to.
START, END = "<start>", "<end>"


@dataclass(frozen=True)
class Part:
    """A fixed string, or the ``field`` (role or text) of a turn; under the loss for some roles."""

    fixed: str = ""
    field: str = ""
    loss: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """Parts of a turn, and the roles that may follow each state (``END``: may be last)."""

    opening: str
    closing: str
    parts: tuple[Part, ...]
    follows: dict[str, tuple[str, ...]] = field(hash=False)

    def __post_init__(self) -> None:
        fixed = [p.fixed for p in self.parts if p.fixed]
        fields = [p.field for p in self.parts if p.field]
        if (
            fields != ["role", "text"] or fixed != [self.opening, "\n", self.closing]
            or not (self.opening.startswith("<|") and self.closing.startswith("<|"))
        ):
            raise ValueError("a turn is: opening, role, line feed, text, closing; both start with <|")


#: The widespread markup of turns; only what an assistant says is learned.
MARKED = Template(
    opening="<|im_start|>",
    closing="<|im_end|>\n",
    parts=(
        Part(fixed="<|im_start|>"), Part(field="role"), Part(fixed="\n"),
        Part(field="text", loss=("assistant",)), Part(fixed="<|im_end|>\n"),
    ),
    follows={
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant", END),
        "assistant": ("user", "tool", END),
        "tool": ("tool", "assistant", END),
    },
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("|", "%7C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("\n", "%0A"), ("|", "%7C"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def _allowed(template: Template, state: Column, role: Column) -> Column:
    """Whether the machine has a transition from ``state`` by ``role``."""
    pairs = [f"{a}\n{b}" for a, after in template.follows.items() for b in after]
    return F.concat(state, F.lit("\n"), role).isin(pairs)


def _segments(template: Template, turn: Column) -> Column:
    """The segments of one turn; neighbouring parts that are never under the loss are one."""
    made: list[tuple[list[Column], tuple[str, ...]]] = []
    for part in template.parts:
        if part.field:
            text = (escape_role if part.field == "role" else escape)(turn[part.field])
        else:
            text = F.lit(part.fixed)
        if made and made[-1][1] == part.loss:
            made[-1][0].append(text)
        else:
            made.append(([text], part.loss))
    return F.array(
        *(
            F.struct(
                F.concat(*texts).alias("text"),
                (turn["role"].isin(list(loss)) if loss else F.lit(False)).alias("loss"),
            )
            for texts, loss in made
        )
    )


def format_chats(
    turns: DataFrame, template: Template = MARKED, key: str = "conv_id", order: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """(key, valid, bad_turn, segments): one formatted conversation for each key.

    Turns stand in ascending ``order``, null first; turns of one place by role, then
    text, and repeated rows are repeated turns.  A null role or text is empty.  Rows
    with a null key are one conversation of that key.  ``valid`` says that the machine
    accepts the roles; ``bad_turn`` is the place (from 0) of the first turn it has no
    transition for, the number of turns if only the end is wrong, else null.  Invalid
    conversations are formatted all the same.  Other columns are left out, and an empty
    table gives no rows.
    """
    column = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    turn = F.struct(F.col(f"`{order}`").alias("at"), column(role).alias("role"), column(text).alias("text"))
    gathered = turns.groupBy(F.col(f"`{key}`").alias(key)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    wrong = F.filter(
        F.transform(
            F.concat("turns.role", F.array(F.lit(END))),
            lambda r, i: F.when(
                ~_allowed(template, F.when(i == 0, F.lit(START)).otherwise(F.get("turns.role", i - 1)), r), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return gathered.select(
        key,
        F.get(wrong, F.lit(0)).isNull().alias("valid"),
        F.get(wrong, F.lit(0)).cast("long").alias("bad_turn"),
        F.flatten(F.transform("turns", lambda t: _segments(template, t))).alias("segments"),
    )


def formatted_text(segments: str = "segments") -> Column:
    """The text that the segments make."""
    return F.array_join(F.col(segments)["text"], "")


def loss_text(segments: str = "segments") -> Column:
    """What stands under the loss mask, unescaped, in order, nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")


def read_turns(formatted: Column, template: Template = MARKED) -> Column:
    """The turns, (role, text) in order, that a formatted text was made from."""
    pieces = F.split(formatted, f"\\Q{template.opening}\\E", -1)
    bodies = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(body: Column) -> Column:
        line = F.instr(body, "\n")
        rest = F.length(body) - line - len(template.closing)
        return F.struct(
            unescape_role(F.substring(body, F.lit(1), line - 1)).alias("role"),
            unescape(F.substring(body, line + 1, rest)).alias("text"),
        )

    return F.transform(bodies, turn)
