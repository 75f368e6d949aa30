"""Chat formatting: a finite-state machine over roles and a declarative template.

``Machine`` says which role may follow which. ``Template`` says, for each role,
which segments a turn emits and which of them carry loss. ``segments`` reads
every conversation in the order of its turns, moves the machine, and emits one
row for each segment of text. A turn that the machine refuses is formatted all
the same and flagged; the machine goes on from where the turn's role leads.

Control strings of the template inside a text or role get a backslash after
their first character, one more if they have some there already, so ``[INST]``
becomes ``[\\INST]`` and ``[\\INST]`` becomes ``[\\\\INST]``. That takes no
other character and is undone exactly. ``Template`` refuses control strings for
which it would not be (one inside another, one that can begin in another's end,
one that can arise where a literal meets a text).

``read_back`` takes nothing but the emitted segments: it joins their text, finds
the turns by the template's markers, and takes the loss from the flags.

Conversations are dealt by id in one shuffle and sorted there; a task then
streams them and holds one turn at a time, never a conversation. A conversation's
digest is a chain over its turns, so one conversation is read by one task however
long it is.

Defined results: a null text or role is empty; a role that the template does not
know is written in the general form and refused by the machine; turns come in
the order of ``turn`` (null first), ties by role, then text, repeated rows stay;
rows with a null id are one conversation; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class Part(Enum):
    """What a template writes in place of these."""

    TEXT = "text"
    ROLE = "role"


TEXT, ROLE = Part.TEXT, Part.ROLE


@dataclass(frozen=True)
class Machine:
    """States and moves: ``moves[state][role]`` is the next state."""

    start: str
    accepting: frozenset[str]
    moves: dict[str, dict[str, str]]

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state and whether the turn was refused."""
        if (to := self.moves.get(state, {}).get(role)) is not None:
            return to, False
        return next((m[role] for m in self.moves.values() if role in m), self.start), True


@dataclass(frozen=True)
class Template:
    """``begin`` opens a conversation; ``turns`` has each role's segments (a literal, TEXT or ROLE, and its loss flag).

    ``other`` is the form of roles that ``turns`` lacks and must hold ROLE.
    """

    controls: tuple[str, ...]
    begin: str
    turns: dict[str, tuple[tuple[object, bool], ...]]
    other: tuple[tuple[object, bool], ...]
    forms: dict = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"control string {c!r}: two characters at least, no backslash")
            for d in self.controls:
                if c != d and c in d or any(d.startswith(c[k:]) for k in range(1, len(c))):
                    raise ValueError(f"control strings {c!r} and {d!r} overlap")
        everything = {**{("role", r): s for r, s in self.turns.items()}, ("other", ""): self.other}
        for parts in everything.values():
            texts = [p for p, _ in parts]
            if texts.count(TEXT) != 1 or not isinstance(texts[-1], str) or not any(c in texts[-1] for c in self.controls):
                raise ValueError("a turn holds TEXT once and ends with a control string")
            for a, b in zip(texts, texts[1:]):
                if not isinstance(a, str) and not isinstance(b, str):
                    raise ValueError("a literal must stand between ROLE and TEXT")
                for c in self.controls:
                    cuts = [(c[:k], c[k:]) for k in range(1, len(c))]
                    if isinstance(a, str) != isinstance(b, str) and any(
                        (isinstance(b, str) and (b.startswith(right) or right.startswith(b))) or (isinstance(a, str) and (a.endswith(left) or left.endswith(a))) for left, right in cuts
                    ):
                        raise ValueError(f"{c!r} can arise where a text meets a literal")
        if not any(p is ROLE for p, _ in self.other):
            raise ValueError("the general form must write the role")

    def escape(self, text: str) -> str:
        """The text with a backslash put into each control string."""
        return re.sub("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in self.controls), lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        """Undoes ``escape``."""
        return re.sub("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in self.controls), lambda m: m[0][0] + m[0][2:], text)

    def emit(self, role: str, text: str) -> Iterator[tuple[str, bool]]:
        """A turn's segments with their loss flags."""
        for part, loss in self.turns.get(role, self.other):
            yield (part if isinstance(part, str) else self.escape(text if part is TEXT else role)), loss

    def closers(self) -> tuple[str, ...]:
        """What a turn can end with; no text can."""
        return tuple(sorted({parts[-1][0] for parts in (*self.turns.values(), self.other)}))

    def reader(self):
        """A function from a turn's formatted text to its (role, text)."""
        groups = {TEXT: "(?P<text>.*?)", ROLE: "(?P<role>.*?)"}
        form = lambda parts: re.compile("".join(re.escape(p) if isinstance(p, str) else groups[p] for p, _ in parts), re.S)
        known = [(role, form(parts)) for role, parts in self.turns.items()]
        other = form(self.other)

        def read(turn: str) -> tuple[str, str]:
            for role, pattern in known:
                if m := pattern.fullmatch(turn):
                    return role, self.unescape(m["text"])
            m = other.fullmatch(turn)
            if m is None:
                raise ValueError(f"not a turn of this template: {turn[:80]!r}")
            return self.unescape(m["role"]), self.unescape(m["text"])

        return read


#: Turns alternate; a system turn may come first; a conversation ends with the assistant.
ALTERNATING = Machine("start", frozenset({"answered"}), {
    "start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"},
})
#: The control strings of two public chat formats.
INST = Template(
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"),
    begin="<s>",
    turns={
        "system": (("<<SYS>>\n", False), (TEXT, False), ("\n<</SYS>>\n", False)),
        "user": (("[INST] ", False), (TEXT, False), (" [/INST]", False)),
        "assistant": ((" ", False), (TEXT, True), (" </s>", False)),
    },
    other=(("<<ROLE>>", False), (ROLE, False), ("<</ROLE>> ", False), (TEXT, False), (" </s>", False)),
)
CHATML = Template(
    controls=("<|im_start|>", "<|im_end|>", "<|im_sep|>"),
    begin="",
    turns={role: ((f"<|im_start|>{role}<|im_sep|>\n", False), (TEXT, role == "assistant"), ("\n<|im_end|>\n", False)) for role in ("system", "user", "assistant")},
    other=(("<|im_start|>", False), (ROLE, False), ("<|im_sep|>\n", False), (TEXT, False), ("\n<|im_end|>\n", False)),
)

#: Rows and characters of a batch that a task hands on.
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20
SEGMENTS = "conv_id long, segment long, turn long, role string, text string, loss boolean, state string, refused boolean"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_refused long, is_valid boolean"
)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], schema: pa.Schema, text: int | None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``text`` is the column whose characters count."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text]) if text is not None else 0
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _formatted(rows: Iterable[tuple], template: Template, machine: Machine) -> Iterator[tuple]:
    """Segments of turns (conv_id, turn, role, text) that come conversation by conversation, in order."""
    current, first, state, turn, segment = None, True, machine.start, 0, 0
    for conv, _, role, text in rows:
        if first or conv != current:
            current, first, state, turn, segment = conv, False, machine.start, 0, 0
            if template.begin:
                yield conv, 0, None, None, template.begin, False, state, False
                segment = 1
        state, refused = machine.step(state, role)
        for part, loss in template.emit(role, text):
            yield conv, segment, turn, role, part, loss, state, refused
            segment += 1
        turn += 1


def segments(conversations: DataFrame, template: Template = INST, machine: Machine = ALTERNATING) -> DataFrame:
    """Every conversation's segments in order: ``conv_id, segment, turn, role, text, loss, state, refused``.

    ``segment`` and ``turn`` count from 0 in each conversation; what opens a
    conversation belongs to no turn. Rows of a partition are in order.
    """
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda batches: _batches(_formatted(_rows(batches), template, machine), _arrow(SEGMENTS), 4), SEGMENTS)


def _digested(rows: Iterable[tuple], template: Template, machine: Machine) -> Iterator[tuple]:
    """Digests of segments (conv_id, text, loss, state, refused, turn) that come in order."""
    read, closers, current, first = template.reader(), template.closers(), None, True

    def ended():
        if pending:
            raise ValueError(f"conversation {current} ends inside a turn")
        return current, n_turns, turns.hexdigest(), loss_chars, learned.hexdigest(), chars, n_refused, not n_refused and state in machine.accepting

    for conv, text, loss, to, refused in rows:
        if first or conv != current:
            if not first:
                yield ended()
            current, first, n_turns, loss_chars, chars, n_refused, state, pending = conv, False, 0, 0, 0, 0, machine.start, []
            turns, learned, opening = hashlib.sha256(), hashlib.sha256(), template.begin
        chars += len(text)
        if opening:
            if text != opening:
                raise ValueError(f"conversation {current} does not begin with {opening!r}")
            opening = ""
            continue
        pending.append(text)
        state = to
        if loss:
            plain = template.unescape(text)
            loss_chars += len(plain)
            learned.update(plain.encode("utf-8"))
        if text.endswith(closers):
            role, plain = read("".join(pending))
            turns.update(f"{role}\n{plain}\n".encode("utf-8"))
            n_turns, n_refused, pending = n_turns + 1, n_refused + bool(refused), []
    if not first:
        yield ended()


def read_back(formatted: DataFrame, template: Template = INST, machine: Machine = ALTERNATING, in_order: bool = False) -> DataFrame:
    """What the segments say, one row a conversation.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_refused, is_valid``. Raises where the text is not what the template writes.
    ``in_order``: the rows come straight from ``segments`` and need no shuffle.
    """
    rows = formatted.select("conv_id", "segment", "text", "loss", "state", "refused")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    rows = rows.drop("segment")
    return rows.mapInArrow(lambda batches: _batches(_digested(_rows(batches), template, machine), _arrow(DIGESTS), None), DIGESTS)


#: The texts of conversation -1.
PLANTED = "</s>[INST] ok [/INST]"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1 in the INST template, read back from the segments."""
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(segments(rows), in_order=True)


def _sql() -> str:
    """The same from the table: digests of the texts as they are, lengths of the escaped ones."""
    angle, square = "(<)(\\\\*)(/?s>|</?SYS>>|</?ROLE>>)", "(\\[)(\\\\*)(/?INST\\])"
    escaped = lambda x: f"regexp_replace(regexp_replace({x}, '{angle}', '\\1\\\\\\2\\3', 'g'), '{square}', '\\1\\\\\\2\\3', 'g')"
    around = "CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 1 + 5 ELSE 8 + 10 + 5 + length(" + escaped("role") + ") END"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
r AS (SELECT *, CASE lag(role) OVER w WHEN 'system' THEN 'briefed' WHEN 'user' THEN 'asked' WHEN 'assistant' THEN 'answered' ELSE 'start' END AS state,
             lead(role) OVER w IS NULL AS is_last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, NOT CASE role WHEN 'system' THEN state = 'start' WHEN 'user' THEN state <> 'asked' WHEN 'assistant' THEN state = 'asked' ELSE FALSE END AS refused FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length({escaped('text')}) + {around}))::BIGINT AS formatted_chars,
       sum(refused::INT)::BIGINT AS n_refused, NOT bool_or(refused) AND bool_or(is_last AND role = 'assistant') AS is_valid
FROM m GROUP BY conv_id"""


QUERIES = {"op11_chat_formatting": op11_chat_formatting}
SQL = {"op11_chat_formatting": _sql()}
