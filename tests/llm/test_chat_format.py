"""Chat formatting: exact round trips, the machine, templates that must be refused, awkward tables."""

import hashlib
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.llm import chat_format as chat

PIECES = [*chat.INST.controls, *chat.CHATML.controls, "\\", "\\\\", "<", "[", "<\\", "[\\", "[\\INST]", "<\\\\<SYS>>", "INST]", "/s>", " ", "\n", "a", "é", "漢", "😀", "|"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@pytest.mark.parametrize("template", [chat.INST, chat.CHATML])
@settings(max_examples=300, deadline=None)
@given(turns=st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", ""]), TEXTS), TEXTS), max_size=6))
def test_every_conversation_is_read_back(template, turns):
    segments = list(chat._formatted([(7, k, r, t) for k, (r, t) in enumerate(turns)], template, chat.ALTERNATING))
    got = list(chat._digested([(s[0], *s[4:]) for s in segments], template, chat.ALTERNATING))
    if not turns:
        assert got == []
        return
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    assert got[0][:6] == (7, len(turns), whole, len(learned), hashlib.sha256(learned.encode()).hexdigest(), sum(len(s[4]) for s in segments))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_an_escaped_text_holds_no_control_string(text):
    for template in (chat.INST, chat.CHATML):
        escaped = template.escape(text)
        assert not any(c in escaped for c in template.controls) and template.unescape(escaped) == text
        assert len(escaped) == len(text) + sum(len(re.findall(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}", text)) for c in template.controls)


def test_the_machine_takes_what_a_plain_rule_takes():
    roles = ("system", "user", "assistant", "tool")
    for n in range(1, 5):
        for turns in itertools.product(roles, repeat=n):
            rest = turns[1:] if turns[0] == "system" else turns
            want = len(rest) % 2 == 0 and len(rest) > 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(rest))
            rows = chat._formatted([(1, k, r, "x") for k, r in enumerate(turns)], chat.INST, chat.ALTERNATING)
            assert next(iter(chat._digested([(s[0], *s[4:]) for s in rows], chat.INST, chat.ALTERNATING)))[-1] == want, turns


def test_a_refused_turn_is_counted_once_and_the_machine_goes_on(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "tool", "d"), (1, 4, "user", "e"), (1, 5, "assistant", "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.read_back(chat.segments(df)).first()
    assert (got.n_turns, got.n_refused, got.is_valid, got.loss_chars) == (6, 2, False, 2)


def test_segments_carry_the_templates_flags(spark):
    df = spark.createDataFrame([(3, 1, "assistant", "x</s>"), (3, 0, "user", "hi")], "conv_id long, turn int, role string, text string")
    got = [(r.segment, r.turn, r.role, r.text, r.loss) for r in chat.segments(df).collect()]
    assert got == [
        (0, None, None, "<s>", False), (1, 0, "user", "[INST] ", False), (2, 0, "user", "hi", False), (3, 0, "user", " [/INST]", False),
        (4, 1, "assistant", " ", False), (5, 1, "assistant", "x<\\/s>", True), (6, 1, "assistant", " </s>", False),
    ]


def test_awkward_conversations(spark):
    long = "word </s> " * 200_000
    rows = [
        (1, None, "system", None), (1, 0, None, "no role"), (1, 0, "user", "tie b"), (1, 0, "user", "tie a"), (1, 0, "user", "tie a"), (None, 0, "user", "of nobody"), (None, 1, "assistant", ""),
        (2, 5, "assistant", long), (9007199254740993, 0, "user", None), (3, 0, "", ""), (4, 0, "[INST]", "\\"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for name in ("segment", "loss", "state", "n_turns", "TEXT_", "is_valid"):
        df = df.withColumn(name, F.lit("clash"))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for template in (chat.INST, chat.CHATML):
        got = {r.conv_id: r for r in chat.read_back(chat.segments(df, template), template).collect()}
        assert set(got) == {r[0] for r in rows}
        for conv, r in got.items():
            own = sorted((x for x in rows if x[0] == conv), key=order)
            learned = "".join(x[3] or "" for x in own if x[2] == "assistant")
            assert r.n_turns == len(own) and r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
            assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert got[None].is_valid and not got[2].is_valid
    assert chat.segments(df.where("conv_id < 0")).count() == 0 and chat.read_back(chat.segments(df.where("conv_id < 0"))).count() == 0


def test_a_damaged_text_is_refused(spark):
    df = chat.segments(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn int, role string, text string"))
    for damaged in (df.where("segment <> 3"), df.where("segment <> 0"), df.where("segment < 6")):
        with pytest.raises(Exception, match="turn|begin"):
            chat.read_back(damaged).collect()


@pytest.mark.parametrize("controls, close", [(("<a>", "x<a>y"), "<a>"), (("aXa", "<e>"), "<e>"), (("ab", "bc"), "ab"), (("<a>", "a\\b"), "<a>"), (("<", "<e>"), "<e>"), (("xy<", "<f>"), "<f>")])
def test_templates_that_cannot_be_undone_are_refused(controls, close):
    with pytest.raises(ValueError):
        chat.Template(controls, "", {"user": ((chat.TEXT, False), (close, False))}, ((chat.ROLE, False), ("|", False), (chat.TEXT, False), (close, False)))
