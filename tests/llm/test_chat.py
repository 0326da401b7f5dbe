import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratiform.llm.chat import PARTS, escape, format_turn, format_turns, parse_turn, read_back, unescape

BITS = st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[/ROLE] ", "[IMG]", " ", "é", "x\n"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(BITS, st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE] x"]), BITS))
def test_reversible(text, role):
    assert unescape(escape(text)) == text
    segment, a, b, _ = format_turn(role, [{"type": "text", "text": text}])
    assert parse_turn(segment) == (role, text)
    if role == "assistant":
        assert unescape(segment[a:b]) == text
    body = escape(text)
    assert not any(c in body for c in ("</s>", "[INST]", "[/INST]", "[/ROLE]", "[IMG]"))


def test_parts():
    parts = [{"type": "text", "text": "see [I"}, {"type": "text", "text": "MG] "}, {"type": "image", "uri": "u1", "width": 57, "height": 28}, {"type": "audio", "uri": "u2", "seconds": 1.5}, {"type": "text", "text": None}, {"type": "document", "uri": "u3", "pages": 2}]
    segment, _, _, found = format_turn("user", parts)
    assert segment == "[INST] see [\\IMG] [IMG][AUD][DOC] [/INST]"
    assert [(x["uri"], x["tokens"], segment[x["at"] : x["at"] + 5]) for x in found] == [("u1", 3, "[IMG]"), ("u2", 38, "[AUD]"), ("u3", 512, "[DOC]")]
    with pytest.raises(ValueError):
        format_turn("user", [{"type": "video"}])
    with pytest.raises(ValueError):
        parse_turn("no template")


def test_read_back(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "[INST] x"), (2, 0, "tool", ""), (None, None, "user", "z"), (3, 0, "assistant", "é" * 50_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in read_back(format_turns(df)).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert read_back(format_turns(df.limit(0))).count() == 0
    typed = spark.createDataFrame([(1, 0, "user", [("text", "hi", None, None, None, None, None), ("image", None, "u", 28, 28, None, None)]), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content {PARTS}")
    seg = format_turns(typed).orderBy("turn").collect()
    assert seg[0].segment == "[INST] hi[IMG] [/INST]" and seg[0].expanded_tokens == 1 and seg[1].segment == "[ANS] </s>"
