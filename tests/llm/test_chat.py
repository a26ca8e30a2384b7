import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyframe.llm import chat

TRICKY = st.lists(st.sampled_from(["\\", "<", ">", "s", "/", "[", "]", "I", "N", "S", "T", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "é", "\n", "😀"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]"]), TRICKY), max_size=6), st.integers(1, 9))
def test_round_trip(turns, step):
    template = chat.INSTRUCT
    segments = [s for role, text in turns for s in template.segments(role, text)]
    said = "".join(s for s, _ in segments)
    assert list(chat.Reader(template).feed(said)) == turns
    reader, found = chat.Reader(template), []
    for at in range(0, len(said), step):  # pieces may end within a mark or an escape
        found += reader.feed(said[at : at + step])
    assert found == turns or reader.rest
    assert [template.unescape(s) for s, loss in segments if loss] == [t for r, t in turns if r == "assistant"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark):
    bad = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", bad), (-1, 1, "assistant", bad), (2, 1, "assistant", "second"), (2, 0, "user", "first"), (3, 0, None, None), (3, 1, "tool", "x"), (3, 1, "tool", "x"), (4, None, "system", ""), (4, 0, "user", "q" * 100000), (4, 1, "assistant", ""), (None, 0, "user", "lone"), (5, 0, "user", "a"), (5, 0, "assistant", "b")]
    frame = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss boolean").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_digests(chat.format_turns(frame)).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, own in groups.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{role}\n{text}\n" for _, role, text in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] == sum(len(s) for _, role, text in own for s, _ in chat.INSTRUCT.segments(role, text))
    assert {c: r["valid"] for c, r in got.items()} == {-1: True, 2: True, 3: False, 4: True, None: False, 5: False}
    assert got[3]["fault"] == "turn 0: unknown role ''" and got[None]["fault"] == "ends after 'user'"
    assert chat.read_digests(chat.format_turns(frame.limit(0))).count() == 0


def test_segments_carry_loss_on_assistant_text_only(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<s>")], "conv_id long, turn long, role string, text string")
    rows = chat.format_turns(frame).orderBy("segment").collect()
    assert [(r["text"], r["loss"]) for r in rows] == [("[INST]", False), ("q", False), ("[/INST]", False), ("<s>", False), ("\\<s>", True), ("</s>", False), ("", False)]
    assert rows[-1]["last"] and rows[-1]["fault"] is None


@pytest.mark.parametrize(("roles", "fault"), [(["user", "assistant"], None), (["system", "user", "assistant"], None), (["assistant"], "turn 0: 'assistant' after 'start'"), (["user", "user"], "turn 1: 'user' after 'user'"), (["user", "assistant", "system"], "turn 2: 'system' after 'assistant'"), ([], "ends after 'start'")])
def test_order(roles, fault):
    order = chat.Order(chat.INSTRUCT)
    for role in roles:
        order.feed(role)
    assert order.end() == fault
