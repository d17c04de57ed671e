from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from patchwell.llm import chat
from patchwell.llm.chat import ChatTemplate

T = ChatTemplate()
SCHEMA = "conv_id long, turn long, role string, text string, state string, loss boolean"
HOSTILE = st.lists(st.sampled_from([*T.controls, "\\", "<", "|", ">", "a", "é", "\n", "<|", "end|>", "[", "/"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HOSTILE, HOSTILE), max_size=4))
def test_round_trip(turns):
    formatted = "".join(x for role, text in turns for x, _ in T.segments(role, text))
    assert T.parse(formatted) == turns
    for _, text in turns:
        assert not any(c in T.escape(text) for c in T.controls)


def test_machine_and_loss(frame):
    rows = [
        (1, 1, "user", "q"), (1, 0, "system", "s"), (1, 2, "assistant", "a</s>"), (1, 3, "user", "q2"), (1, 4, "assistant", ""),
        (2, 0, "assistant", "first"), (2, 1, "user", "q"),
        (3, 0, "user", None), (3, None, None, "tool says"),
        (None, 0, "user", "u"), (None, 1, "assistant", "v"),
    ]
    df = frame([(*r, "x", True) for r in rows], SCHEMA)
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars, r.valid) for k, r in out.items()} == {
        1: (5, 5, True), 2: (2, 5, False), 3: (2, 0, False), None: (2, 1, True),
    }
    segments = chat.format_turns(df).where("conv_id = 1").orderBy("turn_index", "segment").collect()
    assert [r.text for r in segments if r.loss] == ["a<\\/s>", ""]
    assert chat.read_back(chat.format_turns(frame([], SCHEMA))).count() == 0


def test_a_conversation_longer_than_a_batch(frame, spark):
    n = 25_000
    df = spark.range(n).selectExpr(
        "1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id) as text"
    )
    row = chat.read_back(chat.format_turns(df)).collect()
    assert len(row) == 1 and row[0].n_turns == n and row[0].valid
