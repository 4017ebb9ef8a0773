import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|", "a", "\n", "é😀", "s>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES)
def test_round_trip(role, text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
    formatted, s, e, _ = chat.format_turn(role, [{"type": "text", "text": text}])
    assert chat.read_turn(formatted) == (role, text)
    assert (s == e) != (role == "assistant" and text != "") or (text == "" and s == e)


def test_parts():
    flat = chat.flatten([{"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "i.png", "width": 28, "height": 15}, {"type": "audio", "ref": "a", "seconds": 2}, {"type": "document", "ref": "d", "pages": 3}, {"type": "text", "text": None}])
    assert flat.text == "see <\\|image|> <|image|><|audio|><|document|>"
    assert [(k, r, n) for k, r, _, n in flat.attachments] == [("image", "i.png", 4), ("audio", "a", 50), ("document", "d", 2100)]
    assert all(flat.text.startswith(chat.PLACEHOLDER[k], at) for k, _, at, _ in flat.attachments)
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])


def test_query(spark, sf):
    got = {r["conv_id"]: r for r in chat.op8_chat(spark, sf).collect()}
    talks = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        r, lost = got[c], "".join(x for _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(lost)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()
        assert r["formatted_chars"] > sum(len(x) for _, _, x in turns)


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "assistant", ""), (2, 5, "assistant", "long " * 50_000)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(t)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 250_000
    assert chat.digests(chat.formatted(t.limit(0))).count() == 0
    with_parts = spark.createDataFrame([(1, 0, "user", "hi", [("image", "r", 14, 14)])], "conv_id long, turn long, role string, text string, parts array<struct<type:string,ref:string,width:int,height:int>>")
    row = chat.formatted(with_parts).first()
    assert row["formatted"] == "<|start|>user<|body|><|image|>hi<|end|>" and row["attachments"][0]["offset"] == len("<|start|>user<|body|>")
