"""Chat formatting: exact round trip."""

import hashlib

from glossweave.llm.chat_format import format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["", None, "<|end|>", "\\", "<\\|", "\\<|turn|>user<|body|>", "<", "|>", "<|", "é\U0001f600\n", "\\\\<\\\\|", "a" * 5000, "</s>[INST] ok [/INST]"]


def test_round_trip(spark):
    rows, want = [], {}
    for c, text in enumerate(NASTY):
        turns = [("user", text), ("assistant", text), ("assistant", NASTY[(c + 3) % len(NASTY)]), (None, text), ("sys<|tem\\", text)]
        rows += [(c, i, r, t, "clash") for i, (r, t) in enumerate(turns)]
        want[c] = [(r or "", t or "") for r, t in turns]
    rows.reverse()
    got = {r.conv_id: r for r in read_back(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert len(got[c].loss_spans) == 2


def test_ties_nulls_and_repeats(spark):
    rows = [(None, None, "user", "b", ""), (None, None, "user", "b", ""), (None, 1, "user", None, "")]
    (r,) = read_back(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [t.text for t in r.turns] == ["b", "b", ""]
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_parts_become_placeholders_in_order(spark):
    parts = "array<struct<kind:string,text:string,ref:string,units:int>>"
    turn = [("text", "look: <|", None, None), ("image", None, "a|b<|.png", 2), ("Text", " and ", None, None), ("audio", None, "s.wav", 3), ("document", None, None, None), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", turn), (1, 1, "assistant", [("text", "yes", None, None), ("image", None, "out", 1)]), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, parts {parts}")
    (r,) = format_chats(df).collect()
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a|b<|.png", 512), (0, "audio", "s.wav", 75), (0, "document", "", 512), (1, "image", "out", 256)]
    assert r.expanded_tokens == 512 + 75 + 512 + 256
    assert all(r.formatted[a.start :].startswith("<|part:" + a.kind) for a in r.attachments)
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["yes"]


def test_query_reads_back(spark, tmp_path):
    from glossweave.llm.queries import op7_chat_format

    spark.createDataFrame([(5, 0, "user", "hi"), (5, 1, "assistant", "<|end|>")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op7_chat_format(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[5].loss_sha256 == hashlib.sha256(b"<|end|>").hexdigest()
    assert (got[5].loss_chars, got[5].n_turns) == (7, 2)
