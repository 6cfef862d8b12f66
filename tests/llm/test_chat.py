import hashlib

from tallywick.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, source string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_with_control_strings(spark):
    texts = ["hi", None, "", "</s>[INST] ok [/INST]", "<s>", "<<s>s>", "\\", "\\\\<s>\\", "a\\<\\s>", "[INST", "[/INST]\n</s", "x" * 70000, "日本🙂"]
    rows = [(c, t, role, text, "f", "g") for c, text in enumerate(texts) for t, role in enumerate(["system", "user", "assistant", None, "odd</s>role"])]
    rows += [(100, 0, "user", "same", "f", "g")] * 3 + [(None, 1, "user", "q", "f", "g"), (None, None, "assistant", "tie", "f", "g")]
    formatted = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    state = {r.conv_id: r for r in formatted.collect()}
    assert all(r.round_trip for r in state.values())
    for c in got:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x, *_ in rows if k == c))
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == digest("".join(f"{r}\n{x}\n" for *_, r, x in turns))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss))
        assert got[c].formatted_chars == len(state[c].formatted)
        for mark in ("<s>", "[INST]"):
            assert state[c].formatted.count(mark) == len(turns)


def test_plain_conversations_stay_unescaped(spark):
    rows = [(1, 0, "user", "hi", "", ""), (1, 1, "assistant", "yo", "", "")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.formatted == "<s>user[INST]hi[/INST]<s>assistant[INST]yo</s>" and not got.escaped
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_what_is_not_in_the_grammar_is_null(spark):
    bad = ["<s>user[INST]hi", "x<s>user[INST]hi</s>", "<s>user[INST]hi</s>x", "<s>user</s>hi[INST]"]
    df = spark.createDataFrame([(b,) for b in bad], "f string")
    assert all(r.turns is None for r in chat.parse(df, "f", "turns").collect())
