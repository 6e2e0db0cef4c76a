import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from prefeval.llm import chat

hard = st.lists(st.sampled_from([*chat.CONTROL, "\\", "a", "\n", " ", "]", "é", "0", "1", "s>"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "[INST", "x]\n"]), hard), max_size=6))
def test_round_trip(turns):
    out, spans, at = chat.locate(turns, chat.marked)
    assert at == -1 and [(r, t) for r, t, _ in chat.read_back(out, [[*s, 0] for s in spans])] == turns
    assert [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]][:len(spans)]
    for _, t in turns:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_rewriting_template():
    def last_only(turns):                # drops the thinking of all but the last turn
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t.split('|')[-1]}" for k, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "think|b"), ("user", "c")]
    out, spans, at = chat.locate(turns, last_only)
    assert at == 2 and [out[s[2]:s[3]] for s in spans] == ["a", "b", "c"]


def test_rows(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yo \\"), (2, 0, None, None), (None, 3, "assistant", "z"),
            (1, 2, "assistant", "é\U0001f600"), (1, 2, "assistant", "é\U0001f600"), (3, None, "user", "x" * 100000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn int, role string, text string, spans int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    face = "é\U0001f600"
    assert got[1].n_turns == 4 and got[1].loss_chars == 8 and got[1].loss_sha256 == sha("yo \\" + face * 2)
    assert got[1].turns_sha256 == sha(f"user\nhi </s>\nassistant\nyo \\\nassistant\n{face}\nassistant\n{face}\n")
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert chat.format_conversations(df.limit(0)).count() == 0
