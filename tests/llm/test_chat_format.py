import random

from hypothesis import given, settings
from hypothesis import strategies as st

from echoplane.llm import chat_format as m

PIECES = ["hello there", "\\", "\\\\n", "<|im_start|>", "<|im_end|>\n", "<|im_end|>", "</s>[INST] ok [/INST]", "<\\s>", "[\\INST]", "<<SYS>>", "\n", "n", "é🙂", "<", "|im_end|>", "", "\r\x0b", "word " * 300]


def _turns():
    rng = random.Random(6)
    rows = []
    for c in range(60):
        n = rng.randint(1, 14)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, "".join(rng.choices(PIECES, k=rng.randint(0, 5)))))
    rows += [(70, 0, "system", "alone"), (71, 0, "assistant", None), (71, 1, None, "x"), (71, 1, "we\\ird\nrole", "y")]
    rows += [(None, 5, "user", "z"), (None, None, "assistant", "zz"), (72, 0, "assistant", "same"), (72, 0, "assistant", "same")]
    return rows + [(80, t, ("user", "assistant")[t % 2], "long " * 50) for t in range(300)]


def test_reads_back_what_was_said(spark):
    rows = _turns()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(5)
    for kw in ({}, {"budget": 60}, {"budget": 1, "history_turns": 0}):
        got = {r.conv_id: tuple(r)[1:5] for r in m.read_back(m.format_conversations(df, **kw)).collect()}
        assert got == m.brute_force(rows)
    assert m.read_back(m.format_conversations(df.limit(0))).count() == 0


def test_windows(spark):
    df = spark.createDataFrame(_turns(), "conv_id long, turn long, role string, text string")
    windows = m.format_conversations(df, budget=400).where("conv_id = 80").orderBy("window").collect()
    assert len(windows) > 10
    for w in windows:
        turns = m.read_window(w.text)
        assert sum(m.cost(t) for _, t in turns) <= 400 and (w.window == 0) == (w.n_context == 0)
        assert len(w["mask"]) == 2 * sum(r == "assistant" for r, _ in turns[w.n_context :])
    first = m.format_conversations(df, budget=400).where("conv_id = 0 and window > 0").collect()
    assert first and all(m.read_window(w.text)[0][0] == "system" for w in first)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join))
def test_escape_is_reversible(text):
    assert m.unescape(m.escape(text)) == text and not any(c in m.escape(text) for c in m.CONTROLS)
    assert m.unescape_role(m.escape_role(text)) == text and "\n" not in m.escape_role(text)
