import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from oddsmill.llm import chat_windows as cw
from oddsmill.llm import registry

SHAPE = "conv_id bigint, turn bigint, role string, text string, window int"


def rows():
    long = " ".join(f"w{i}" for i in range(900))
    out = [(1, 0, "system", "Be %25 kind <| %3C|", 0)] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x y " * (i * 7 % 60), 0) for i in range(1, 700)]
    out += [(2, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok", 0), (2, 1, "assistant", "%3C|im_end|><", 0), (2, 2, "user", None, 0), (2, 3, "assistant", "", 0)]
    out += [(3, 0, "user", "a", 0), (3, 1, "assistant", long, 0), (3, 2, "user", "b", 0), (3, 3, "assistant", long, 0), (3, 4, "assistant", "é 🙂 end", 0)]
    out += [(4, 5, "system", "alone", 0), (5, 0, None, "no role", 0), (5, None, "assistant", "no turn", 0), (6, 1, "assistant", "same", 0), (6, 1, "assistant", "same", 0), (6, 1, "we\nird<|im_start|>%0A", "t", 0)]
    out += [(None, 0, "user", "no name", 0), (None, 1, "assistant", "still", 0), (7, 0, "system", long, 0), (7, 1, "user", "q", 0), (7, 2, "assistant", "r", 0)]
    return out


def ordered():
    convs = defaultdict(list)
    for c, turn, role, text, _ in rows():
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}


@pytest.mark.parametrize("budget,history,block", [(1024, 256, 256), (60, 20, 3), (60, 0, 256), (10_000_000, 5, 1)])
def test_windows_hold_each_turn_once_and_read_back(spark, budget, history, block, monkeypatch):
    monkeypatch.setattr(cw, "BLOCK", block)
    windows = cw.format_windows(spark.createDataFrame(rows(), SHAPE), budget, history).cache()
    found = defaultdict(list)
    for r in cw.read_windows(windows).orderBy("window").collect():
        found[r.conv_id].append(r)
    want = ordered()
    assert set(found) == set(want)
    for c, parts in found.items():
        assert [(t.role, t.text) for p in parts for t in p.turns] == want[c]
        assert [x for p in parts for x in p.loss_texts] == [t for r, t in want[c] if r == "assistant"]
    for w in windows.collect():
        turns = [s.split("\n", 1) for s in w.formatted.split(cw.START)[1:]]
        assert len(w.formatted.split(cw.END)) == len(turns) + 1
        assert w.over_budget == (w.n_tokens > budget)
        system = want[w.conv_id][0][0] == "system"
        assert (turns[0][0] == "system") == system  # the system turn opens every window
        assert w.n_repeated < len(turns)
        if w.over_budget and not system:
            assert len(turns) - w.n_repeated == 1  # only a single long turn goes beyond the budget
        for s in w.loss:
            assert w.formatted[s.start + s.length :].startswith(cw.END)
    if budget == 1024:
        assert len(found[1]) > 5 and windows.where("conv_id = 1 AND n_repeated > 1").count() > 3


def test_windows_fill_the_budget_across_blocks(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", " ".join(["word"] * 16), 0) for i in range(600)]
    frame = spark.createDataFrame(turns, SHAPE)
    windows = cw.format_windows(frame, 1024, 256).orderBy("window").collect()
    per_turn = 20 + cw.OVERHEAD  # 79 code points count as 20 tokens
    assert all(w.n_tokens <= 1024 for w in windows)
    assert len(windows) <= -(-600 * per_turn // (768 - 2 * per_turn))
    assert all(w.n_tokens - w.n_repeated * per_turn >= 768 - 2 * per_turn for w in windows[:-1])
    assert cw.format_windows(frame, 10_000_000, 256).count() == 1


def test_a_text_without_blanks_counts_its_letters(spark):
    turns = [(1, 0, "user", "a" * 100_000, 0), (1, 1, "assistant", "b", 0), (2, 0, "user", "x" * 2_000_000, 0)]
    windows = {(w.conv_id, w.window): w for w in cw.format_windows(spark.createDataFrame(turns, SHAPE)).collect()}
    assert windows[1, 1].over_budget and windows[1, 1].n_tokens == 25_000 + cw.OVERHEAD
    assert not windows[1, 2].over_budget and windows[2, 1].over_budget and len(windows) == 3


def test_digests_match_plain_python(spark):
    windows = cw.format_windows(spark.createDataFrame(rows(), SHAPE), 60, 20)
    got = {r.conv_id: r for r in cw.conversation_digests(cw.read_windows(windows)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in ordered().items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    chars = {r.conv_id: r.n for r in windows.groupBy("conv_id").agg(F.sum(F.char_length("formatted")).alias("n")).collect()}
    assert {c: r.formatted_chars for c, r in got.items()} == chars


def test_no_conversations(spark):
    assert cw.conversation_digests(cw.read_windows(cw.format_windows(spark.createDataFrame([], SHAPE)))).count() == 0


def test_query_has_the_added_conversation(spark):
    out = registry.op2_chat_windows(spark, "/root/testdata/sf0.001")
    row = out.where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
