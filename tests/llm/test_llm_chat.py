import hashlib
import random

import samples

from cohortlens.llm import chat
from cohortlens.llm.queries import op3_chat_format

SHAPE = "conv_id long, turn long, role string, text string, window string, own long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark):
    rng = random.Random(4)
    signs = ["</s>", "<|im_end|>\n", "<|im_start|>", "[INST]", "\\", "\\\\", "\n", "<\\|", "word", " ", "é", "🙂", "<s>"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 60)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool\\\n<|"])
            text = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 30, 400])))
            rows.append((conv, turn, role, text, "w", 1))
    rows += [(90, 0, "assistant", None, None, None), (90, 1, None, "x", None, None), (91, 0, "system", "only", None, None)]
    rows += [(92, 0, "user", "same", None, None)] * 2 + [(None, 0, "user", "no conversation", None, None)]
    rows += [(93, 0, "user", samples.LONG, None, None), (93, 1, "assistant", samples.LONG, None, None)]
    return rows


def test_read_back_gives_every_turn_once(spark):
    rows = conversations(spark)
    formatted = chat.windows(spark.createDataFrame(rows, SHAPE), budget=120, history=40).cache()
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    chars = {}
    for r in formatted.collect():
        chars[r["conv_id"]] = chars.get(r["conv_id"], 0) + len(r["text"])
    assert got.keys() == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(((t, role or "", text or "") for c, t, role, text, *_ in rows if c == conv))
        assert r["n_turns"] == len(turns)
        if len({t for t, _, _ in turns}) == len(turns):
            assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), sha(learnt))
        assert r["formatted_chars"] == chars[conv]


def test_windows_keep_to_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "be kind", None, None)]
    rows += [(1, t, "user" if t % 2 else "assistant", "w " * 20, None, None) for t in range(1, 81)]
    found = chat.windows(spark.createDataFrame(rows, SHAPE), budget=200, history=60).orderBy("window").collect()
    assert len(found) > 5
    fresh = 0
    for i, r in enumerate(found):
        assert r["n_tokens"] <= 200
        assert r["text"].startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        marks = [s["fresh"] for s in r["segments"]][1:]
        repeated = marks.index(True)
        assert marks[repeated:] == [True] * (len(marks) - repeated)
        assert 1 <= repeated <= 3 if i else repeated == 0
        assert not any(s["target"] and not s["fresh"] for s in r["segments"])
        fresh += sum(marks)
    assert fresh == 80


def test_a_turn_above_the_budget_stands_whole(spark):
    rows = [(1, 0, "user", "a b", None, None), (1, 1, "assistant", "w " * 500, None, None), (1, 2, "user", "c", None, None)]
    found = chat.windows(spark.createDataFrame(rows, SHAPE), budget=50, history=10).orderBy("window").collect()
    assert sum(r["text"].count("w ") for r in found if any(s["target"] for s in r["segments"])) == 500


def test_query_adds_the_control_conversation(spark):
    rows = {r["conv_id"]: r for r in op3_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7]["n_turns"] == 2
    assert rows[-7]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n")
    assert (rows[-7]["loss_chars"], rows[-7]["loss_sha256"]) == (len(said), sha(said))


def test_no_turns_give_no_windows(spark):
    assert chat.digest(chat.windows(spark.createDataFrame([], SHAPE))).count() == 0
