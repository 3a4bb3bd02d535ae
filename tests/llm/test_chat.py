import random
import re

from answerscope.llm import chat


def least(roles):
    """The least cost by trying every move at every turn."""
    best = {chat.BEGIN: 0}
    for role in roles:
        now = {}
        for state, cost in best.items():
            for nxt, more, *_ in chat.choices(state, chat.label_of(role)):
                now[nxt] = min(now.get(nxt, 10**9), cost + more)
        best = now
    return min(c + chat.ENDINGS[s][0] for s, c in best.items())


def test_repairs_by_brute_force(spark):
    rng, rows, want = random.Random(3), [], {}
    for c in range(60):
        roles = [rng.choice(["user", "assistant", "system", None, "tool", "human"]) for _ in range(rng.choice([1, 2, 3, 7, 40]))]
        want[c] = least(roles)
        rows += [(c, t, r, f"t{t}<|im_start|>") for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (3, 512):
        got = chat.repair(df, block).toPandas().sort_values(["conv_id", "turn"])
        assert len(got) == len(rows) and got.groupby("conv_id")["cost"].first().to_dict() == want
        for c, g in got.groupby("conv_id"):
            text = "".join(g["fragment"])
            found = re.findall(r"<\|im_start\|>(\w+)\n((?:(?!<\|im_).)*)<\|im_end\|>\n", text, re.S)
            roles = [r for r, _ in found]
            turns = roles[1:] if roles[0] == "system" else roles
            assert turns and turns == ["user", "assistant"] * (len(turns) // 2)
            assert "".join(t for _, t in found).replace("\n\n", "") == "".join(f"t{t}< |im_start|>" for t in g["turn"])
            assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in found) == text
    chats = {r["conv_id"]: r["chat"] for r in chat.rendered(chat.repair(df)).collect()}
    assert chats == got.groupby("conv_id")["fragment"].agg("".join).to_dict()


def test_legal_chats_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "x" * 200_000), (2, 1, "gpt", None)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["cost"] for r in got} == {0} and {r["action"] for r in got} == {"keep"}


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "a", 1, "x"), (None, 0, "user", "a", 1, "x"), (None, None, None, None, 2, "y"), (5, None, "user", "", 3, "z"), (5, 3, "assistant", None, 3, "z"), (5, 3, "assistant", None, 3, "z"), (6, -700, "bot", "b", 0, "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block long, fragment string")
    got = chat.repair(df).collect()
    assert len(got) == len(rows)
    assert {r["conv_id"]: r["cost"] for r in got} == {None: least([None, "user", "user"]), 5: least(["user", "assistant", "assistant"]), 6: least(["bot"])}
    assert chat.repair(df.where("false")).count() == 0
