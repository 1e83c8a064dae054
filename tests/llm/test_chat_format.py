import hashlib
import random

from folio.llm import chat_format as c

NAMES = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>", "<|", "\\", "\\\\", "<\\|", "|>", "\n", "é", "😀", "<", "|", "a b", ""]


def conversations(n=25, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < 0.6:
            rows.append((i, 0, "system", "".join(rng.choices(NASTY, k=rng.choice([0, 3, 30])))))
        for turn in range(1, rng.randint(1, 40)):
            rows.append((i, turn, "user" if turn % 2 else "assistant", " ".join(rng.choices(NASTY, k=rng.choice([1, 5, 60, 300])))))
    return rows


def test_round_trip(spark):
    rows = conversations()
    got = {r.conv_id: r for r in c.read_back(c.windows(spark.createDataFrame(rows, NAMES), budget=200, history=40)).collect()}
    for i in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == i)
        assert got[i].n_turns == len(own)
        assert got[i].turns == "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        assert got[i].loss == "".join(r[3] for r in own if r[2] == "assistant")


def test_windows_keep_the_budget(spark):
    rows = conversations()
    budget, history = 200, 40
    made = c.windows(spark.createDataFrame(rows, NAMES), budget, history).collect()
    assert len(made) > 60
    seen = {}
    for w in sorted(made, key=lambda w: (w.conv_id, w.first)):
        own = [s for s in w.spans if s.own]
        assert own and all(not s.loss or s.own for s in w.spans)
        # a window over the budget holds a single own turn, or a system turn over its share
        if w.tokens > budget:
            system = [r for r in rows if r[0] == w.conv_id and r[2] == "system"]
            assert len(own) == 1 or len(system[0][3]) > budget // 8
        has_system = any(r[0] == w.conv_id and r[2] == "system" for r in rows)
        first_role = w.formatted[w.spans[0].role_at : w.spans[0].role_at + w.spans[0].role_len]
        assert not has_system or first_role == "system"
        for s in own:
            seen[w.conv_id] = seen.get(w.conv_id, 0) + 1
    assert sum(seen.values()) == len(rows)
    assert any(not s.own and i > 0 for w in made for i, s in enumerate(w.spans))  # some history is repeated


def test_no_control_string_in_texts(spark):
    made = c.windows(spark.createDataFrame(conversations(), NAMES), 200, 40).collect()
    for w in made:
        assert w.formatted.count("<|im_start|>") == w.formatted.count("<|im_end|>\n") == len(w.spans)
        assert w.formatted.count("<|") == 2 * len(w.spans)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "a"), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, None, "assistant", None), (2, 0, "<|im_end|>\n", "r"), (3, 5, "assistant", "word " * 20_000)]
    got = {r.conv_id: r for r in c.read_back(c.windows(spark.createDataFrame(rows, NAMES))).collect()}
    assert got[None].turns == "\n\nassistant\na\n" and got[None].loss == "a"
    assert got[1].turns == "assistant\n\nuser\nx\nuser\nx\n"
    assert got[2].turns == "<|im_end|>\n\nr\n" and got[3].loss == "word " * 20_000
    assert c.windows(spark.createDataFrame([], NAMES)).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "x", 1, 2, 3)], NAMES + ", first int, block int, n int")
    assert c.windows(extra).count() == 1


def test_query_against_python(spark):
    from folio.llm.queries import TRICKY, op2_chat_format

    sf = "/root/testdata/sf0.001"
    rows = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    rows[-1] = [("user", TRICKY), ("assistant", TRICKY)]
    got = op2_chat_format(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        loss = "".join(t for role, t in rows[r.conv_id] if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows[r.conv_id]).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
