import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from keelson.llm import chat, queries

TURNS = "conv_id long, turn long, role string, text string"


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_odd_turns_survive(spark, tables):
    nasty = "<|end|> \\<| <\\| \\\\ <|turn|>x<|text|>\n</s>"
    rows = [(1, 0, "system", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (1, 3, "assistant", ""), (2, 0, None, "x"), (None, 0, "user", "n"), (None, 1, "assistant", "é漢"), (3, 0, "system", "only"), (4, None, "assistant", "a"), (4, 1, "<|end|>", "b")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn {i} " + "word " * (i % 50)) for i in range(300)] + [(6, 0, "assistant", "long " * 5000), (6, 1, "user", "ok")]
    found = {r.conv_id: r for r in queries.op8_chat_formatting(spark, tables(conversations=(rows, TURNS))).collect()}
    assert set(found) == {1, 2, None, 3, 4, 5, 6, -7}
    for c, r in found.items():
        turns = [(x[2], x[3]) for x in rows if x[0] == c] if c != -7 else [(x[2], x[3]) for x in queries.CONTROL_TURNS]
        loss = "".join(t or "" for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest(turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "be nice")] + [(1, i, "assistant" if i % 2 == 0 else "user", "w " * (7 * i % 40)) for i in range(1, 3000)]
    budget = chat.Budget(window=200, history=50, least_room=32)
    w = chat.format_chats(spark.createDataFrame(rows, TURNS), budget).orderBy("block", "nth").collect()
    assert len(w) > 100 and not any(x.over_budget for x in w)
    assert all(x.formatted.startswith("<|turn|>system<|text|>be nice<|end|>") for x in w)
    assert sum(x.n_context > 1 for x in w) > len(w) // 2
    for x in w:
        new = x.formatted.split("<|end|>")[x.n_context : -1]
        assert len(x.loss) == sum("<|turn|>assistant" in t for t in new)


def greedy(rows, budget):
    """(own turns, history turns, tokens) of the windows of one conversation without a system turn."""
    sizes = [len(re.findall(r"[^\W_]+|[^\s\w]|_", t)) + chat.TURN_TOKENS for *_, t in rows]
    at = [sum(sizes[:i]) for i in range(len(rows))] if len(rows) < 500 else list(itertools.accumulate(sizes, initial=0))[:-1]
    room, out, cur = max(budget.window - budget.history, budget.least_room), [], []
    for i, a in enumerate(at):
        if cur and (a + sizes[i] - at[cur[0]] > room or a // (room * chat.BLOCK_ROOMS) != at[cur[0]] // (room * chat.BLOCK_ROOMS)):
            out.append(cur)
            cur = []
        cur.append(i)
    out.append(cur)
    found = []
    for own in out:
        before = [j for j in range(own[0]) if at[j] >= at[own[0]] - budget.history]
        found.append((own, before, sum(sizes[j] for j in (*before, *own))))
    return found


def test_windows_are_those_of_a_greedy_cut_and_nearly_full(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant"]), "w " * rng.randint(0, 59)) for i in range(3000)]
    w = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(7)).orderBy("block", "nth").collect()
    want = greedy(rows, chat.Budget())
    assert [(len(x.formatted.split("<|end|>")) - 1, x.n_context, x.n_tokens) for x in w] == [(len(o) + len(h), len(h), n) for o, h, n in want]
    assert not any(x.over_budget for x in w) and sum(x.n_tokens for x in w) / len(w) > 0.85 * chat.Budget().window


def test_turn_numbers_that_are_null_or_equal(spark, tables):
    rows = [(1, None if i % 2 else 5, "assistant", f"t{i:05d} " + "w " * (i % 30)) for i in range(2000)] + [(1, 5, "user", "same")] * 500
    found = queries.op8_chat_formatting(spark, tables(conversations=(rows, TURNS))).where("conv_id = 1").first()
    ordered = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
    assert found.n_turns == 2500 and found.turns_sha256 == digest([(x[2], x[3]) for x in ordered])
    loss = "".join(x[3] for x in ordered if x[2] == "assistant")
    assert found.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_other_columns_are_ignored(spark):
    schema = "conv_id long, conv string, turn long, role string, text string, block int, `system` string, at int"
    rows = [(1, "x", 0, "system", "s", 9, "y", 9), (1, None, 1, "assistant", "a", 9, "y", 9)]
    w = chat.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert [(x.conv_id, x.formatted) for x in w] == [(1, "<|turn|>system<|text|>s<|end|><|turn|>assistant<|text|>a<|end|>")]


def test_ties_repeated_rows_and_empty_tables(spark, tables):
    rows = [(1, 0, "user", "same")] * 3 + [(1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (2, 0, "system", "s"), (2, 0, "system", "s")]
    found = {r.conv_id: r for r in queries.op8_chat_formatting(spark, tables(conversations=(rows, TURNS))).collect()}
    assert found[1].turns_sha256 == digest([("assistant", "a"), ("assistant", "b")] + [("user", "same")] * 3)
    assert found[2].n_turns == 2
    empty = queries.op8_chat_formatting(spark, tables(conversations=([], TURNS))).collect()
    assert [r.conv_id for r in empty] == [-7]


def test_plan_has_no_python(spark, data):
    plan = queries.op8_chat_formatting(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_escaping_is_reversible(spark):
    texts = ["", "\\", "<|", "<\\|", "<\\\\|", "\\<|\\", "<<||", "a<|end|>b\\\\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
    assert all(r.t == r.u and "<|" not in r.e for r in rows.collect())
