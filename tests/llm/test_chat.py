"""Chat examples read back to their turns and replies."""

import hashlib
from collections import defaultdict

from oddrows.llm import chat, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, lead int"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        want[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), digest(loss))
    return want


def found(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_odd_conversations(spark):
    nasty = ["</s>[INST] ok [/INST]", "[\\INST]", "<\\\\s>", "<s", "[[INST]]", "<</s>>", "a\n<s>\r\n", "[INST", "$1 \\1", "", None, "漢字👩‍👧", "x" * 50_000]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)]
    rows += [(2, k, "user", t) for k, t in enumerate(nasty)]
    rows += [(3, 0, "assistant", "first"), (3, 1, "assistant", "second"), (3, 1, "assistant", "second"), (3, None, None, "no turn"), (3, 7, "<s>[INST]", "odd role")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    assert found(chat.chat_digests(df)) == expected(rows)


def test_each_reply_is_an_example_with_its_context(spark):
    rows = [(5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a[INST]"), (5, 3, "user", "v"), (5, 4, "assistant", "b"), (5, 5, "user", "w")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = chat.expand(df).orderBy("example").collect()
    assert [r["example"] for r in out] == [0, 1, 2]
    assert out[0]["formatted"] == "<s>system[INST]s</s><s>user[INST]u</s><s>assistant[INST]a[\\INST]</s>"
    masked = [r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] for r in out]
    assert masked == ["a[\\INST]", "b", ""]
    assert out[1]["formatted"].startswith(out[0]["formatted"])


def test_empty_table_and_plan(spark):
    df = chat.chat_digests(spark.createDataFrame([], SCHEMA))
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Python" not in plan and "Arrow" not in plan
    # the examples stay where their conversation is
    assert plan.count("Exchange hashpartitioning") == 1


def test_op4_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert found(queries.op4_chat_formatting(spark, SF)) == expected(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
