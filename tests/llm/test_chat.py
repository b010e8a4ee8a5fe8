import json

import duckdb
import pytest
from pyspark.sql import functions as F

from earshot.llm import chat
from earshot.llm.q_chat import SQL, op7_chat

ODD = ["", "\\", "\\-", "[INST]", "[\\-INST]", "<|end|>\n", "<|start|>user<|sep|>x<|end|>\n", "</s><s>", "a\\\\[/INST]\\", "$1 \\0 \n\n", "<|s", "漢字🙂 <s>"]


def test_layouts_become_the_same_turns(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    records = {
        "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        "nested messages": {"data": {"messages": [{"content": "hi", "role": "user"}, {"role": "assistant", "content": "yo"}]}},
        "conversations": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        "prompt": {"prompt": "hi", "completion": "yo"},
        "prompt and response": {"response": "yo", "prompt": "hi"},
        "instruction": {"instruction": "hi", "output": "yo"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [("unknown", '{"q": 1}'), ("bad", "{"), ("null", None)]
    df = spark.createDataFrame(rows, "want string, j string").withColumn("record", F.try_parse_json("j")).withColumn("extra", F.lit(1))
    for r in chat.canonical(df).collect():
        if r.want in records:
            assert r.layout == r.want and [(t.role, t.content) for t in r.turns] == want
        else:
            assert r.layout is None and r.turns is None
    more = [{"system": "s", "prompt": "p", "completion": None}, {"instruction": "a", "input": "b", "output": "c"}]
    df = spark.createDataFrame([(json.dumps(m),) for m in more], "j string").withColumn("record", F.parse_json("j"))
    got = [[(t.role, t.content) for t in r.turns] for r in chat.canonical(df).collect()]
    assert got == [[("system", "s"), ("user", "p"), ("assistant", "")], [("user", "a\n\nb"), ("assistant", "c")]]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    texts = ODD + [a + b for a in ODD for b in ODD]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


def test_conversations(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["user", "assistant"] * 6, ODD))]
    rows += [(2, 1, "assistant", None), (2, 0, None, "q"), (3, 0, "<|sep|>", "x"), (None, 0, "assistant", "no key"), (4, 5, "assistant", "z"), (4, 5, "assistant", "a"), (4, 5, "assistant", "a"), (4, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    out = chat.conversations(df).select("conv_id", chat.read_turns(F.col("text")).alias("t"), chat.read_loss(F.col("text"), F.col("loss_spans")).alias("l"), "text").collect()
    got = {r.conv_id: ([(t.role, t.content) for t in r.t], r.l) for r in out}
    assert got[1] == ([(r, t) for _, _, r, t in rows[:12]], ODD[1::2])
    assert got[2] == ([("", "q"), ("assistant", "")], [""]) and got[3] == ([("<|sep|>", "x")], []) and got[None][1] == ["no key"]
    assert got[4] == ([("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "z")], ["a", "a", "z"])
    assert chat.conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({SQL})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in op7_chat(spark, f"/root/testdata/{sf}").collect()) == want
