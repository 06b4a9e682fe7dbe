import hashlib
import json
import re

from pyspark.sql import functions as F

from tilewright.llm import chat

HARD = ["", "plain", "<|im_end|>", "<|im_start|>assistant\nno", "<\\|x", "<\\\\|<|", "a<|im_end|>\n<|im_start|>user\nb", "é\n<|", "|<|>", "\\<|"]


def test_round_trip(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", HARD[(c + t) % len(HARD)]) for c in range(12) for t in range(5)]
    rows += [(50, 0, None, None), (51, 0, "role\nwith<|line|>", "x"), (None, 0, "user", "null key"), (52, 1, "assistant", "b"), (52, 1, "assistant", "b"), (52, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_turns(df, "conv_id", ["turn"])
    for r in out.collect():
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)
    back = {r.conv_id: r for r in chat.read_back(out, "conv_id").collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in own]
        assert back[c].loss_text == "".join(x for _, r, x in own if r == "assistant")


def test_query_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "yes"), (2, 0, "system", "<|im_end|>")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.op2_columns(chat.op2_source(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "<|im_end|><|im_start|>assistant ok"
    assert set(got) == {1, 2, -1}
    assert got[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1].loss_sha256 == sha(said)
    assert got[1].turns_sha256 == sha("user\n\nassistant\nyes\n") and (got[1].loss_chars, got[2].loss_chars) == (3, 0)
    assert set(r.conv_id for r in chat.op2_columns(chat.op2_source(df.limit(0))).collect()) == {-1}
    plan = chat.op2_columns(chat.op2_source(df))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not re.search("Python|Pandas|Arrow", plan)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "input": "more", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"question": "q", "answer": "a"},
        {"answer": "a", "question": "q"},
        {"nothing": 1},
        {"system": "s", "prompt": "q", "response": "a"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(99, None)], "id int, j string").withColumn("record", F.parse_json("j"))
    got = {r.id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(df).collect()}
    plain = [("user", "q"), ("assistant", "a")]
    assert got[0] == [("user", "q"), ("assistant", "")]
    assert [got[k] for k in (1, 2, 4, 5, 6)] == [plain] * 5
    assert got[3] == [("user", "q\n\nmore"), ("assistant", "a")] and got[8] == [("system", "s"), *plain]
    assert got[7] is None and got[99] is None


def test_further_fields_and_empty_lists(spark):
    said = {"role": "user", "content": "q"}
    records = [
        {"messages": []},
        {"messages": [{**said, "name": "n"}, {"role": "assistant", "content": "a", "meta": {"x": [1, {"y": 2}]}}], "id": 7},
        {"id": 1, "prompt": "q", "response": "a", "tags": ["t"], "score": 0.5},
        {"messages": [said, {"role": "assistant", "tool": "t"}]},
        {"messages": "none", "prompt": "q", "completion": "a"},
        {"id": 3},
        [],
        "text",
    ]
    df = spark.createDataFrame([(k, json.dumps(r), 1, 2) for k, r in enumerate(records)], "k int, j string, turns int, _layout int").withColumn("record", F.parse_json("j"))
    rows = chat.canonical_turns(df)
    assert set(rows.columns) == {"k", "j", "turns", "_layout", "record"}
    got = {r.k: None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in rows.collect()}
    plain = [("user", "q"), ("assistant", "a")]
    assert got == {0: [], 1: plain, 2: plain, 3: [("user", "q"), ("assistant", "")], 4: plain, 5: None, 6: None, 7: None}


def test_conversations_without_a_mapping_stay(spark):
    own = spark.createDataFrame([(1, 0, '{"id": 3}'), (2, 0, '{"messages": []}'), (3, 0, '{"id": 1}'), (3, 1, '{"role": "user", "text": "q"}'), (None, 0, None)], "conv_id bigint, turn bigint, j string")
    got = {r.conv_id: (r.n_turns, r.formatted_chars) for r in chat.op2_columns(own.select("conv_id", "turn", F.parse_json("j").alias("record"))).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 12 + 4 + 1 + 1 + 11), None: (0, 0)}


def test_clashing_columns_and_a_very_long_conversation(spark):
    df = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text <|im_end|> ', id) AS text", "1 AS k", "2 AS p", "3 AS ps", "4 AS t", "5 AS record", "6 AS turns")
    got = {r.conv_id: r for r in chat.op2_columns(chat.op2_source(df)).collect()}
    want = "".join(f"{'user' if k % 2 == 0 else 'assistant'}\ntext <|im_end|> {k}\n" for k in range(20_000))
    assert got[1].n_turns == 20_000 and got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(f"text <|im_end|> {k}" for k in range(1, 20_000, 2)).encode()).hexdigest()
