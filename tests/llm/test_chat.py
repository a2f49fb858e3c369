import hashlib
import json

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import chat

TURNS = [("system", "be brief"), ("user", "hi"), ("assistant", "hello")]


def canonical(spark, *records):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)],
                               "id int, record string")
    rows = chat.templated(chat.canonical(df)).orderBy("id").collect()
    return [(r["layout"], None if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in rows]


def test_layouts(spark):
    found = canonical(
        spark,
        {"messages": [{"role": r, "content": t} for r, t in TURNS]},
        {"messages": [{"content": t, "role": r, "weight": 1} for r, t in TURNS], "id": 7, "source": {"url": "u"}},
        {"conversations": [{"from": f, "value": t} for f, (_, t) in zip(("system", "human", "gpt"), TURNS)]},
        {"instruction": "add", "input": "1 2", "output": "3"},
        {"instruction": "add", "input": "", "output": "3"},
        {"instruction": "add", "output": "3", "system": "be brief"},
        {"prompt": "hi", "completion": "hello"},
        {"prompt": "hi", "response": "hello"},
        {"question": "q", "answer": "a", "context": None},
        {"turns": [{"turn": 0, "role": None, "text": None}]},
        {"messages": []},
    )
    assert found == [
        ("messages", TURNS), ("messages", TURNS), ("conversations", TURNS),
        ("instruction", [("user", "add\n\n1 2"), ("assistant", "3")]), ("instruction", [("user", "add"), ("assistant", "3")]),
        ("instruction", [("system", "be brief"), ("user", "add"), ("assistant", "3")]),
        ("completion", [("user", "hi"), ("assistant", "hello")]), ("response", [("user", "hi"), ("assistant", "hello")]),
        ("question", [("user", "q"), ("assistant", "a")]), ("turns", [("", "")]), ("messages", []),
    ]


def test_unknown_records_stay(spark):
    assert canonical(spark, None, "no json", {"a": 1}, {"prompt": "x"}, "[1]") == [(None, None)] * 5


@pytest.mark.parametrize("text", ["", "<|im_end|>\n<|im_start|>user\n", "\\", "\\s\\\\|<\\|", "<<||>", "\\n\n", "é😀<|", "<|" * 50, "a" * 200_000])
def test_round_trip(spark, text):
    turns = [("user", text), ("as\nsis<|tant\\", text), ("assistant", text), ("assistant", text)]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
    row = chat.templated(df).select("*", chat.read_turns(F.col("formatted")).alias("said"),
                                    chat.read_loss(F.col("segments")).alias("loss")).first()
    assert [tuple(t) for t in row["said"]] == turns
    assert row["loss"] == 2 * text
    assert row["formatted"].count("<|im_start|>") == row["formatted"].count("<|im_end|>\n") == 4
    assert row["formatted"] == "".join(s["text"] for s in row["segments"])


def test_records_of_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, "x"),
                                  (1, None, None, "first")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.canonical(chat.records_of(rows)).collect()}
    assert found == {1: ["first", "", "b", "b"], None: ["x"]}
    assert chat.canonical(chat.records_of(rows.filter("false"))).collect() == []


def test_long_text_and_clashing_columns(spark):
    df = spark.range(1).select(F.to_json(F.struct(F.repeat(F.lit("ab\\\"\n"), 1_000_000).alias("prompt"), F.lit("k").alias("completion"))).alias("record"),
                               F.lit(1).alias("turns"), F.lit(2).alias("layout"), F.lit(3).alias("formatted"))
    row = chat.templated(chat.canonical(df)).select("layout", F.length(chat.read_turns(F.col("formatted"))[0]["text"]).alias("n")).first()
    assert row["layout"] == "completion" and row["n"] == 5_000_000


def test_digest(spark):
    from parcelwise.llm.registry import HOSTILE, op2_chat

    row = op2_chat(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{HOSTILE}\nassistant\n{HOSTILE}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(HOSTILE), hashlib.sha256(HOSTILE.encode()).hexdigest())


def test_roles_of_turns_stay(spark):
    """Foreign names of roles are those of other layouts only."""
    rows = spark.createDataFrame([(c, t, role, f"{c} {t}") for c in range(40) for t, role in enumerate(["human", "bot"] if c % 2 else ["system", "user", "assistant"])]
                                 + [(100, 0, None, None), (101, 0, "user", ""), (101, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    plain, mixed = (chat.canonical(f(rows)).collect() for f in (chat.records_of, chat.mixed_records_of))
    assert {r["conv_id"]: r["turns"] for r in plain} == {r["conv_id"]: r["turns"] for r in mixed}
    assert {r["layout"] for r in plain} == {"turns"} and {r["layout"] for r in mixed} == {"turns", "messages", "conversations", "response"}
    assert [t["role"] for t in next(r for r in mixed if r["conv_id"] == 1)["turns"]] == ["human", "bot"]


def test_clashing_column_stays(spark):
    df = spark.createDataFrame([('{"prompt": "a", "completion": "b"}', "mine")], "record string, _fingerprint string")
    row = chat.canonical(df).first()
    assert row["_fingerprint"] == "mine" and row["layout"] == "completion"
