import random

from pyspark.sql import functions as F

from fleetpulse.llm import chat


def results(df, template=chat.DEFAULT):
    done = chat.format_conversations(df, template)
    return {
        r.conv_id: r
        for r in done.select(
            "*",
            chat.read_back(F.col("formatted"), template).alias("turns"),
            chat.loss_text(F.col("formatted"), F.col("loss"), template).alias("learned"),
        ).collect()
    }


def test_round_trip_of_hostile_texts(spark):
    draw = random.Random(5)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "[NEXT]", "\\", "<", "[", "s>", "/s>", "INST]", "é😀", "\n", " ", "$1", "", "</", "NEXT]"]
    text = lambda: "".join(draw.choice(pieces) for _ in range(draw.randint(0, 8)))
    rows, want = [], {}
    for conv in range(300):
        turns = [(draw.choice(["user", "assistant", "tool", "[INST]", None]), draw.choice([text(), text(), None])) for _ in range(draw.randint(1, 7))]
        want[conv] = [(r or "", t or "") for r, t in turns]
        rows += [(conv, i, r, t, "clash") for i, (r, t) in enumerate(turns)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    for template in (chat.DEFAULT, chat.ChatTemplate("<begin>", "<end>", "<role>", "<say>", "<and>")):
        got = results(df.withColumn("block", F.lit(1)), template)
        for conv, turns in want.items():
            assert [(t.role, t.text) for t in got[conv].turns] == turns
            assert got[conv].learned == "".join(t for r, t in turns if r == "assistant")


def test_template_and_merging(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c <s>"), (None, 0, None, None)]
    got = results(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got[1].formatted == "<s>[INST]user[/INST]a[NEXT]b</s>[INST]assistant[/INST]c <\\s></s>"
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss] == ["c <\\s>"]
    assert got[None].formatted == "<s>[INST][/INST]</s>" and got[None].loss == []


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(t.role, t.text) for t in results(df)[1].turns] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert results(df.limit(0)) == {}
