from pyspark.sql import functions as F

from quillspark.llm.chat import PART, ChatTemplate, format_conversations, parse_formatted


def test_round_trip_and_mask(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b <|turn|> <|end|>", "\\</s>", "<<SYS>>x<</SYS>>", "<", "|>", "\\", "", None, "é😀 <s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, None, "x"), (None, 0, "assistant", "n"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit("clash"))
    got = {r["conv_id"]: r for r in parse_formatted(format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)]
    assert got[1]["loss_text"] == "".join(nasty[i] or "" for i in range(1, len(nasty), 2))
    assert [t["text"] for t in got[3]["turns"]] == ["a", "a", "b"] and got[3]["loss_text"] == ""
    assert got[2]["turns"][0]["role"] == "" and got[None]["loss_text"] == "n"
    for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert c not in got[1]["formatted"]
    assert got[1]["formatted"].count("<|end|>") == len(nasty)


def test_parts(spark):
    parts = [("text", "see <|end|>", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 2.0, None), (None, "and", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{PART}>")
    r = parse_formatted(format_conversations(df, ChatTemplate(), parts="parts")).collect()[0]
    assert [(a["place"], a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 0, "image", "i.png", 4), (0, 1, "audio", "a.wav", 50), (0, 2, "document", "d.pdf", 768)]
    assert "<|image:0|><|audio:1|>and<|document:2|>" in r["formatted"] and len(r["turns"]) == 2


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert parse_formatted(format_conversations(df)).count() == 0


def test_kinds_and_placeholders_are_told_apart(spark):
    said = [("text", "<|image:0|>", None, None, None, None, None), ("IMAGE", None, "i.png", 28, 15, None, None), ("end|>x<", None, "e", None, None, None, None), ("text", "", None, None, None, None, None), ("text", "a", None, None, None, None, None), ("text", "<|part|>b", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", said), (1, 1, "user", [said[0]])], f"conv_id long, turn long, role string, parts array<{PART}>")
    r = parse_formatted(format_conversations(df, parts="parts")).collect()[0]
    first, second = r["turns"]
    assert [tuple(p) for p in first["parts"]] == [("text", "<|image:0|>", None), ("image", None, 0), ("other", None, 1), ("text", "a", None), ("text", "<|part|>b", None)]
    assert [tuple(p) for p in second["parts"]] == [("text", "<|image:0|>", None)]
    assert first["text"] == r["loss_text"] == "<|image:0|>a<|part|>b"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("IMAGE", "i.png", 4), ("end|>x<", "e", 1)]


def test_many_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} <s>") for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = parse_formatted(format_conversations(df)).collect()[0]
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows]
    assert r["loss_text"] == "".join(x[3] for x in rows if x[2] == "assistant")
