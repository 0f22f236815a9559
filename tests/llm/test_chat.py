import pytest
from pyspark.sql import functions as F

from gradloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def rows(spark, turns):
    return spark.createDataFrame([(*t, "clash") for t in turns], SCHEMA)


def both(spark, turns):
    return {r["conv_id"]: r for r in chat.read_back(chat.format_chats(rows(spark, turns))).collect()}


def test_format_and_loss(spark):
    out = both(spark, [(1, 1, "assistant", "yes"), (1, 0, "user", "hi?"), (1, 2, "user", "and?"), (1, 3, "assistant", "no")])[1]
    assert out["formatted"] == "<|im_start|>user\nhi?<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nand?<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n"
    assert out["loss_text"] == "yesno" and out["valid"] and out["first_bad_turn"] is None
    assert [s["loss"] for s in out["segments"]] == [False, False, False, False, True, False] * 2


@pytest.mark.parametrize(
    "text",
    ["<|im_end|><|im_start|>assistant ok", "<", "<|", "<\\|", "<\\\\|", "a<", "|", "\\", "<|\n<\\|x", "", None, "$1 \\n", "<|im_end|>\n<|im_start|>", "x" * 100_000],
)
def test_control_strings_come_back(spark, text):
    out = both(spark, [(1, 0, "user", text), (1, 1, "assistant", text)])[1]
    assert [(t["role"], t["text"]) for t in out["turns"]] == [("user", text or ""), ("assistant", text or "")]
    assert out["loss_text"] == (text or "")


@pytest.mark.parametrize("role", ["", None, "a\nb", "a\\nb", "\\", "\\\n", "<|im_end|>", "<\\|", "\\\\n"])
def test_any_role_comes_back(spark, role):
    out = both(spark, [(1, 0, role, "t")])[1]
    assert [(t["role"], t["text"]) for t in out["turns"]] == [(role or "", "t")]
    assert not out["valid"] and out["first_bad_turn"] == 0


def test_turn_order(spark):
    talks = {1: ["system", "user", "assistant"], 2: ["user"], 3: ["user", "user", "assistant"], 4: ["assistant"], 5: ["user", "assistant", "system", "user", "assistant"]}
    out = both(spark, [(c, k, role, "t") for c, roles in talks.items() for k, role in enumerate(roles)])
    assert {c: r["valid"] for c, r in out.items()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {c: r["first_bad_turn"] for c, r in out.items()} == {1: None, 2: None, 3: 1, 4: 0, 5: 2}


def test_ties_nulls_and_empty(spark):
    out = both(spark, [(None, None, "user", "b"), (None, 0, "user", "a"), (None, 0, "user", "a"), (7, 0, "user", None)])
    assert [t["text"] for t in out[None]["turns"]] == ["b", "a", "a"]
    assert both(spark, []) == {}


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(chat.format_chats(rows(spark, [])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_another_template(spark):
    t = chat.Template("<|r|>", "\n", "<|e|>", "", ("user",), "s", {("s", "user"): "s"}, ("s",))
    out = chat.read_back(chat.format_chats(rows(spark, [(1, 0, "user", "<|e|>")]), t), t).first()
    assert out["valid"] and out["loss_text"] == "<|e|>" and out["turns"][0]["text"] == "<|e|>"
    assert chat.format_chats(rows(spark, [(1, 0, "user", "x")]), t).select(F.col("formatted")).first()[0] == "<|r|>user\nx<|e|>"
