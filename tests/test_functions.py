"""Planted cases of cleaning, scoring, parsing and logits."""

import math

import pytest
from pyspark.sql import functions as F

from curatrix.functions import logits as L
from curatrix.functions import parse as P
from curatrix.functions import text as X


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize("text,want", [("定期寿险和终身寿险有什么区别？", 0.99), ("aaaaaaaaaa", 0.27), ("推荐一部好看的电影", 0.405)])
def test_quality(spark, text, want):
    assert col(spark, [text], X.quality_score)[0] == pytest.approx(want, abs=1e-12)


def test_clean_and_filter(spark):
    given = [None, "", "ab", "x" * 501, "a　\xa0b c", "a\x1cbcd", "abc\x01d", "abc�d", "!!! ???", "定期寿险", "加VX了解", "see www.x", "$$$ now"]
    ok = col(spark, given, lambda x: F.coalesce(X.acceptable(X.clean_text(x)), F.lit(False)))
    assert [g for g, o in zip(given, ok) if o] == ["a　\xa0b c", "a\x1cbcd", "定期寿险", "加VX了解"]
    assert col(spark, ["a　\xa0b c", "a\x1cbcd"], X.clean_text) == ["a b c", "a bcd"]
    assert col(spark, ["加VX了解"], lambda x: X.acceptable(x, compat=False)) == [False]


def test_python_white_space(spark):
    import re

    chars = [chr(c) for c in [*range(1, 0x100), *range(0x1680, 0x1681), *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    got = col(spark, [f"a{c}b" for c in chars], lambda x: F.regexp_replace(x, X.WS, "_"))
    assert got == [re.sub(r"\s+", "_", f"a{c}b") for c in chars]


def test_labels(spark):
    refusal = "抱歉，我只能回答寿险相关的问题"
    assert col(spark, [refusal], X.binary_label) == [1]
    assert col(spark, [refusal], X.ternary_label) == [1]
    assert col(spark, [refusal, "好的", None], lambda x: X.ternary_label(x, compat=False)) == [0, 2, 2]
    assert col(spark, [10, 9, 2, 1], X.importance, "int") == ["高频", "中频", "中频", "低频"]


def test_intents(spark):
    assert col(spark, ["是", "YES", "yes", "Yes", "0", "否", "maybe"], P.intent_of) == ["寿险意图"] * 3 + ["拒识"] * 4
    assert col(spark, ["是", "Yes", "0", "maybe"], P.unknown_intent) == [False, True, False, True]


def test_products(spark):
    x = "产品名称：安心保 产品代码：A12"
    assert col(spark, [x, "no"], P.product_name) == ["安心保", None]
    assert col(spark, [x, "no"], P.product_code) == ["A12", None]
    assert col(spark, ['1:{"questions":["q1","q2"]}', "1:{bad", None], P.embedded_questions) == [["q1", "q2"], [], []]


def test_responses(spark):
    given = ['{"probabilities":[0.2,0.8]}', '{"probabilities":[0.2,0.9]}', '{"prediction":0,"confidence":0.9}', '{"prediction":1}', '{"intent":"寿险"}', "no json"]
    got = col(spark, given, P.response_probabilities)
    want = [[0.2, 0.8], [0.5, 0.5], [0.9, 0.1], [0.3, 0.7], [0.3, 0.7], [0.5, 0.5]]
    assert all(g == pytest.approx(w) for g, w in zip(got, want))
    assert col(spark, ["x答案：其他 答案：寿险相关\n", "无"], P.answer_label) == [1, 0]
    assert col(spark, ['{"a":1}', "{", None], P.broken_json) == [False, True, False]
    assert col(spark, ["拒识", "x"], P.mapped_label) == ["其他", None]


def test_energy(spark):
    e = col(spark, [[1.0, -2.0]], L.energy, "array<double>")[0]
    assert e == pytest.approx(-1.0485873515737423, abs=1e-14)
    assert sum(col(spark, [[1000.0, 0.0, -5.0]], L.softmax, "array<double>")[0]) == pytest.approx(1)
    df = spark.createDataFrame([(-2.0,), (-1.0,), (-3.0,), (0.0,)], "e double")
    label, conf = L.energy_decision(F.col("e"), F.lit("1"), -2.0, -1.0)
    assert [tuple(r) for r in df.select(label, conf).collect()] == [("1", "medium"), ("1", "medium"), ("1", "high"), ("拒识（OOD）", "low")]
    assert math.isclose(col(spark, [[3.0, 4.0]], lambda x: L.total(L.unit(x)), "array<double>")[0], 1.4)


def test_columns():
    assert X.text_column(["a", "content", "question"]) == "question"
    assert X.column_like(["模型输入Human", "b"], "human") == "模型输入Human"
    with pytest.raises(ValueError):
        X.text_column(["a"])
