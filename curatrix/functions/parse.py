"""Parsing expressions: product fields, embedded JSON, label synonyms and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonyms of yes and no in label columns (exact case), and what they become.
YES = ("是", "YES", "yes", "Y", "y", "1", "True", "true")
NO = ("否", "NO", "no", "N", "n", "0", "False", "false")
INTENT, REFUSED = "寿险意图", "拒识"
# Labels of annotation and their names in training data.
LABEL_NAMES = {"寿险相关": "寿险相关", "拒识": "其他", "其他": "其他"}


# Patterns of a product's name and code in a prompt.
PRODUCT_NAME = r"产品名称[：:]\s*(.+?)\s+产品代码"
PRODUCT_CODE = r"产品代码[：:]\s*(.+?)$"


def or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def product_name(x: Column) -> Column:
    return or_null(F.regexp_extract(x, PRODUCT_NAME, 1))


def product_code(x: Column) -> Column:
    return or_null(F.trim(F.regexp_extract(x, PRODUCT_CODE, 1)))


def embedded_questions(x: Column) -> Column:
    """The questions of the JSON object inside a text; an empty array if there is none."""
    plain = F.regexp_replace(F.regexp_replace(x, r"\x{a0}", " "), r"[\x{200b}\x{feff}]", "")
    parsed = F.from_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0), "questions array<string>")
    return F.coalesce(parsed["questions"], F.array().cast("array<string>"))


def intent_of(x: Column) -> Column:
    return F.when(F.trim(x).isin(*YES), INTENT).otherwise(REFUSED)


def unknown_intent(x: Column) -> Column:
    return ~F.trim(x).isin(*YES, *NO)


def mapped_label(x: Column, names: dict[str, str] = LABEL_NAMES) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x)


def json_fields(x: Column, schema: str) -> Column:
    """A struct of fields of a JSON text; nulls where it doesn't parse."""
    return F.from_json(x, schema, {"mode": "PERMISSIVE"})


def broken_json(x: Column) -> Column:
    """A text that is there but is no JSON object."""
    return x.isNotNull() & F.try_parse_json(x).isNull()


def answer_label(x: Column) -> Column:
    """1 or 0 from a generated answer: the first line after the last answer mark decides; 0 if unclear."""
    last = F.element_at(F.split(x, "答案："), -1)
    line = F.split(F.trim(last), "\n")[0]
    return F.when(line.contains("寿险相关"), 1).otherwise(0)


def instruction(question: Column, answer: Column | None = None) -> Column:
    """A classification prompt; with the answer for training."""
    head = F.concat(F.lit("判断问题是否与寿险相关，回答“寿险相关”或“其他”。\n问题："), question, F.lit("\n答案："))
    return head if answer is None else F.concat(head, answer)


def response_probabilities(x: Column) -> Column:
    """[p0, p1] of a model's JSON answer: probabilities, else prediction with confidence, else prediction, else an intent in words, else even."""
    j = F.from_json(x, "probabilities array<double>, prediction int, confidence double, intent string, answer string")
    p, given, sure = j["probabilities"], j["prediction"], j["confidence"]
    fine = (F.size(p) == 2) & (F.abs(p[0] + p[1] - 1) < 0.01)
    pair = lambda one: F.array(1 - one, one)
    said = F.coalesce(j["intent"], j["answer"])
    return (
        F.when(fine, p)
        .when(given.isNotNull() & sure.isNotNull(), pair(F.when(given == 1, sure).otherwise(1 - sure)))
        .when(given.isNotNull(), pair(F.when(given == 1, 0.7).otherwise(0.3)))
        .when(said.isNotNull(), pair(F.when(said.contains("寿险"), 0.7).otherwise(0.3)))
        .otherwise(F.array(F.lit(0.5), F.lit(0.5)))
    )


def word_answer_probabilities(x: Column) -> Column:
    """[p0, p1] of an answer in words: refusals first."""
    refused = x.contains("拒识") | x.contains("其他")
    return F.when(refused, F.array(F.lit(0.8), F.lit(0.2))).when(x.contains("寿险"), F.array(F.lit(0.2), F.lit(0.8))).otherwise(F.array(F.lit(0.5), F.lit(0.5)))


def logprob_probability(x: Column) -> Column:
    return F.exp(x)
