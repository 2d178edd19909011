"""Text expressions: cleaning, validity, rule-based quality, labels and prompts. All are Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's \s has it, in a form that Java and RE2 read alike.
WS = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Spam keywords.
SPAM = ("广告", "推广", "加微信", "VX", "扫码", "点击链接", "http://", "https://", "www.", ".com", ".cn", "￥", "$$$", "免费领取", "限时优惠")
# Keywords of the life-insurance domain.
DOMAIN = ("寿险", "终身寿险", "定期寿险", "保险", "保障", "理赔", "受益人", "保额", "保费", "投保", "保单", "身故", "全残", "责任", "现金价值")
# What marks an answer as about life insurance, or as a refusal.
LIFE = ("寿险", "life insurance", "定期寿", "终身寿")
REFUSAL = ("抱歉", "只能回答寿险", "无法回答", "不能回答", "超出我的能力范围", "我不清楚")
# Column names that may hold the text, in order of preference.
TEXT_COLUMNS = ("text", "query", "question", "content", "message")


def text_column(columns: list[str]) -> str:
    """The first of TEXT_COLUMNS that is there."""
    for c in TEXT_COLUMNS:
        if c in columns:
            return c
    raise ValueError(f"no text column among {columns}")


def column_like(columns: list[str], *parts: str) -> str:
    """The first column whose lower-cased name contains one of the parts."""
    for c in columns:
        if any(p in c.lower() for p in parts):
            return c
    raise ValueError(f"no column like {parts} among {columns}")


# The same characters, one by one.
WS_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean_text(x: Column) -> Column:
    """Runs of white space (WS) become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.translate(x, WS_CHARS, " " * len(WS_CHARS)), " {2,}", " "))


def normal_key(x: Column) -> Column:
    """Key form of a text: no white space, lower case; null is ''."""
    return F.lower(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), WS, ""))


def _once(x: Column, test) -> Column:
    """test(x), with x bound once: a filter that is pushed below the projection of x would repeat it for every use."""
    return F.exists(F.array(x), test)


def contains_any(x: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def valid_length(x: Column, least: int = 3, most: int = 500) -> Column:
    return F.length(x).between(least, most)


def valid_format(x: Column) -> Column:
    """Some letter, digit or underscore of any script; no control and no replacement character."""
    return x.rlike(r"[\p{L}\p{N}_]") & ~x.rlike(r"[\x00-\x1f\x{FFFD}]")


def is_spam(x: Column, words=SPAM, compat: bool = True) -> Column:
    """Lower-cased text contains a keyword. compat keeps keywords as they are, so those with capitals never match."""
    return _once(F.lower(x), lambda low: contains_any(low, words if compat else [w.lower() for w in words]))


def acceptable(x: Column, least: int = 3, most: int = 500, words=SPAM, compat: bool = True) -> Column:
    """All tests of a cleaned text, cheapest first; null is not acceptable."""
    return _once(x, lambda y: y.isNotNull() & valid_length(y, least, most) & valid_format(y) & ~is_spam(y, words, compat))


def cleaned(x: Column, least: int = 3, most: int = 500, words=SPAM, compat: bool = True) -> Column:
    """The cleaned text in an array, empty if it is not acceptable: exploded, it cleans and filters rows in one pass over the text."""
    return F.filter(F.array(clean_text(x)), lambda y: acceptable(y, least, most, words, compat))


def density_score(x: Column, script: str = r"[\x{4e00}-\x{9fff}]") -> Column:
    """Mean of a length score (full from 10 to 200) and the share of characters of the script."""
    n = F.length(x)
    size = F.when(n < 10, n / 10.0).when(n <= 200, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 200) / 300.0))
    share = (n - F.length(F.regexp_replace(x, f"(?:{script})+", ""))) / F.greatest(n, F.lit(1))
    return (size + share) / 2.0


def grammar_score(x: Column) -> Column:
    """0.3 for inner punctuation, 0.3 for a final question mark, 0.4 for no run of 3 odd characters; 1 at most."""
    odd = r"[^\x{4e00}-\x{9fff}a-zA-Z0-9]{3,}"
    score = F.when(x.rlike("[，。！？、；：]"), 0.3).otherwise(0.0) + F.when(F.substring(x, -1, 1).isin("？", "?"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(x.rlike(odd), 0.0).otherwise(0.4))


def relevance_score(x: Column, words=DOMAIN) -> Column:
    """By the number of distinct keywords contained: 0, 0.5, 0.75, then 1."""
    hits = F.lit(0)
    for w in words:
        hits = hits + x.contains(w).cast("int")
    return F.when(hits == 0, 0.0).when(hits == 1, 0.5).when(hits == 2, 0.75).otherwise(1.0)


def quality_score(x: Column, words=DOMAIN, script: str = r"[\x{4e00}-\x{9fff}]") -> Column:
    return relevance_score(x, words) * 0.4 + density_score(x, script) * 0.3 + grammar_score(x) * 0.3


def importance(freq: Column) -> Column:
    return F.when(freq >= 10, "高频").when(freq >= 2, "中频").otherwise("低频")


def joined_prompt(system: Column, human: Column) -> Column:
    """System text, a space and human text; human text alone if there is no system text."""
    system, human = (F.coalesce(c.cast("string"), F.lit("")) for c in (system, human))
    return F.when(system != "", F.concat(system, F.lit(" "), human)).otherwise(human)


def binary_label(answer: Column) -> Column:
    return F.when(contains_any(F.lower(F.coalesce(answer, F.lit(""))), LIFE), 1).otherwise(0)


def ternary_label(answer: Column, compat: bool = True) -> Column:
    """1 life insurance, 0 refusal, 2 other. compat tests for life insurance first; else refusals come first."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    life, refusal = contains_any(low, LIFE), contains_any(low, REFUSAL)
    return F.when(life, 1).when(refusal, 0).otherwise(2) if compat else F.when(refusal, 0).when(life, 1).otherwise(2)


def keyword_coverage(x: Column, words) -> list[Column]:
    """For each keyword, the percentage of texts that contain it (null: does not)."""
    return [(F.avg(F.coalesce(x.contains(w), F.lit(False)).cast("double")) * 100).alias(w) for w in words]
