"""Joins, set operations, conflicts, splits and merges over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import normal_key
from curatrix.operators.frequency import running_total
from curatrix.operators.sampling import _within, draw_key, ratio_sample
from curatrix.operators.written import cut

# Fixed value: file name of questions that no file has.
NOT_FOUND = "未找到"


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_on(df: DataFrame, ref: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join on a text key where nulls match each other; other columns that both have get _ref on the right."""
    ref = ref.select(*[F.col(c).alias(f"{c}_ref" if c in df.columns and c != key else c) for c in ref.columns])
    a = df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("nan")))
    return a.join(ref.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("nan"))), key, how)


def exclude(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in other; rows of a null key stay."""
    return df.join(other.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def exclude_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that are in no way a row of other (all columns, nulls equal); every copy goes."""
    right = other.select(*[F.col(c).alias(f"x_{c}") for c in df.columns]).distinct()
    return df.join(right, reduce(lambda a, b: a & b, [df[c].eqNullSafe(right[f"x_{c}"]) for c in df.columns]), "left_anti")


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def _keyed(df: DataFrame, text: str, name: str) -> DataFrame:
    """df plus the key form of a text, without rows whose key is empty. The key is made once for each row: Spark doesn't push filters and join keys below explode, where they would repeat it."""
    keys = F.filter(F.array(normal_key(F.col(text))), lambda k: k != "")
    return df.select("*", F.explode(keys).alias(name))


def locate(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each question (seq, question) stands in sources (file, file_ord, row_no, question, answer): all matches by normalised text, or one row of NOT_FOUND."""
    q = _keyed(questions, "question", "k_")
    s = _keyed(sources, "question", "sk_").select("sk_", "file", "file_ord", "row_no", F.col("question").alias("found_question"), F.col("answer").alias("found_answer"))
    out = q.join(s, F.col("k_") == F.col("sk_"), "left")
    return out.select("seq", "question", F.coalesce("file", F.lit(NOT_FOUND)).alias("file"), "file_ord", "row_no", "found_question", "found_answer")


def conflicts(qa: DataFrame, question: str = "question", answer: str = "answer", source: str = "source", order: str = "ord") -> DataFrame:
    """Questions with more than one answer, by normalised text.

    One row for each answer: group_no (rank of the question), n_answers, question
    and answer as first met, all sources in order, and the number of rows.
    """
    digest = lambda c: F.unhex(F.sha2(F.col(c).cast("binary"), 256))
    t = _keyed(qa, question, "qk_").withColumn("ak_", F.explode(F.array(normal_key(F.col(answer))))).withColumns({"hq_": digest("qk_"), "ha_": digest("ak_")})
    # Questions in conflict are found by hashes alone; only their rows go on with texts.
    pairs = t.groupBy("hq_", "ha_").agg(F.count(F.lit(1)).alias("n_rows"))
    many = cut(pairs.groupBy("hq_").agg(F.count(F.lit(1)).alias("n_answers")).filter("n_answers > 1"))
    rows = cut(t.join(many, "hq_").drop("ak_"))
    sources = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, source))), lambda x: x[source]), ", ")
    per = rows.groupBy("hq_", "ha_").agg(F.min_by(question, order).alias("question"), F.min_by(answer, order).alias("answer"), F.count(F.lit(1)).alias("n_rows"), F.max("n_answers").alias("n_answers"), sources.alias("sources"))
    # Numbers come from a range-partitioned order of the questions in conflict.
    numbers = running_total(rows.groupBy("hq_").agg(F.first("qk_").alias("qk_")), ["qk_"], None, "before_").select("hq_", (F.col("before_") + 1).alias("group_no"))
    return per.join(numbers, "hq_").select("group_no", "n_answers", "question", "answer", "sources", "n_rows")


def annotator_conflicts(responses: DataFrame) -> DataFrame:
    """Records (id) whose annotators' last submitted values differ: id, n_users, n_values. responses: (id, pos, user_id, status, question_name, value)."""
    r = responses.filter("status = 'submitted' AND question_name = 'label' AND value IS NOT NULL")
    last = r.groupBy("id", "user_id").agg(F.max_by("value", "pos").alias("value"))
    return last.groupBy("id").agg(F.count(F.lit(1)).alias("n_users"), F.countDistinct("value").alias("n_values")).filter("n_users >= 2 AND n_values > 1")


def conflict_cards(conflicting: DataFrame, responses: DataFrame, users: DataFrame) -> DataFrame:
    """(id, card): an HTML list of each annotator and value; the name of a user or the first 8 characters of the id; escaped."""
    r = responses.filter("status = 'submitted' AND question_name = 'label' AND value IS NOT NULL").groupBy("id", "user_id").agg(F.max_by("value", "pos").alias("value"))
    r = r.join(conflicting.select("id"), "id", "left_semi").join(users, "user_id", "left")

    def escape(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    line = F.concat(F.lit("<li>"), escape(F.coalesce("name", F.substring("user_id", 1, 8))), F.lit(": "), escape(F.col("value")), F.lit("</li>"))
    return r.groupBy("id").agg(F.concat(F.lit("<ul>"), F.array_join(F.array_sort(F.collect_list(line)), ""), F.lit("</ul>")).alias("card"))


def paired(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of two tables of equal length by row id, columns with _a and _b."""
    left = a.select(key, *[F.col(c).alias(f"{c}_a") for c in a.columns if c != key])
    right = b.select(key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    return left.join(right, key)


def leakage(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """One row for each set and pair: rows, internal duplicates, rows in common, and whether all is clean."""
    sets = {"train": train, "val": val, "test": test}
    cols = train.columns
    rows = []
    for name, df in sets.items():
        one = df.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n_"))
        rows.append(one.agg(F.lit(name).alias("check"), F.coalesce(F.sum("n_"), F.lit(0)).cast("long").alias("n_rows"), (F.coalesce(F.sum("n_"), F.lit(0)) - F.count(F.lit(1))).cast("long").alias("n_bad")))
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        both = common_rows(sets[a].select(*cols), sets[b].select(*cols))
        rows.append(both.agg(F.lit(f"{a}&{b}").alias("check"), F.count(F.lit(1)).cast("long").alias("n_rows"), F.count(F.lit(1)).cast("long").alias("n_bad")))
    out = union_all(rows)
    return out.withColumn("clean", F.col("n_bad") == 0)


def merge_and_filter(a: DataFrame, b: DataFrame, c: DataFrame, exclusion: DataFrame, key: str = "msg", freq: str = "frequency", order: str = "ord") -> DataFrame:
    """a and b, rows of c of frequency at most 1; first row of each key; keys of the exclusion table go."""
    from curatrix.operators.frequency import keep_first

    if freq in c.columns:
        c = c.filter(F.col(freq) <= 1)
    return exclude(keep_first(union_all([a, b, c]), [key], [order]), exclusion, key)


def split_tables(base: DataFrame, pool: DataFrame, label: str, key: str, n: int, test_share: float, seed: int = 42) -> dict[str, DataFrame]:
    """train, val, test: n rows of the pool in the ratio of labels, of each label int(count * test_share) test and the rest validation; train is the base and what is left of the pool."""
    picked = ratio_sample(pool, n, label, key, seed)
    per = picked.groupBy(F.col(label).alias("s_")).agg(F.floor(F.count(F.lit(1)) * F.lit(test_share)).alias("quota"))
    test = _within(picked, per, label, [draw_key(key, seed + 1), F.col(key)])
    val = picked.join(test.select(key), key, "left_anti")
    left = exclude_rows(pool, picked)
    return {"train": union_all([base, left]), "val": val, "test": test}


def product_rows(df: DataFrame, source_col: str, output_col: str) -> DataFrame:
    """(pos, question, name, code): the name, the code, then each question of a product row; empty ones go."""
    from curatrix.functions.parse import embedded_questions, product_code, product_name

    x = F.col(source_col)
    t = df.select(product_name(x).alias("name"), product_code(x).alias("code"), embedded_questions(F.col(output_col)).alias("qs"))
    return t.select("name", "code", F.posexplode(F.concat(F.array("name", "code"), "qs")).alias("pos", "question")).filter("question IS NOT NULL AND trim(question) != ''")


def similar_questions(df: DataFrame, standard: str = "标问", similar: str = "相似问") -> DataFrame:
    """(pos, standard, question): the standard question, then each of its packed variants; sentinels '', 'nan' and '0' go."""
    bad = F.trim("question").isin("", "nan", "0")
    t = df.filter(F.col(standard).isNotNull()).select(F.trim(standard).alias("standard"), F.posexplode(F.concat(F.array(F.col(standard)), F.split(F.coalesce(F.col(similar), F.lit("")), r"\|"))).alias("pos", "question"))
    return t.filter(~bad).withColumn("question", F.trim("question"))


def intents(df: DataFrame, msg: str = "msg", flag: str = "是否为寿险意图") -> DataFrame:
    """(msg, intent, unknown): the flag's synonyms mapped; unknown marks values that no list has."""
    from curatrix.functions.parse import intent_of, unknown_intent

    x = F.coalesce(F.col(flag).cast("string"), F.lit("nan"))
    return df.filter(~F.trim(F.coalesce(F.col(msg), F.lit("nan"))).isin("", "nan", "0")).select(F.trim(msg).alias("msg"), intent_of(x).alias("intent"), unknown_intent(x).alias("unknown"))
