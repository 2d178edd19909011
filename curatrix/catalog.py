"""Registered queries of the curation operators and their DuckDB SQL.

Every query runs over its whole tables. Aggregates in floating point are rounded
to 6 digits on both sides, as engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import logits as L
from curatrix.functions import parse as P
from curatrix.functions import text as X
from curatrix.operators import audit, frequency, relational, sampling, stats, validators, vector_index, vectors
from curatrix.operators.written import new_folder

QUERIES: dict = {}
ORACLES: dict = {}

#: Words and letters that stand for the domain in the driver's tables, which have no Chinese.
WORDS = ("the ", "license", "tion", "password")
LATIN = r"[a-zA-Z]"
#: Longest text that counts as acceptable in these tables.
LONGEST = 5000


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("original_index"), "text", "lang", "source")


# SQL fragments
_WS = X.WS
CLEAN = f"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"
SPAM_SQL = " OR ".join(f"contains(lower(x), '{w}')" for w in X.SPAM)
OK_SQL = rf"x IS NOT NULL AND length(x) BETWEEN 3 AND {LONGEST} AND regexp_matches(x, '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(x, '[\x00-\x1f]') AND NOT regexp_matches(x, '\x{{FFFD}}') AND NOT ({SPAM_SQL})"
CLEANED = f"cleaned AS (SELECT original_index, x AS text FROM (SELECT doc_id AS original_index, {CLEAN} AS x FROM documents) WHERE {OK_SQL})"
FREQ = "freq AS (SELECT text, min(original_index) AS original_index, count(*) AS frequency FROM cleaned GROUP BY text)"
DENSITY = r"((CASE WHEN length(text) < 10 THEN length(text) / 10.0::DOUBLE WHEN length(text) <= 200 THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - (length(text) - 200) / 300.0::DOUBLE) END + (length(text) - length(regexp_replace(text, '[a-zA-Z]', '', 'g')))::DOUBLE / greatest(length(text), 1)) / 2.0::DOUBLE)"
GRAMMAR = r"least(1.0::DOUBLE, (CASE WHEN regexp_matches(text, '[，。！？、；：]') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN right(text, 1) IN ('？', '?') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN regexp_matches(text, '[^\x{4e00}-\x{9fff}a-zA-Z0-9]{3,}') THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END)"
_HITS = " + ".join(f"contains(text, '{w}')::INT" for w in WORDS)
RELEVANCE = f"(CASE {_HITS} WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END)"
QUALITY = f"({RELEVANCE} * 0.4::DOUBLE + {DENSITY} * 0.3::DOUBLE + {GRAMMAR} * 0.3::DOUBLE)"


def H(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key}::VARCHAR)"


def U(key: str, seed: int = 42) -> str:
    return f"((('0x' || substr({H(key, seed)}, 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0::DOUBLE)"


def cleaned(spark, d):
    return docs(spark, d).select("original_index", F.explode(X.cleaned(F.col("text"), 3, LONGEST)).alias("text"))


def quality():
    return X.quality_score(F.col("text"), WORDS, LATIN)


@query(f"WITH {CLEANED} SELECT * FROM cleaned")
def clean_filter(spark, d):
    return cleaned(spark, d)


@query(f"SELECT doc_id AS original_index, ({SPAM_SQL}) AS spam, regexp_matches(x, '[\\p{{L}}\\p{{N}}_]') AS has_word, length(x) AS n FROM (SELECT doc_id, {CLEAN} AS x FROM documents WHERE text IS NOT NULL)")
def spam_flags(spark, d):
    x = F.col("x")
    c = docs(spark, d).filter("text IS NOT NULL").select("original_index", X.clean_text(F.col("text")).alias("x"))
    return c.select("original_index", X.is_spam(x).alias("spam"), x.rlike(r"[\p{L}\p{N}_]").alias("has_word"), F.length(x).cast("long").alias("n"))


@query(f"WITH {CLEANED}, {FREQ} SELECT *, CASE WHEN frequency >= 10 THEN '高频' WHEN frequency >= 2 THEN '中频' ELSE '低频' END AS importance FROM freq")
def dedup_frequency(spark, d):
    return frequency.frequencies(cleaned(spark, d)).withColumn("importance", X.importance(F.col("frequency")))


@query("SELECT doc_id AS original_index, text, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def keep_first_dedup(spark, d):
    return frequency.keep_first(docs(spark, d), ["text"], ["original_index"])


@query(f"""WITH {CLEANED}, {FREQ} SELECT sum(frequency)::BIGINT AS total, count(*) AS n_unique, min(frequency) AS min_frequency, max(frequency) AS max_frequency, round(avg(frequency), 6) AS mean_frequency,
 median(frequency)::DOUBLE AS median_frequency, round(stddev_pop(frequency), 6) AS std_frequency, count(*) FILTER (frequency >= 10) AS n_high, count(*) FILTER (frequency >= 2 AND frequency < 10) AS n_middle, count(*) FILTER (frequency < 2) AS n_low,
 round(count(*) / sum(frequency), 6) AS unique_ratio, CASE WHEN count(*) / sum(frequency) < 0.5 THEN 'sqrt' WHEN count(*) / sum(frequency) < 0.8 THEN 'log' ELSE 'linear' END AS smoothing_advice, max(frequency) > 100 AS cap_advised FROM freq""")
def freq_report(spark, d):
    r = frequency.frequency_report(frequency.frequencies(cleaned(spark, d)))
    return r.withColumns({c: F.round(c, 6) for c in ("mean_frequency", "std_frequency", "unique_ratio")})


@query(f"WITH {CLEANED}, {FREQ} SELECT original_index, least(frequency, 3) AS frequency, round(sqrt(least(frequency, 3)) / sum(sqrt(least(frequency, 3))) OVER (), 9) AS weight FROM freq WHERE frequency >= 1")
def frequency_weights(spark, d):
    f = frequency.capped(frequency.frequencies(cleaned(spark, d)), 1, 3)
    return frequency.weights(f).select("original_index", F.col("frequency").cast("long").alias("frequency"), F.round("weight", 9).alias("weight"))


@query(f"WITH {CLEANED} SELECT original_index, round({DENSITY}, 9) AS density, round({GRAMMAR}, 9) AS grammar, round({RELEVANCE}, 9) AS relevance, round({QUALITY}, 9) AS quality FROM cleaned")
def quality_score(spark, d):
    x = F.col("text")
    r9 = lambda c: F.round(c, 9)
    return cleaned(spark, d).select("original_index", r9(X.density_score(x, LATIN)).alias("density"), r9(X.grammar_score(x)).alias("grammar"), r9(X.relevance_score(x, WORDS)).alias("relevance"), r9(quality()).alias("quality"))


@query(f"WITH {CLEANED}, {FREQ} SELECT original_index, frequency, round({QUALITY}, 9) AS quality FROM freq ORDER BY round({QUALITY}, 9) DESC, original_index LIMIT 100")
def topk_quality(spark, d):
    f = frequency.frequencies(cleaned(spark, d)).select("original_index", "frequency", F.round(quality(), 9).alias("quality"))
    return sampling.top_k(f, 100, "quality", "original_index")


@query(f"SELECT doc_id AS original_index FROM documents ORDER BY {H('doc_id')}, doc_id LIMIT 200")
def uniform_sample(spark, d):
    return sampling.uniform_sample(docs(spark, d), 200, "original_index").select("original_index")


@query(f"WITH {CLEANED}, {FREQ} SELECT original_index, frequency FROM freq ORDER BY -ln({U('original_index')}) / sqrt(frequency), original_index LIMIT 200")
def weighted_sample(spark, d):
    f = frequency.frequencies(cleaned(spark, d))
    return sampling.weighted_sample(f, 200, "original_index", frequency.smoothed(F.col("frequency"))).select("original_index", "frequency")


def _stratified_sql(strategy: str) -> str:
    goal = {"balanced": "floor(rest / k)", "proportional": "floor(rest * size / total)", "hybrid": "floor(rest / k) + floor(size::DOUBLE / total * rest * 0.3::DOUBLE)"}[strategy]
    return f"""WITH base AS (SELECT doc_id AS original_index, source FROM documents), sizes AS (SELECT source, count(*) AS size FROM base GROUP BY source),
 a AS (SELECT *, least(5, size) AS n1, count(*) OVER () AS k, sum(size) OVER () AS total, greatest(150 - sum(least(5, size)) OVER (), 0) AS rest FROM sizes),
 b AS (SELECT *, greatest(least({goal}, size - n1, 9 - n1), 0) AS n2 FROM a), c AS (SELECT *, sum(n2) OVER () AS sum2 FROM b),
 e AS (SELECT *, CASE WHEN sum2 > rest THEN floor(n2 * (rest / sum2)) ELSE n2 END AS n2b FROM c), f AS (SELECT *, rest - sum(n2b) OVER () AS miss, size - n1 - n2b AS avail FROM e),
 g AS (SELECT source, n1 + n2b + greatest(0, least(avail, miss - coalesce(sum(avail) OVER (ORDER BY size DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM f)
 SELECT original_index, source FROM (SELECT base.*, quota, row_number() OVER (PARTITION BY base.source ORDER BY -ln({U('original_index')}), original_index) AS r FROM base JOIN g ON base.source IS NOT DISTINCT FROM g.source) WHERE r <= quota"""


@query(_stratified_sql("balanced"))
def stratified_balanced(spark, d):
    return sampling.stratified_sample(docs(spark, d), 150, "source", "original_index", "balanced", 5, 9).select("original_index", "source")


@query(_stratified_sql("proportional"))
def stratified_proportional(spark, d):
    return sampling.stratified_sample(docs(spark, d), 150, "source", "original_index", "proportional", 5, 9).select("original_index", "source")


@query(_stratified_sql("hybrid"))
def stratified_hybrid(spark, d):
    return sampling.stratified_sample(docs(spark, d), 150, "source", "original_index", "hybrid", 5, 9).select("original_index", "source")


@query(f"""WITH r AS (SELECT doc_id AS original_index, lang, row_number() OVER (PARTITION BY lang ORDER BY {H('doc_id')}, doc_id) <= 30 AS first FROM documents),
 m AS (SELECT 120 - count(*) FILTER (first) AS miss, count(*) FILTER (NOT first) AS rest FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY {H('original_index')}, original_index) AS k FROM r)
 SELECT original_index, lang FROM f, m WHERE first OR (miss <= rest AND k <= miss)""")
def simple_stratified(spark, d):
    return sampling.simple_stratified(docs(spark, d), 120, 4, "lang", "original_index").select("original_index", "lang")


@query(f"""WITH {CLEANED}, {FREQ}, a AS (SELECT * FROM freq ORDER BY -ln({U('original_index')}) / sqrt(frequency), original_index LIMIT 80), b AS (SELECT * FROM freq WHERE original_index NOT IN (SELECT original_index FROM a) ORDER BY {H('original_index', 43)}, original_index LIMIT 20)
 SELECT original_index, frequency FROM a UNION ALL SELECT original_index, frequency FROM b""")
def freq_aware_sample(spark, d):
    f = frequency.frequencies(cleaned(spark, d))
    return sampling.frequency_aware_sample(f, 100, "original_index").select("original_index", "frequency")


@query(f"""WITH r AS (SELECT doc_id AS original_index, lang, row_number() OVER (PARTITION BY lang ORDER BY {H('doc_id')}, doc_id) AS r, 60 // (SELECT count(DISTINCT lang) FROM documents) AS each FROM documents)
 SELECT original_index, lang FROM r ORDER BY (r > each)::INT, {H('original_index')}, original_index LIMIT 60""")
def diversity_sample(spark, d):
    return sampling.diversity_sample(docs(spark, d).filter("lang IS NOT NULL"), 60, "lang", "original_index").select("original_index", "lang")


@query(f"""WITH base AS (SELECT vec_id, label, round(ln(1 + abs(embedding[1]::DOUBLE)), 9) AS score FROM embeddings), q AS (SELECT label, greatest(3, floor(60 * count(*) / sum(count(*)) OVER ()))::BIGINT AS quota FROM base GROUP BY label),
 q2 AS (SELECT label, CASE WHEN sum(quota) OVER () > 60 THEN greatest(3, floor(quota * 60 / sum(quota) OVER ())) ELSE quota END AS quota FROM q),
 r AS (SELECT base.*, row_number() OVER (PARTITION BY base.label ORDER BY score DESC, vec_id) AS r, quota FROM base JOIN q2 USING (label))
 SELECT vec_id, label, score FROM r ORDER BY (r > quota)::INT, CASE WHEN r <= quota THEN label END, CASE WHEN r <= quota THEN r END, score DESC, vec_id LIMIT 60""")
def cluster_balanced_topk(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label", F.round(F.ln(1 + F.abs(F.get("embedding", F.lit(0)).cast("double"))), 9).alias("score"))
    return sampling.cluster_balanced_top(e, 60, "label", "score", "vec_id")


@query(f"SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id')}, doc_id) AS r, floor(50 * count(*) OVER (PARTITION BY quality) / count(*) OVER ()) AS quota FROM labels) WHERE r <= quota")
def ratio_sample(spark, d):
    return sampling.ratio_sample(t(spark, d, "labels"), 50, "quality", "doc_id").select("doc_id", "quality")


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
 SELECT doc_id, quality, CASE WHEN r <= floor(n * 0.1::DOUBLE) THEN 'test' WHEN r <= floor(n * 0.1::DOUBLE) + floor(n * 0.135::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r""")
def split_train_val_test(spark, d):
    parts = {"test": 0.1, "val": 0.135, "train": 0.765}
    return sampling.stratified_split(t(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", parts)


@query("""WITH s AS (SELECT doc_id % 3 AS k, text, lang FROM documents), n AS (SELECT k, count(*) AS n_rows FROM s GROUP BY k), u AS (SELECT k, count(*) AS m FROM (SELECT DISTINCT * FROM s) GROUP BY k),
 one AS (SELECT CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS "check", n_rows, n_rows - m AS n_bad FROM n JOIN u USING (k)), d AS (SELECT DISTINCT * FROM s),
 two AS (SELECT a.k AS i, b.k AS j, count(*) AS c FROM d a JOIN d b ON a.k < b.k AND a.text IS NOT DISTINCT FROM b.text AND a.lang IS NOT DISTINCT FROM b.lang GROUP BY ALL), p(name, i, j) AS (VALUES ('train&val', 0, 1), ('train&test', 0, 2), ('val&test', 1, 2))
 SELECT *, n_bad = 0 AS clean FROM (SELECT * FROM one UNION ALL SELECT name, coalesce(c, 0), coalesce(c, 0) FROM p LEFT JOIN two USING (i, j))""")
def leakage_check(spark, d):
    x = t(spark, d, "documents")
    part = lambda r: x.filter(F.col("doc_id") % 3 == r).select("text", "lang")  # noqa: E731  three sets that together are the whole table
    return relational.leakage(part(0), part(1), part(2))


@query(f"""WITH x AS (SELECT lower(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS q, lower(regexp_replace(coalesce(source, ''), '{_WS}', '', 'g')) AS a, text, source, doc_id FROM documents), p AS (SELECT q, a, arg_min(text, doc_id) AS question, arg_min(source, doc_id) AS answer, count(*) AS n_rows, string_agg(source, ', ' ORDER BY doc_id) AS sources FROM x WHERE q != '' GROUP BY q, a),
 m AS (SELECT q, count(*) AS n_answers, dense_rank() OVER (ORDER BY encode(q)) AS group_no FROM p GROUP BY q HAVING count(*) > 1) SELECT group_no, n_answers, question, answer, sources, n_rows FROM p JOIN m USING (q)""")
def conflict_groups(spark, d):
    x = docs(spark, d).withColumn("s", F.col("source"))
    out = relational.conflicts(x, "text", "source", "s", "original_index")
    return out.withColumn("group_no", F.col("group_no").cast("long"))


@query("""WITH r AS (SELECT user_id % 50 AS id, user_id, event_type AS value, event_id AS pos FROM events WHERE event_type IS NOT NULL), l AS (SELECT id, user_id, arg_max(value, pos) AS value FROM r GROUP BY id, user_id) SELECT id, count(*) AS n_users, count(DISTINCT value) AS n_values FROM l GROUP BY id HAVING count(*) >= 2 AND count(DISTINCT value) > 1""")
def annotator_conflict(spark, d):
    r = t(spark, d, "events").select((F.col("user_id") % 50).alias("id"), F.col("event_id").alias("pos"), "user_id", F.lit("submitted").alias("status"), F.lit("label").alias("question_name"), F.col("event_type").alias("value"))
    return relational.annotator_conflicts(r)


@query(f"""WITH k AS (SELECT item_id AS seq, text AS question, lower(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS k FROM benchmark UNION ALL SELECT 1000000 + doc_id, text, lower(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) FROM documents WHERE lang = 'es'),
 s AS (SELECT source AS file, doc_id AS row_no, text AS found_question, lang AS found_answer, lower(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS k FROM documents) SELECT seq, coalesce(file, '未找到') AS file, row_no FROM k LEFT JOIN s ON k.k = s.k AND s.k != '' WHERE k.k != ''""")
def locate_left_join(spark, d):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("seq"), F.col("text").alias("question"))
    q = q.unionAll(t(spark, d, "documents").filter("lang = 'es'").select((F.col("doc_id") + 1000000).alias("seq"), F.col("text").alias("question")))
    s = t(spark, d, "documents").select(F.col("source").alias("file"), F.lit(0).alias("file_ord"), F.col("doc_id").alias("row_no"), F.col("text").alias("question"), F.col("lang").alias("answer"))
    return relational.locate(q, s).select("seq", "file", "row_no")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join_exclude(spark, d):
    other = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.exclude(t(spark, d, "customer"), other, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, quality, toxic FROM labels WHERE NOT EXISTS (SELECT 1 FROM labels l2 WHERE l2.toxic = 1 AND l2.quality IS NOT DISTINCT FROM labels.quality AND l2.doc_id IS NOT DISTINCT FROM labels.doc_id)")
def anti_join_rows(spark, d):
    x = t(spark, d, "labels")
    return relational.exclude_rows(x, x.filter("toxic = 1"))


@query("SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_labels(spark, d):
    x = relational.join_on(t(spark, d, "documents").select("doc_id", "n_chars"), t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("""WITH c AS (SELECT msg, ord FROM (SELECT text AS msg, doc_id AS ord, count(*) OVER (PARTITION BY text) AS f FROM documents) WHERE f <= 1), u AS (SELECT text AS msg, conv_id * 1000 + turn AS ord FROM conversations UNION ALL SELECT msg, ord FROM c)
 SELECT msg, min(ord) AS ord FROM u WHERE msg IS NULL OR msg NOT IN (SELECT text FROM conversations WHERE role = 'system' AND text IS NOT NULL) GROUP BY msg""")
def merge_filter(spark, d):
    conv = t(spark, d, "conversations").select(F.col("text").alias("msg"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "role")
    x = t(spark, d, "documents")
    f = x.groupBy("text").agg(F.count(F.lit(1)).alias("frequency"), F.min("doc_id").alias("ord")).select(F.col("text").alias("msg"), "ord", "frequency")
    return relational.merge_and_filter(conv.select("msg", "ord"), conv.select("msg", "ord").limit(0), f, conv.filter("role = 'system'")).select("msg", "ord")


@query("""SELECT event_id, (props->>'$.k')::INT AS k, props IS NOT NULL AND NOT json_valid(props) AS broken FROM events""")
def json_parse(spark, d):
    x = F.col("props")
    return t(spark, d, "events").select("event_id", P.json_fields(x, "k int")["k"].alias("k"), P.broken_json(x).alias("broken"))


@query("""SELECT conv_id, turn, CASE WHEN coalesce(s, '') != '' THEN s || ' ' || coalesce(h, '') ELSE coalesce(h, '') END AS prompt FROM (SELECT a.conv_id, a.turn, a.text AS h, b.text AS s FROM conversations a LEFT JOIN (SELECT conv_id, min(text) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) b USING (conv_id) WHERE a.role = 'user')""")
def prompt_concat(spark, d):
    c = t(spark, d, "conversations")
    system = c.filter("role = 'system'").groupBy("conv_id").agg(F.min("text").alias("s"))
    return c.filter("role = 'user'").join(system, "conv_id", "left").select("conv_id", "turn", X.joined_prompt(F.col("s"), F.col("text")).alias("prompt"))


@query("""SELECT CASE WHEN contains(a, '寿险') OR contains(a, 'life insurance') OR contains(a, '定期寿') OR contains(a, '终身寿') THEN 1 ELSE 0 END AS binary_label, CASE WHEN contains(a, '寿险') OR contains(a, 'life insurance') THEN 1 WHEN contains(a, '抱歉') OR contains(a, '我不清楚') THEN 0 ELSE 2 END AS ternary_label, doc_id FROM
 (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN '寿险 ' WHEN 1 THEN '抱歉 ' WHEN 2 THEN 'LIFE insurance ' ELSE '' END || coalesce(text, '')) AS a FROM documents)""")
def answer_labels(spark, d):
    k = F.col("doc_id") % 4
    a = F.concat(F.when(k == 0, "寿险 ").when(k == 1, "抱歉 ").when(k == 2, "LIFE insurance ").otherwise(""), F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select(X.binary_label(a).alias("binary_label"), X.ternary_label(a).alias("ternary_label"), "doc_id")


@query("""SELECT doc_id, pos::INT AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL) WHERE trim(line) != ''""")
def explode_fanout(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return x.filter(F.trim("line") != "")


@query("SELECT label AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM embeddings GROUP BY label")
def value_shares(spark, d):
    return stats.value_counts(t(spark, d, "embeddings"), "label").withColumn("share", F.round("share", 9))


@query("""WITH s AS (SELECT label, count(*) AS n FROM embeddings WHERE label != -1 GROUP BY label), p AS (SELECT n, n / sum(n) OVER () AS p FROM s)
 SELECT count(*) AS n_clusters, min(n) AS size_min, max(n) AS size_max, round(avg(n), 6) AS size_mean, round(stddev_pop(n), 6) AS size_std, round(sum(-p * ln(p + 1e-10)), 6) AS entropy, CASE WHEN count(*) > 1 THEN round(sum(-p * ln(p + 1e-10)) / ln(count(*)), 6) ELSE 0.0 END AS normalized_entropy FROM p""")
def cluster_balance(spark, d):
    r = stats.cluster_sizes(t(spark, d, "embeddings"), "label")
    return r.withColumns({c: F.round(c, 6) for c in ("size_mean", "size_std", "entropy", "normalized_entropy")})


@query("SELECT *, covered / active AS coverage FROM (SELECT count(DISTINCT label) FILTER (embedding[1] > 0.2::FLOAT) AS covered, count(DISTINCT label) AS active FROM embeddings)")
def entropy_coverage(spark, d):
    e = t(spark, d, "embeddings")
    return stats.coverage(e.filter(F.get("embedding", F.lit(0)) > F.lit(0.2).cast("float")), e, "label")


_STAT6 = ("mean", "std", "q25", "median", "q75")


@query("SELECT min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q75 FROM documents")
def score_statistics(spark, d):
    return stats.score_stats(t(spark, d, "documents"), "n_chars").withColumns({c: F.round(c, 6) for c in _STAT6})


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def energy_profile(spark, d):
    r = stats.quantile_profile(t(spark, d, "events"), "event_type", "value")
    return r.withColumns({c: F.round(c, 6) for c in r.columns if c not in ("event_type", "n")})


_LOGITS = "[embedding[1]::DOUBLE * 10, embedding[2]::DOUBLE * 10, embedding[3]::DOUBLE * 10]"
_LSE = "(list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))))"


def logits_table(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", "label", F.array(*[F.get("embedding", F.lit(i)).cast("double") * 10 for i in range(3)]).alias("z"))


@query(f"SELECT vec_id, round(exp(z[1] - {_LSE}), 9) AS p0, list_position(z, list_max(z)) - 1 AS guess, round(exp(list_max(z) - {_LSE}), 9) AS confidence, round(-{_LSE}, 9) AS energy, CASE WHEN -{_LSE} > -1.5 THEN 'low' WHEN -{_LSE} < -2.5 THEN 'high' ELSE 'medium' END AS reason FROM (SELECT vec_id, {_LOGITS} AS z FROM embeddings)")
def softmax_energy(spark, d):
    x = audit.predictions(logits_table(spark, d), "z", -2.5, -1.5)
    return x.select("vec_id", F.round(L.softmax(F.col("z"))[0], 9).alias("p0"), L.argmax(F.col("z")).alias("guess"), F.round("confidence", 9).alias("confidence"), F.round("energy", 9).alias("energy"), "reason")


@query(f"""WITH e AS (SELECT -{_LSE} AS e FROM (SELECT {_LOGITS} AS z FROM embeddings)) SELECT 'conservative' AS name, round(quantile_cont(e, 0.1), 6) AS low, round(quantile_cont(e, 0.99), 6) AS high FROM e UNION ALL SELECT 'moderate', round(quantile_cont(e, 0.25), 6), round(quantile_cont(e, 0.95), 6) FROM e
 UNION ALL SELECT 'aggressive', round(quantile_cont(e, 0.5), 6), round(quantile_cont(e, 0.9), 6) FROM e UNION ALL SELECT 'std_2', round(avg(e) - stddev_pop(e), 6), round(avg(e) + 2 * stddev_pop(e), 6) FROM e UNION ALL SELECT 'std_3', round(avg(e) - stddev_pop(e), 6), round(avg(e) + 3 * stddev_pop(e), 6) FROM e""")
def energy_thresholds(spark, d):
    x = logits_table(spark, d).withColumn("energy", L.energy(F.col("z")))
    return audit.energy_thresholds(x).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("""WITH e AS (SELECT value AS e, event_type IN (SELECT min(event_type) FROM events) AS ood FROM events), s AS (SELECT min(e) AS lo, max(e) AS hi, count(*) FILTER (NOT ood) AS ni, count(*) FILTER (ood) AS no FROM e), g AS (SELECT i AS step, lo + (hi - lo) / 99 * i AS threshold, ni, no FROM s, range(100) r(i))
 SELECT step::INT AS step, round(threshold, 6) AS threshold, round(count(*) FILTER (NOT ood AND e < threshold) / any_value(ni), 9) AS tpr, round(count(*) FILTER (ood AND e >= threshold) / any_value(no), 9) AS tnr FROM g, e GROUP BY step, threshold""")
def energy_ood_search(spark, d):
    ev = t(spark, d, "events")
    first = ev.agg(F.min("event_type").alias("m"))
    x = ev.join(F.broadcast(first)).select(F.col("value").alias("energy"), (F.col("event_type") == F.col("m")).alias("is_ood"))
    return audit.energy_search(x).select("step", F.round("threshold", 6).alias("threshold"), F.round("tpr", 9).alias("tpr"), F.round("tnr", 9).alias("tnr"))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 1 AND toxic != 1) AS only_a, count(*) FILTER (quality != 1 AND toxic = 1) AS only_b, count(*) FILTER (quality != 1 AND toxic != 1) AS neither, round(count(*) FILTER ((quality = 1) = (toxic = 1)) * 100.0 / count(*), 6) AS agree_percent FROM labels")
def agreement(spark, d):
    x = t(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return stats.agreement(x, "a", "b").withColumn("agree_percent", F.round("agree_percent", 6))


@query("""WITH r AS (SELECT l_quantity AS a, l_extendedprice AS b, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb FROM lineitem) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r""")
def correlation(spark, d):
    r = stats.correlations(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return r.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n")


@query("""WITH c AS (SELECT quality AS t, toxic AS g, count(*) AS n FROM labels GROUP BY ALL), l AS (SELECT DISTINCT t AS label FROM c UNION SELECT g FROM c),
 m AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE t = label), 0)::BIGINT AS support, coalesce((SELECT sum(n) FROM c WHERE g = label), 0) AS guessed, coalesce((SELECT sum(n) FROM c WHERE g = label AND t = label), 0) AS hits FROM l)
 SELECT label, support, round(CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END, 9) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 9) AS recall, round(CASE WHEN hits > 0 THEN 2.0 * hits / (guessed + support) ELSE 0 END, 9) AS f1 FROM m""")
def confusion_prf(spark, d):
    r = stats.class_metrics(t(spark, d, "labels"), "quality", "toxic")
    return r.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""WITH s AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents) SELECT least(floor((n_chars - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM documents, s GROUP BY 1""")
def histogram(spark, d):
    return stats.histogram(t(spark, d, "documents"), "n_chars", 30)


@query("""WITH q AS (SELECT event_type AS label, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
 SELECT label, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM events JOIN q ON event_type = label GROUP BY label""")
def boxplot(spark, d):
    r = stats.box_stats(t(spark, d, "events"), "event_type", "value")
    return r.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "low", "high")})


@query("SELECT " + ", ".join(f"round(avg(coalesce(contains(text, '{w}'), false)::INT) * 100, 6) AS k{i}" for i, w in enumerate(WORDS)) + " FROM documents")
def keyword_coverage(spark, d):
    r = t(spark, d, "documents").agg(*X.keyword_coverage(F.col("text"), WORDS))
    return r.select(*[F.round(F.col(f"`{w}`"), 6).alias(f"k{i}") for i, w in enumerate(WORDS)])


@query("""SELECT count(*) AS n_rows, count(*) - count(text) AS n_null, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty, count(*) FILTER (length(text) < 3) AS n_short, count(*) FILTER (length(text) > 500) AS n_long, round(avg(length(text)), 6) AS mean_length, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS n_duplicates FROM documents""")
def integrity(spark, d):
    return stats.integrity(t(spark, d, "documents"), "text").withColumn("mean_length", F.round("mean_length", 6))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS chunk_id FROM orders")
def chunk_split(spark, d):
    return frequency.chunked(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000)


_VEC = "v AS (SELECT vec_id, label AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), cp AS (SELECT cluster, i, avg(v[i]) AS x, count(*) AS n FROM v, range(1, 65) r(i) GROUP BY cluster, i), c AS (SELECT cluster, list(x ORDER BY i) AS c, max(n) AS size FROM cp GROUP BY cluster)"
_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i]))))"


def vecs(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), L.doubles(F.col("embedding")).alias("v"))


@query(f"WITH {_VEC}, d AS (SELECT v.cluster, size, {_DIST} AS d FROM v JOIN c USING (cluster)) SELECT cluster, any_value(size) AS size, round(avg(d), 6) AS mean_distance, round(1 / (avg(d) + 1e-6), 6) AS density, round(max(d), 6) AS diameter FROM d GROUP BY cluster")
def centroid_stats(spark, d):
    r = vectors.cluster_shape(vecs(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("mean_distance", "density", "diameter")})


@query(f"WITH {_VEC}, s AS (SELECT v.cluster, avg({_DIST}) AS s FROM v JOIN c USING (cluster) GROUP BY v.cluster), p AS (SELECT a.cluster AS i, (sa.s + sb.s) / sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.c[i] - b.c[i]) * (a.c[i] - b.c[i])))) AS r FROM c a JOIN c b ON a.cluster != b.cluster JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster) SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT max(r) AS r FROM p GROUP BY i)")
def davies_bouldin(spark, d):
    return vectors.davies_bouldin(vecs(spark, d)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"WITH {_VEC}, m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS x FROM v, range(1, 65) r(i) GROUP BY i)), b AS (SELECT sum(size * list_sum(list_transform(range(1, 65), lambda i: (c[i] - m[i]) * (c[i] - m[i])))) AS b, count(*) AS k, sum(size) AS n FROM c, m), w AS (SELECT sum(({_DIST}) ** 2) AS w FROM v JOIN c USING (cluster)) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w")
def calinski_harabasz(spark, d):
    return vectors.calinski_harabasz(vecs(spark, d)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"""WITH s AS (SELECT vec_id, label AS c, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings ORDER BY {H('vec_id')}, vec_id LIMIT 300), d AS (SELECT a.vec_id AS k, a.c AS ca, b.c AS cb, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS d FROM s a JOIN s b ON a.vec_id != b.vec_id),
 m AS (SELECT k, ca, cb, avg(d) AS d FROM d GROUP BY ALL), r AS (SELECT k, max(CASE WHEN ca = cb THEN d END) AS a, min(CASE WHEN ca != cb THEN d END) AS b FROM m GROUP BY k) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM r""")
def silhouette(spark, d):
    return vectors.silhouette(vecs(spark, d), "vec_id", sample=300).select(F.round("silhouette", 6).alias("silhouette"))


@query(ORACLES["silhouette"].replace("LIMIT 300)", "LIMIT 1000)"))
def silhouette_1000(spark, d):
    return vectors.silhouette(vecs(spark, d), "vec_id").select(F.round("silhouette", 6).alias("silhouette"))


@query(f"WITH {_VEC.replace('SELECT vec_id, label AS cluster', 'SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS cluster').replace('FROM v, range(1, 65) r(i) GROUP BY cluster, i', 'FROM v, range(1, 65) r(i) WHERE cluster != -1 GROUP BY cluster, i')}, n AS (SELECT vec_id, arg_min(c.cluster, {_DIST}) AS cluster FROM v, c WHERE v.cluster = -1 GROUP BY vec_id) SELECT vec_id, coalesce(n.cluster, v.cluster)::INT AS cluster FROM v LEFT JOIN n USING (vec_id)")
def noise_reassign(spark, d):
    x = vecs(spark, d).withColumn("cluster", F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("cluster")))
    return vectors.without_noise(x, "vec_id").select("vec_id", "cluster")


def vector_store(spark, d):
    return vector_index.VectorIndex.create(vecs(spark, d), new_folder(spark), "vec_id", "v")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id) SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim > 0.4""")
def vector_neardup(spark, d):
    return vector_store(spark, d).near_pairs(0.4).withColumn("sim", F.round("sim", 6))


@query("""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v),
 p AS (SELECT b.vec_id, list(a.vec_id) AS before FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) > 0.4 GROUP BY b.vec_id),
 n AS MATERIALIZED (SELECT u.vec_id, row_number() OVER (ORDER BY u.vec_id) AS i, coalesce(before, []) AS before FROM u LEFT JOIN p ON p.vec_id = u.vec_id),
 g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT n.i, CASE WHEN len(list_intersect(kept, before)) > 0 THEN kept ELSE list_append(kept, vec_id) END FROM g JOIN n ON n.i = g.i + 1)
 SELECT unnest(kept) AS vec_id FROM g WHERE i = (SELECT max(i) FROM n)""")
def vector_greedy_dedup(spark, d):
    return vector_store(spark, d).deduplicated(0.4).withColumnRenamed("key", "vec_id")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v),
 p AS (SELECT a.vec_id AS query, b.vec_id AS key, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])), 9) AS sim FROM u a JOIN u b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, key) AS rank FROM p) SELECT query, rank::INT AS rank, key, sim FROM r WHERE rank <= 10""")
def vector_topk(spark, d):
    """The 10 nearest of every hundredth row among all, exactly: bounds on angles tell which lists of the kept index may hold them."""
    x = vecs(spark, d)
    return vector_store(spark, d).search(x.filter("vec_id % 100 = 0"), 10, "vec_id", "v", exact=True)


@query("SELECT vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 1 WHEN vec_id % 3 = 1 THEN 2 ELSE 3 END AS batch FROM embeddings")
def vector_append(spark, d):
    """The rows of an index that was made from a third of them and got the others in two batches, the last with rows that it had."""
    x = vecs(spark, d)
    index = vector_index.VectorIndex.create(x.filter("vec_id % 3 = 0"), new_folder(spark), "vec_id", "v")
    index.add(x.filter("vec_id % 3 = 1"), "vec_id", "v")
    index.add(x, "vec_id", "v")
    return index.rows().select("key", F.col("batch").cast("int").alias("batch"))


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term != '' GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
 voc AS (SELECT term, count(*) AS df, sum(tf) AS total, any_value(n) AS n FROM tf, n GROUP BY term HAVING count(*) >= 2 AND count(*) <= any_value(n) * 0.8 ORDER BY total DESC, encode(term) LIMIT 500), x AS (SELECT doc_id, term, tf, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN voc USING (term))
 SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def tfidf_sql(spark, d):
    return vectors.tfidf(t(spark, d, "documents"), "doc_id", max_features=500).withColumn("weight", F.round("weight", 6))


@query(ORACLES["tfidf_sql"].replace("LIMIT 500)", "LIMIT 5000)"))
def tfidf(spark, d):
    return vectors.tfidf(t(spark, d, "documents"), "doc_id").withColumn("weight", F.round("weight", 6))


@query(f"""WITH x AS (SELECT vec_id AS k, (label % 3)::INT AS y, list_transform(z, lambda v: exp(v - l)) AS p FROM (SELECT *, {_LSE} AS l FROM (SELECT vec_id, label, {_LOGITS} AS z FROM embeddings))),
 o AS (SELECT *, p[y + 1] AS own, (list_position(p, list_max(p)) - 1)::INT AS top FROM x), m AS (SELECT y, avg(own) AS t, count(*) AS n FROM o GROUP BY y),
 c AS (SELECT k, arg_max(m.y, struct_pack(a := p[m.y + 1], b := -m.y)) AS j FROM o, m WHERE p[m.y + 1] >= t GROUP BY k),
 joint AS (SELECT o.y, j, count(*) AS c, sum(count(*)) OVER (PARTITION BY o.y) AS r FROM o JOIN c USING (k) GROUP BY o.y, j), est AS (SELECT joint.y, j, c / r * n AS e FROM joint JOIN m ON m.y = joint.y WHERE joint.y != j),
 low AS (SELECT k FROM (SELECT k, n_class, row_number() OVER (PARTITION BY o.y ORDER BY own, k) AS r FROM o JOIN (SELECT y, round(sum(e)) AS n_class FROM est GROUP BY y) q ON q.y = o.y) WHERE r <= n_class),
 far AS (SELECT DISTINCT k FROM (SELECT k, round(e) AS n_pair, row_number() OVER (PARTITION BY o.y, j ORDER BY p[j + 1] - own DESC, k) AS r FROM o JOIN est ON est.y = o.y) WHERE r <= n_pair)
 SELECT k AS vec_id, y AS label, top AS guess, round(own, 9) AS quality_score, k IN (FROM low) AND k IN (FROM far) AND top != y AS is_issue FROM o""")
def label_issues(spark, d):
    x = logits_table(spark, d).select("vec_id", (F.col("label") % 3).alias("label"), L.softmax(F.col("z")).alias("probs"))
    return audit.label_issues(x, "vec_id", classes=3).withColumn("quality_score", F.round("quality_score", 9))


@query()
def model_compare(spark, d):
    base = logits_table(spark, d).select(F.col("vec_id").alias("row_id"), (F.col("label") % 3).alias("label"), "z")
    a = audit.label_issues(base.withColumn("probs", L.softmax(F.col("z"))), "row_id", classes=3)
    b = audit.label_issues(base.withColumn("probs", L.softmax(F.transform("z", lambda v: v * 0.5))), "row_id", classes=3)
    return audit.compare_reports(a, b)


@query()
def kmeans(spark, d):
    return vectors.kmeans(vecs(spark, d).drop("cluster"), "vec_id", 5)


@query()
def minibatch_kmeans(spark, d):
    return vectors.fit_predict(vecs(spark, d).drop("cluster"), "vec_id", "minibatch", 5)


@query()
def agglomerative(spark, d):
    return vectors.agglomerative(vecs(spark, d).drop("cluster"), "vec_id", 5)


@query()
def hdbscan(spark, d):
    return vectors.fit_predict(vecs(spark, d).drop("cluster"), "vec_id", "hdbscan", 5)


@query()
def hybrid_cluster(spark, d):
    return vectors.refined(vecs(spark, d).drop("cluster"), "vec_id", 5)


@query()
def cluster_evaluation(spark, d):
    return vectors.cluster_evaluation(vecs(spark, d), "vec_id")


@query(f"""WITH {CLEANED}, {FREQ}, x AS (SELECT text, {QUALITY} AS q, original_index % 20 AS c FROM freq), s AS (SELECT c, count(*) AS n FROM x GROUP BY c), p AS (SELECT n, n / sum(n) OVER () AS p FROM s),
 r AS (SELECT count(*) AS k, min(n) AS lo, max(n) AS hi, sum(n) AS n, sum(-p * ln(p + 1e-10)) / ln(count(*)) AS e FROM p), q AS (SELECT avg(q) AS q FROM x) SELECT name, round(value::DOUBLE, 6) AS value, threshold::DOUBLE AS threshold, CASE WHEN ok THEN 'PASS' ELSE bad END AS status FROM (
 SELECT 'sample_size' AS name, n::DOUBLE AS value, 15000 AS threshold, n >= 15000 AS ok, 'WARN' AS bad FROM r UNION ALL SELECT 'cluster_coverage', k / 20, 0.95, k / 20 >= 0.95, 'FAIL' FROM r UNION ALL SELECT 'diversity', e, 0.8, e >= 0.8, 'WARN' FROM r
 UNION ALL SELECT 'mean_quality', q, 0.5, q >= 0.5, 'WARN' FROM q UNION ALL SELECT 'cluster_balance', hi / n, 0.1, lo >= 3 AND hi / n <= 0.1, 'WARN' FROM r UNION ALL SELECT 'integrity', 0, 0, true, 'WARN')""")
def validator(spark, d):
    x = frequency.frequencies(cleaned(spark, d)).select("text", quality().alias("quality_score"), (F.col("original_index") % 20).alias("cluster_id"))
    return validators.sampling_checks(x, 20).withColumn("value", F.round("value", 6))


@query("SELECT count(*) AS n, count(*) FILTER (lang != '') AS labelled, count(*) FILTER (lang != '') / count(*) AS completeness, count(*) FILTER (lang != '') / count(*) >= 0.95 AS complete, count(*) FILTER (lang = 'en' AND length(text) < 5) AS short_positive FROM documents")
def annotation_quality(spark, d):
    r = validators.annotation_quality(t(spark, d, "documents"), "text", "lang", None, "en")
    return r.select("n", "labelled", "completeness", "complete", "short_positive")


@query("SELECT floor(count(*) * 0.85::DOUBLE)::BIGINT AS n_train, (count(*) - floor(count(*) * 0.85::DOUBLE))::BIGINT AS n_val, round(avg((quality = 1)::INT), 9) AS ratio, CASE WHEN avg((quality = 1)::INT) BETWEEN 0.3 AND 0.7 THEN 'balanced' WHEN avg((quality = 1)::INT) BETWEEN 0.2 AND 0.8 THEN 'acceptable' ELSE 'unbalanced' END AS balance FROM labels")
def split_advice(spark, d):
    return validators.split_advice(t(spark, d, "labels"), "quality", 1).withColumn("ratio", F.round("ratio", 9))


@query()
def sampling_pipeline(spark, d):
    from curatrix.plans import pipelines

    return pipelines.full(docs(spark, d), 100, 8, rules={"most": LONGEST}, words=WORDS, script=LATIN)


@query()
def simple_pipeline(spark, d):
    from curatrix.plans import pipelines

    return pipelines.simple(docs(spark, d), 100, 8, rules={"most": LONGEST}, words=WORDS, script=LATIN)


@query()
def secondary_pipeline(spark, d):
    from curatrix.plans import pipelines

    return pipelines.secondary(docs(spark, d), 100, 8, words=WORDS, script=LATIN)


# Parsing and conversion, on fields built from the tables


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'lang ' || lang END AS name, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS code FROM documents""")
def product_parse(spark, d):
    x = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("产品名称：lang "), "lang", F.lit("  产品代码： "), "source")).otherwise("none")
    return t(spark, d, "documents").select("doc_id", P.product_name(x).alias("name"), P.product_code(x).alias("code"))


@query("""SELECT doc_id, pos::INT AS pos, question FROM (SELECT doc_id, unnest([lang, source, 'q1 ' || source, 'q2']) AS question, unnest([0, 1, 2, 3]) AS pos FROM documents)""")
def product_fanout(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.concat(F.lit("产品名称："), "lang", F.lit(" 产品代码："), "source").alias("a"), F.concat(F.lit('1:{"questions":["q1 '), "source", F.lit('","q2"]}')).alias("b"))
    rows = relational.product_rows(x.withColumn("a", F.concat("a", F.lit("#"), F.col("doc_id").cast("string"))), "a", "b")
    return rows.select(F.regexp_extract("code", r"#(\d+)$", 1).cast("long").alias("doc_id"), "pos", F.regexp_replace("question", r"#\d+$", "").alias("question"))


@query("""SELECT standard, pos::INT AS pos, question FROM (SELECT 'd' || doc_id AS standard, unnest(['d' || doc_id, lang, source]) AS question, unnest([0, 1, 4]) AS pos FROM documents)""")
def similar_fanout(spark, d):
    x = t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("标问"), F.concat("lang", F.lit("|0||"), "source").alias("相似问"))
    return relational.similar_questions(x).select("standard", "pos", "question")


@query("""SELECT 'm' || doc_id AS msg, CASE doc_id % 5 WHEN 0 THEN '寿险意图' WHEN 1 THEN '寿险意图' ELSE '拒识' END AS intent, doc_id % 5 IN (3, 4) AS "unknown" FROM documents""")
def intent_map(spark, d):
    flag = F.element_at(F.array(*map(F.lit, ("是", "yes", "否", "Yes", "maybe"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return relational.intents(t(spark, d, "documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("msg"), flag.alias("flag")), "msg", "flag")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '寿险相关' WHEN 1 THEN '其他' END AS mapped, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS said, '判断问题是否与寿险相关，回答“寿险相关”或“其他”。' || chr(10) || '问题：' || lang || chr(10) || '答案：' || source AS prompt FROM documents""")
def label_map_and_answer(spark, d):
    k = F.col("doc_id")
    lab = F.element_at(F.array(*map(F.lit, ("寿险相关", "拒识", "未知"))), (k % 3 + 1).cast("int"))
    gen = F.concat(F.lit("答案：寿险相关\n答案： "), F.when(k % 2 == 0, "寿险相关").otherwise("其他"), F.lit("\n寿险相关"))
    return t(spark, d, "documents").select("doc_id", P.mapped_label(lab).alias("mapped"), P.answer_label(gen).alias("said"), P.instruction(F.col("lang"), F.col("source")).alias("prompt"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 0.8 WHEN 1 THEN 0.5 WHEN 2 THEN 0.1 WHEN 3 THEN 0.7 WHEN 4 THEN 0.7 ELSE 0.5 END::DOUBLE AS p1, CASE WHEN lang = 'en' THEN 0.2 WHEN lang = 'de' THEN 0.8 ELSE 0.5 END::DOUBLE AS p_word, round(exp(-n_chars / 1000.0), 9) AS p_log FROM documents""")
def response_parsing(spark, d):
    texts = ('{"probabilities":[0.2,0.8]}', '{"probabilities":[0.2,0.9]}', '{"prediction":0,"confidence":0.9}', '{"prediction":1}', '{"intent":"寿险"}', "no json")
    x = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % 6 + 1).cast("int"))
    word = F.when(F.col("lang") == "en", "拒识").when(F.col("lang") == "de", "寿险").otherwise("?")
    return t(spark, d, "documents").select("doc_id", F.round(P.response_probabilities(x)[1], 9).alias("p1"), P.word_answer_probabilities(word)[1].alias("p_word"), F.round(P.logprob_probability(-F.col("n_chars") / 1000.0), 9).alias("p_log"))


@query("""WITH x AS (SELECT text AS question, CASE toxic WHEN 1 THEN '其他' ELSE '寿险相关' END AS answer, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT question, arg_min(answer, doc_id) AS answer FROM x GROUP BY question""")
def training_conversion(spark, d):
    from curatrix.plans import pipelines

    lab = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "拒识").otherwise("寿险相关")).otherwise("")
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("text", lab.alias("label"), F.col("doc_id").alias("original_index"))
    return pipelines.training_format(x)


@query("""SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS first, round(least(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 9) AS least FROM embeddings""")
def unit_and_least(spark, d):
    v = L.doubles(F.col("embedding"))
    return t(spark, d, "embeddings").select("vec_id", F.round(L.unit(v)[0], 9).alias("first"), F.round(F.least(v[0], v[1]), 9).alias("least"))


@query("""SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""")
def union_by_name(spark, d):
    a = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return relational.union_all([a, t(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))])


@query("""SELECT text, lang FROM documents WHERE source < 'src2' INTERSECT SELECT text, lang FROM documents WHERE source >= 'src2'""")
def intersect_rows(spark, d):
    x = t(spark, d, "documents")
    return relational.common_rows(x.filter("source < 'src2'").select("text", "lang"), x.filter("source >= 'src2'").select("text", "lang"))


@query("""SELECT l.doc_id AS row_id, l.quality AS quality_a, n_chars AS n_chars_b FROM labels l JOIN documents USING (doc_id)""")
def row_pairing(spark, d):
    a = t(spark, d, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return relational.paired(a, t(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")).select("row_id", "quality_a", "n_chars_b")


@query("""WITH base AS (SELECT vec_id, label, round(ln(1 + abs(embedding[1]::DOUBLE)), 9) AS score FROM embeddings), q AS (SELECT label, greatest(3, floor(40 * count(*) / sum(count(*)) OVER ()))::BIGINT AS quota FROM base GROUP BY label),
 r AS (SELECT base.*, row_number() OVER (PARTITION BY base.label ORDER BY score DESC, vec_id) AS r, quota FROM base JOIN q USING (label)) SELECT vec_id, label FROM r ORDER BY (r > quota)::INT, CASE WHEN r <= quota THEN label END, CASE WHEN r <= quota THEN r END, score DESC, vec_id LIMIT 40""")
def secondary_topk(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label", F.round(F.ln(1 + F.abs(F.get("embedding", F.lit(0)).cast("double"))), 9).alias("score"))
    return sampling.cluster_balanced_top(e, 40, "label", "score", "vec_id", rescale=False).select("vec_id", "label")


@query("""WITH c AS (SELECT quality AS t, toxic AS g, count(*) AS n FROM labels GROUP BY ALL), l AS (SELECT DISTINCT t AS label FROM c UNION SELECT g FROM c),
 m AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE t = label), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE g = label), 0) AS guessed, coalesce((SELECT sum(n) FROM c WHERE g = label AND t = label), 0) AS hits FROM l),
 x AS (SELECT support, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r, CASE WHEN hits > 0 THEN 2.0 * hits / (guessed + support) ELSE 0 END AS f FROM m)
 SELECT (SELECT round(avg((quality = toxic)::INT), 6) FROM labels) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM x""")
def summary_metrics(spark, d):
    r = stats.summary_metrics(t(spark, d, "labels"), "quality", "toxic")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("""WITH l AS (SELECT user_id % 50 AS id, user_id, arg_max(event_type, event_id) AS value FROM events GROUP BY ALL), c AS (SELECT id FROM l GROUP BY id HAVING count(*) >= 2 AND count(DISTINCT value) > 1)
 SELECT id, '<ul>' || string_agg('<li>' || coalesce(replace(c_name, '#', '&amp;'), substr(user_id::VARCHAR, 1, 8)) || ': ' || value || '</li>', '' ORDER BY encode('<li>' || coalesce(replace(c_name, '#', '&amp;'), substr(user_id::VARCHAR, 1, 8)) || ': ' || value || '</li>')) || '</ul>' AS card FROM l JOIN c USING (id) LEFT JOIN (SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey % 2 = 0) USING (user_id) GROUP BY id""")
def conflict_cards(spark, d):
    r = t(spark, d, "events").select((F.col("user_id") % 50).alias("id"), F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("user_id"), F.lit("submitted").alias("status"), F.lit("label").alias("question_name"), F.col("event_type").alias("value"))
    users = t(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("user_id"), F.replace("c_name", F.lit("#"), F.lit("&")).alias("name"))
    return relational.conflict_cards(relational.annotator_conflicts(r), r, users)


@query("""SELECT event_id, user_id, (props->>'$.k')::INT AS k, c_mktsegment AS segment FROM events LEFT JOIN customer ON user_id = c_custkey""")
def merge_parse_join(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("user_id"), P.json_fields(F.col("props"), "k int")["k"].alias("k"))
    ref = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return relational.join_on(e, ref, "user_id", "left").withColumn("user_id", F.col("user_id").cast("long"))


@query("""SELECT source, count(*) AS n_rows, count(DISTINCT text) AS n_texts FROM documents GROUP BY source""")
def per_source_counts(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("text").alias("n_texts"))


@query(f"""WITH e AS (SELECT vec_id, -{_LSE} AS e FROM (SELECT vec_id, {_LOGITS} AS z FROM embeddings)), h AS (SELECT quantile_cont(e, 0.95) AS h FROM e) SELECT vec_id, round(e, 9) AS energy, e > h AS detected FROM e, h""")
def ood_detection(spark, d):
    x = logits_table(spark, d)
    return audit.ood_detection(x, x, "z").select("vec_id", F.round("energy", 9).alias("energy"), "detected")


_JOINED = "SELECT s.sale_id, coalesce(s.client_id::VARCHAR, 'nan') AS sale_client, s.status, c.client_id AS client, c.segment FROM sales s {how} JOIN clients c ON coalesce(s.client_id::VARCHAR, 'nan') = c.client_id::VARCHAR"


def _sales_with_clients(spark, d, how: str) -> DataFrame:
    """Sales beside the clients that they name, by the text of the id; ids of null or unknown clients are on one side only."""
    sales = t(spark, d, "sales").select("sale_id", F.col("client_id").alias("key"), "status")
    clients = t(spark, d, "clients").select(F.col("client_id").alias("key"), F.col("client_id").alias("client"), "segment")
    out = relational.join_on(sales, clients, "key", how)
    return out.select("sale_id", F.when(F.col("sale_id").isNotNull(), F.col("key")).alias("sale_client"), "status", "client", "segment")


@query(_JOINED.format(how=""))
def join_inner(spark, d):
    return _sales_with_clients(spark, d, "inner")


@query(_JOINED.format(how="RIGHT").replace("coalesce(s.client_id::VARCHAR, 'nan') AS", "CASE WHEN s.sale_id IS NOT NULL THEN coalesce(s.client_id::VARCHAR, 'nan') END AS"))
def join_right(spark, d):
    return _sales_with_clients(spark, d, "right")


@query(_JOINED.format(how="FULL").replace("coalesce(s.client_id::VARCHAR, 'nan') AS", "CASE WHEN s.sale_id IS NOT NULL THEN coalesce(s.client_id::VARCHAR, 'nan') END AS"))
def join_outer(spark, d):
    return _sales_with_clients(spark, d, "full")


@query("SELECT client_id, segment FROM clients WHERE client_id NOT IN (SELECT client_id FROM sales WHERE client_id IS NOT NULL)")
def anti_join_clients(spark, d):
    return relational.exclude(t(spark, d, "clients"), t(spark, d, "sales"), "client_id").select("client_id", "segment")


@query("""WITH c AS (SELECT msg, ord FROM (SELECT text AS msg, doc_id AS ord, count(*) OVER (PARTITION BY text) AS f FROM documents) WHERE f <= 1), u AS (SELECT text AS msg, conv_id * 1000 + turn AS ord FROM conversations UNION ALL SELECT text, item_id FROM benchmark UNION ALL SELECT msg, ord FROM c)
 SELECT msg, min(ord) AS ord FROM u WHERE msg IS NULL OR msg NOT IN (SELECT text FROM conversations WHERE role = 'system' AND text IS NOT NULL) GROUP BY msg""")
def merge_filter_tables(spark, d):
    conv = t(spark, d, "conversations").select(F.col("text").alias("msg"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "role")
    items = t(spark, d, "benchmark").select(F.col("text").alias("msg"), F.col("item_id").cast("long").alias("ord"))
    f = t(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("frequency"), F.min("doc_id").alias("ord")).select(F.col("text").alias("msg"), "ord", "frequency")
    return relational.merge_and_filter(conv.select("msg", "ord"), items, f, conv.filter("role = 'system'")).select("msg", "ord")


@query(f"WITH e AS (SELECT vec_id, (label % 3)::BIGINT AS label, {_LOGITS} AS z FROM embeddings) SELECT label, round(-{_LSE}, 9) AS x, round(exp(list_max(z) - {_LSE}), 9) AS y FROM e")
def scatter_pairs(spark, d):
    x = logits_table(spark, d).withColumn("label", (F.col("label") % 3).cast("long")).withColumn("e", F.round(L.energy(F.col("z")), 9)).withColumn("c", F.round(F.array_max(L.softmax(F.col("z"))), 9))
    return stats.scatter_pairs(x, "e", "c", "label")


@query()
def clustering_comparison(spark, d):
    """Evaluation of each clustering method on all vectors, and which one the largest silhouette recommends."""
    return vectors.compare_methods(vecs(spark, d).drop("cluster"), "vec_id", ["kmeans", "agglomerative", "hybrid"], 5)
