"""DuckDB SQL of the queries that SQL can express."""

MIX_BODY = r"""
counted AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM docs),
sized AS (SELECT *, (size - size % (10 ** greatest(length(size::VARCHAR) - 2, 0))::BIGINT)::DOUBLE AS x FROM counted),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM per_source),
levels AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (
  SELECT source, source_size,
         CASE WHEN max(level) FILTER (WHERE level * w < cap) OVER () IS NULL THEN cap
              ELSE least(cap, max(level) FILTER (WHERE level * w < cap) OVER () * w) END AS target FROM levels),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS m FROM targets),
parts AS (SELECT *, floor(m)::BIGINT AS whole, m - floor(m) AS f, target - floor(m) * source_size AS rest FROM shares),
classes AS (
  SELECT source, x, sum(size)::BIGINT AS words FROM sized WHERE size > 0 GROUP BY source, x),
sums AS (
  SELECT c.source, x, words, sum(words) OVER (PARTITION BY c.source) - sum(words) OVER (PARTITION BY c.source ORDER BY x) AS above, rest,
         sum(x * words) OVER (PARTITION BY c.source ORDER BY x) AS xs FROM classes c JOIN parts p ON c.source IS NOT DISTINCT FROM p.source),
scaled AS (SELECT *, (rest - above) / xs AS c FROM sums),
odds AS (
  SELECT source, coalesce(max(x) FILTER (WHERE c * x < 1), 0.0) AS top, coalesce(arg_max(c, x) FILTER (WHERE c * x < 1), 0.0) AS c,
         coalesce(arg_max(above, x) FILTER (WHERE c * x < 1), sum(words)) AS sure FROM scaled GROUP BY source),
drawn AS (
  SELECT s.*, p.source_size, p.target, p.whole, rest - sure AS rest, s.x > top AS certain, least(greatest(c * x, 1e-12), 1 - 1e-12) AS p
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN odds o ON s.source IS NOT DISTINCT FROM o.source),
ranked AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rnk FROM drawn),
running AS (
  SELECT *, coalesce(sum(CASE WHEN certain THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rnk, doc_id, size, hash(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked),
mixed AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + (CASE WHEN certain OR before < rest AND 2 * (rest - before) >= size THEN 1 ELSE 0 END) END AS copies FROM running)
"""

ORACLES = {
    "op6_pareto_mix": "WITH docs AS (SELECT * FROM documents)," + MIX_BODY + "SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed",
}

_WORDS = r"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _components(k: int, num: int, items: str) -> str:
    """CTEs from items (id, text) to comp (id, comp, n): components of sets of k-word shingles with similarity num / 100."""
    return f"""
item AS ({items}),
word AS (SELECT id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM item),
shingle AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS s FROM word),
size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE 100 * c >= {num} * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS id, b AS other FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.other = e.a),
comp AS (SELECT word.id, least(word.id, min(other)) AS comp, coalesce(any_value(n), 0) AS n FROM word LEFT JOIN reach ON reach.id = word.id LEFT JOIN size ON size.id = word.id GROUP BY word.id)
"""


ORACLES["op10_jaccard_join"] = "WITH RECURSIVE " + _components(4, 85, "SELECT doc_id AS id, text FROM documents") + "SELECT id AS doc_id, n AS n_shingles, comp AS component_id FROM comp"

#: Exact pairs of all lines, which the banding finds at the threshold with a chance of 0.9995; and passages of 20 words from anchors.
ORACLES["op9_paragraph_minhash"] = (
    "WITH RECURSIVE paragraph AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE text IS NOT NULL),"
    + _components(5, 80, f"SELECT doc_id * 100000 + p AS id, text FROM paragraph WHERE len({_WORDS.format(x='text')}) >= 20")
    + f""",
pdoc AS (SELECT doc_id, {_WORDS.format(x="text")} AS w FROM documents WHERE text IS NOT NULL),
pword AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS i, md5(unnest(w)) AS h FROM pdoc),
near AS (SELECT *, min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b FROM pword),
anchor AS (SELECT doc_id, i FROM near WHERE i + 20 <= n AND (i = 0 OR i + 20 = n OR ((a IS NULL OR h < a) AND (b IS NULL OR h <= b)))),
passage AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) AS k FROM anchor JOIN pdoc USING (doc_id)),
kept AS (SELECT k, min(doc_id * 100000 + i) AS f FROM passage GROUP BY k HAVING count(DISTINCT doc_id) > 1),
shared AS (SELECT doc_id, i, f, doc_id != f // 100000 AS removed FROM passage JOIN kept USING (k)),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, removed ORDER BY i) AS g FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, removed ORDER BY i) + 20 THEN 0 ELSE 1 END AS new FROM shared))
SELECT 'line' AS kind, comp.id // 100000 AS doc_id, comp.id % 100000 AS place, len(w) AS n_words, comp // 100000 AS kept_doc_id, comp % 100000 AS kept_place, comp.id != comp AS removed
 FROM comp JOIN word USING (id) WHERE comp IN (SELECT comp FROM comp GROUP BY comp HAVING count(*) > 1)
UNION ALL SELECT 'passage', doc_id, min(i), max(i) + 20 - min(i), arg_min(f, i) // 100000, arg_min(f, i) % 100000, removed FROM run GROUP BY doc_id, removed, g"""
)

ORACLES["op4_suffix_bpr_dedup"] = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), len AS (SELECT doc_id, x, length(x) // 2 AS n FROM doc),
start AS (SELECT doc_id, unnest(range(0, greatest(n - 49, 0))) AS i, x FROM len),
string AS (SELECT doc_id, i, md5(substr(x, i * 2 + 1, 100)) AS s FROM start), least_ AS (SELECT s, min(doc_id) AS m FROM string GROUP BY s),
hit AS (SELECT doc_id, i FROM string JOIN least_ USING (s) WHERE m < doc_id),
island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM hit)),
gone AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM island GROUP BY doc_id, g),
edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM gone),
part AS (SELECT doc_id, string_agg(substr(x, before * 2 + 1, (a - before) * 2), '' ORDER BY a) AS head, max(b) AS last, count(*) AS n_spans, sum(b - a) AS removed FROM edge JOIN len USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, coalesce(last, 0) * 2 + 1))) AS kept_sha256 FROM len LEFT JOIN part USING (doc_id)"""

_ALNUM = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x != '')"


def _seeds(table: str, key: str) -> str:
    rows = []
    for k, mask in enumerate(("110110101", "1011001011")):
        kept = ", ".join(f"w[i + {1 + j}]" for j, c in enumerate(mask) if c == "1")
        rows.append(f"SELECT {key}, i, {k} AS mask, [{kept}] AS seed FROM {table}, LATERAL (SELECT unnest(range(0, len(w) - {len(mask) - 1})) AS i)")
    return " UNION ALL ".join(rows)


ORACLES["op8_spaced_seed_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
ds AS ({_seeds("d", "doc_id")}), bs AS ({_seeds("b", "item_id")}),
hit AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS diagonal FROM ds JOIN bs USING (mask, seed)),
pair AS (SELECT doc_id, item_id, len(b.w) AS n, list_transform(range(1, len(b.w) + 1), lambda i: CASE WHEN i + diagonal >= 1 AND d.w[i + diagonal] = b.w[i] THEN 1 ELSE 0 END) AS e FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
judged AS (SELECT doc_id, item_id, n, list_sum(e) AS equal, list_max(list_transform(range(1, n - least(n, 13) + 2), lambda i: list_sum(e[i:i + least(n, 13) - 1]))) / least(n, 13) AS best FROM pair)
SELECT doc_id, item_id, max(n)::INT AS n_words, max(equal)::INT AS n_equal, max(best) AS best FROM judged WHERE best >= 0.75 GROUP BY ALL"""


ORACLES["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS least_id FROM d),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(tox, false) AS tox,
      (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
      || (CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x) THEN 'C' ELSE '' END)
      || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least_id THEN 'E' ELSE '' END) AS bad
      FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS tox FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
step AS (SELECT f.*, filter_order, s AS step, substr(filter_order, s, 1) AS filter, CASE WHEN bad = '' THEN false ELSE regexp_matches(substr(filter_order, 1, s - 1), '[' || bad || ']') END AS gone
         FROM f, orders, (SELECT unnest(range(1, 6))::INT AS s) t),
r AS (SELECT part, filter_order, step, filter, count(*) FILTER (WHERE NOT gone AND NOT contains(bad, filter)) AS kept, count(*) FILTER (WHERE NOT gone AND contains(bad, filter)) AS removed,
      count(*) FILTER (WHERE gone AND contains(bad, filter)) AS redundant, count(*) FILTER (WHERE bad = filter) AS unique_fails,
      count(*) FILTER (WHERE NOT gone AND contains(bad, filter) AND good) AS good_lost, count(*) FILTER (WHERE NOT gone AND contains(bad, filter) AND tox) AS toxic_lost
      FROM step GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r"""
