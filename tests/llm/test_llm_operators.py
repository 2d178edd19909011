"""Training-data operators against brute force on small tables with nulls, empties, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import ann_ads, ctw, decontam, jaccard_join, mix_pareto, nbsvm, ordinal, paragraph_minhash, pii_crf, setlinks, suffix_bpr
from curatrix.llm.common import lbfgs, pack, shingles, unpack, word_hashes
from curatrix.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empties, a long text and repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, line = text(60), text(25)
    rows = []
    for i in range(n):
        t = text(r.randint(1, 120))
        if i % 5 == 1:
            t = t[: len(t) // 2] + "\n" + passage + "\n" + t[len(t) // 2 :]
        if i % 7 == 2:
            t = line + "\n" + t
        if i % 9 == 3 and rows:
            t = rows[-1][1] or ""
        if i % 9 == 4 and rows:
            w = (rows[-1][1] or "x y z").split(" ")
            w[r.randrange(len(w))] = "Changed"
            t = " ".join(w)
        rows.append((i, t, "en", f"src{i % 4}", len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", None, 0), (n + 2, " \t\n", "en", "src0", 3), (n + 3, "é" * 70 + " ünï", "de", "src1", 74), (n + 4, text(4000), "en", "src1", 1), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [r.asDict() for r in df.collect()]


# plumbing


def test_blocks_and_hashes():
    a = np.arange(5)
    back = unpack(pack(a, b"xyz"))
    assert np.array_equal(np.frombuffer(back[0], np.int64), a) and bytes(back[1]) == b"xyz"
    texts = ["Ab cd\tab  CD ", "", "x", "ab"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, c = word_hashes(raw, off)
    assert c.tolist() == [4, 0, 1, 1] and h[0] == h[2] == h[5] and h[1] == h[3] and h[4] != h[0]
    assert shingles(h, c, 2)[1].tolist() == [3, 0, 1, 1]
    assert lbfgs(lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3)), np.zeros(4)) == pytest.approx(np.full(4, 3.0), abs=1e-3)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert {x["node"]: x["comp"] for x in got(components(spark.createDataFrame(edges, "a long, b long")))} == want
    assert got(components(spark.createDataFrame([], "a long, b long"))) == []


# op1

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_base_spans_match_plain_patterns():
    r = random.Random(1)
    for _ in range(20000):
        s = "".join(r.choice("a@.1+- (9_x25é") for _ in range(r.randint(0, 30)))
        b = pii_crf.base_spans(s)
        assert b["email"] == [m.span() for m in EMAIL.finditer(s)]
        assert b["ip"] == [m.span() for m in IP.finditer(s) if all(int(p) <= 255 for p in m[0].split("."))]
        assert b["phone"] == [m.span() for m in PHONE.finditer(s) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert b["card"] == [m.span() for m in CARD.finditer(s) if 16 <= sum(c.isdigit() for c in m[0]) <= 19 and pii_crf.luhn(re.sub("[^0-9]", "", m[0]))]


def test_field_on_held_out_table():
    field = pii_crf.train()
    held = pii_crf.training_table(120, seed=99)
    found = pii_crf.field_spans([t for t, _ in held], field)
    hits = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, held))
    assert hits / sum(len(b) for _, b in held) > 0.95 and hits / max(1, sum(map(len, found))) > 0.95
    # Cutting at tokens that can only be O changes nothing.
    whole = []
    for t, _ in held[:40]:
        tokens = [m[0] for m in pii_crf.TOKEN.finditer(t)]
        whole.append(field.decode([field.scores(tokens)])[0] if tokens else [])
    parts = [[(t, a) for seg in pii_crf.pieces(t, field) for t, a, _ in seg] for t, _ in held[:40]]
    assert all(len(p) <= len(w) for p, w in zip(parts, whole))
    for (t, _), w, spans in zip(held[:40], whole, found):
        assert (sum(1 for y in w if pii_crf.LABELS[y][:1] == "B") > 0) >= bool(spans)


def test_personal_data(spark, none):
    data = [(1, "mail a.b@x.org now", "en", "s", 1), (2, None, "en", "s", None), (3, "call +1 (456) 555-2186 or 10.0.0.256", "en", "s", 2), (3, "call +1 (456) 555-2186 or 10.0.0.256", "en", "s", 2)]
    out = sorted(got(pii_crf.personal_data(spark.createDataFrame(data, SCHEMA))), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_email"], r["n_ip"], r["n_phone"]) for r in out] == [(1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 1), (3, 0, 0, 1)]
    assert out[0]["base_sha256"] == hashlib.sha256(b"email:5:14").hexdigest() and out[1]["spans"] == ""
    red = {r["doc_id"]: r for r in got(pii_crf.redact(spark.createDataFrame(data, SCHEMA)))}
    assert red[1]["text"] == "mail [EMAIL] now" and red[1]["n_chars"] == 16 and red[2]["text"] is None
    assert got(pii_crf.personal_data(none)) == []


# op2


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16))
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, v[3].tolist()), (901, v[3].tolist()), (20, v[20].tolist()), (902, None), (903, [0.0] * 16), (904, [float("nan")] + [1.0] * 15), (905, [1.0]), (906, [None] + [1.0] * 15)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out = got(ann_ads.neighbours(df, F.col("vec_id") % 20 == 0))
    ids = np.array([d[0] for d in data[:703]])
    m = np.array([d[1] for d in data[:703]])
    hits = total = 0
    for q in set(i for i in ids.tolist() if i % 20 == 0):
        own = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])[:20]
        s = m @ m[np.flatnonzero(ids == q)[0]]
        ok = np.flatnonzero(ids != q)
        best = ok[np.lexsort((ids[ok], -s[ok]))[:20]]
        hits += len({ids[b] for b in best} & {r["vec_id"] for r in own})
        total += 20
        assert all(abs(r["score"] - float(m[np.flatnonzero(ids == r["vec_id"])[0]] @ m[np.flatnonzero(ids == q)[0]])) < 1e-9 for r in own)
    assert hits / total >= 0.9
    few = spark.createDataFrame(data[:5], "vec_id long, embedding array<double>")
    assert [r["rank"] for r in got(ann_ads.neighbours(few, F.col("vec_id") % 20 == 0))] == [1, 2, 3, 4]
    assert got(ann_ads.neighbours(few.filter("vec_id < 0"), F.col("vec_id") % 20 == 0)) == []


# op3 and op7


def labelled(spark, n=400):
    r = random.Random(5)
    base = corpus(2, n)
    docs = [(i, (t or "") + (" you stupid idiot clown " if r.random() < 0.3 else ""), la, s, c) for i, t, la, s, c in base[:n]]
    labels = [(i, 1 if len(t) > 200 else 0, int("idiot" in t)) for i, t, *_ in docs]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, none):
    docs, labels = labelled(spark)
    out = got(nbsvm.toxicity(docs, labels).join(labels.filter("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    assert got(nbsvm.toxicity(none, labels)) == []
    one = got(nbsvm.toxicity(docs.limit(3), labels.filter("toxic = 0")))
    assert len(one) == 3 and all(r["predicted"] == 0 for r in one)
    odd = spark.createDataFrame([(None, None), (7, ""), (7, "")], "doc_id long, text string")
    assert len(got(nbsvm.toxicity(odd, labels))) == 3


def test_distinct_slots():
    s = np.array([5, 3, 5, 9, 3], np.uint32)
    assert sorted(nbsvm.Distinct(4)(s).tolist()) == [3, 5, 9]


def test_ordinal(spark, none):
    docs, labels = labelled(spark)
    out = got(ordinal.quality(docs, labels).join(ordinal.grades_of(labels), "doc_id"))
    assert all(r["tail_1"] >= r["tail_2"] - 1e-12 and abs(r["expected_grade"] - r["tail_1"] - r["tail_2"]) < 1e-9 for r in out)
    mean = {g: np.mean([r["expected_grade"] for r in out if r["grade"] == g]) for g in (0, 2)}
    assert mean[2] > mean[0] + 0.5
    assert got(ordinal.quality(none, labels)) == []
    odd = spark.createDataFrame([(None, None), (7, "")], "doc_id long, text string")
    assert len(got(ordinal.quality(odd, labels.limit(0)))) == 2


# op4


def brute_dedup(rows, n=50):
    texts, first, out = [(i, (t or "").encode()) for i, t, *_ in rows], {}, []
    for i, b in texts:
        for j in range(len(b) - n + 1):
            k = b[j : j + n]
            first[k] = min(first.get(k, i), i)
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < i:
                gone[j : j + n] = b"\1" * n
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, rows, docs, none):
    extra = [(200, "ab" * 100, "en", "s", 1), (201, "xx" + "ab" * 60, "en", "s", 1), (202, "a" * 300, "en", "s", 1), (203, "a" * 55, "en", "s", 1)]
    df = docs.unionAll(spark.createDataFrame(extra, SCHEMA))
    assert sorted(tuple(r) for r in suffix_bpr.dedup(df).collect()) == brute_dedup([*rows, *extra])
    assert got(suffix_bpr.dedup(none)) == []
    null_id = spark.createDataFrame([(None, "q" * 60), (1, "q" * 60)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in got(suffix_bpr.dedup(null_id))} == {None: 0, 1: 60}


def test_refinement_buckets():
    r = random.Random(4)
    text = np.frombuffer(bytes(r.choice(b"ab") for _ in range(3000)) * 2, np.uint8)
    at = np.arange(len(text) - 50)
    bucket = suffix_bpr.refine(text, at, 50)
    names = {}
    for i in at.tolist():
        names.setdefault(text[i : i + 50].tobytes(), set()).add(bucket[i])
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)


# op5


def test_ctw(spark, rows, docs, none):
    out = {r["doc_id"]: r for r in got(ctw.scores(docs))}
    count, n = collections.Counter(), ctw.DEPTH
    words = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t)) + [None]
        words[i] = w
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(w)
    total, v = sum(count.values()), len(count)
    for i, w in words.items():
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((count[k] + 0.5) / (total + 0.5 * (v + 1))) for k in w), rel=1e-9)
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(w), sum(count[k] > 0 for k in w), total)
    bits = collections.Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            z = bytes(n) + (t or "").encode()
            for j in range(len(z) - n):
                y = z[j + n]
                for k in range(8):
                    for d in range(n + 1):
                        bits[z[j + n - d : j + n], (1 << k) | (y >> (8 - k)), (y >> (7 - k)) & 1] += 1
    kids = collections.defaultdict(set)
    for c, p, _ in bits:
        if c:
            kids[c[1:], p].add(c)
    kt = lambda c, p: math.lgamma(bits[c, p, 0] + 0.5) + math.lgamma(bits[c, p, 1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(bits[c, p, 0] + bits[c, p, 1] + 1)
    memo = {}

    def weight(c, p):
        if (c, p) not in memo:
            memo[c, p] = kt(c, p) if len(c) == n else np.logaddexp(math.log(0.5) + kt(c, p), math.log(0.5) + sum(weight(k, p) for k in kids[c, p]))
        return memo[c, p]

    for i in (2, 11, 63):
        text = (dict((r[0], r[1]) for r in rows)[i] or "").encode()
        z, want = bytes(n) + text, 0.0
        for j in range(len(text)):
            y = z[j + n]
            for k in range(8):
                p, bit, q = (1 << k) | (y >> (8 - k)), (y >> (7 - k)) & 1, None
                for d in range(n, -1, -1):
                    c = z[j + n - d : j + n]
                    a = bits[c, p, 0], bits[c, p, 1]
                    own = (a[bit] + 0.5) / (sum(a) + 1)
                    if q is None:
                        q = own
                    else:
                        b = math.exp(math.log(0.5) + kt(c, p) - weight(c, p))
                        q = b * own + (1 - b) * q
                want += math.log10(q)
        assert out[i]["score"] == pytest.approx(want, rel=1e-5)
    assert out[60]["score"] == 0 and got(ctw.scores(none)) == []


# op6


def test_mix(spark, docs, rows, none):
    out = got(mix_pareto.mix_report(docs))
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    per = collections.defaultdict(list)
    src = {(i, len(WORD.findall(t or ""))): s for i, t, _, s, _ in rows}
    for r in out:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
        per[src[r["doc_id"], r["size"]]].append(r)
    assert sum(v[0]["target"] for v in per.values()) == pytest.approx(1.5 * total)
    for v in per.values():
        s = sum(r["size"] for r in v)
        assert v[0]["source_size"] == s and v[0]["target"] <= 2 * s + 1e-9
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) / 2 + 1e-9
    assert sorted(map(str, out)) == sorted(map(str, got(mix_pareto.mix_report(docs.repartition(5)))))
    assert got(mix_pareto.mix_report(none)) == []


def test_mix_plans_each_step_once(spark, docs):
    """The driver's memory follows the size of a plan: the plan that holds the texts holds no step of the targets."""
    plan = mix_pareto.pareto_mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Join ") == 1


# op8


def test_decontamination(spark, none):
    r = random.Random(8)
    words = ["w%d" % i for i in range(2000)]
    items = [" ".join(r.choice(words) for _ in range(30)) for _ in range(10)]
    swapped = items[1].split()
    swapped[5] = swapped[17] = "other"
    docs = [(1, "x y " + items[0].upper() + " z"), (2, "a, b. " + " ".join(swapped)), (3, " ".join(r.choice(words) for _ in range(200))), (4, " ".join(items[2].split()[:8])), (5, None), (6, ""), (None, items[3]), (1, "x y " + items[0].upper() + " z")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seed", F.lit("clash"))
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "too short"), (0, items[0])], "item_id long, text string")
    out = got(decontam.leaks(d, b))
    assert sorted((str(x["doc_id"]), x["item_id"]) for x in out) == [("1", 0), ("2", 1), ("None", 3)]
    assert {x["item_id"]: x["n_equal"] for x in out} == {0: 30, 1: 28, 3: 30}
    assert sorted(got(decontam.leaks(d, b, max_broadcast=0)), key=str) == sorted(out, key=str)
    assert sorted(x["doc_id"] for x in got(decontam.clean(d, b))) == [3, 4, 5, 6]
    assert got(decontam.leaks(none, b)) == [] and got(decontam.leaks(d, b.limit(0))) == []


# op9 and op10


def components_of(sets, num):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * c >= num * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingle_set(t, k):
    w = WORD.findall(lower(t))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


@pytest.fixture(scope="module")
def groups():
    """Large groups of near copies, so that long lists occur."""
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(5000)]
    rows = corpus(3, 40)
    base = [r.choice(vocab) for _ in range(90)]
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((500 + i, " ".join(w), "en", "s", 1))
    return rows


def test_jaccard_join(spark, groups, none):
    df = spark.createDataFrame(groups, SCHEMA).repartition(3)
    sets = {i: shingle_set(t, 4) for i, t, *_ in groups}
    want = components_of(sets, 85)
    out = got(jaccard_join.linked_documents(df))
    assert len(out) == len(groups)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {i: (len(s), want[i]) for i, s in sets.items()}
    kept = [r["doc_id"] for r in got(jaccard_join.one_of_each(df, 4, 85))]
    assert set(kept) == set(want.values())
    assert got(jaccard_join.linked_documents(none)) == []


def long_list(spark, n):
    """n long texts that share a tenth of their shingles, as the members of two long lists."""
    r = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(200))
    texts = [(i, shared + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(1800))) for i in range(n)]
    rule = jaccard_join.jaccard_rule()
    table, _ = setlinks.items(spark.createDataFrame(texts, "doc_id long, text string"), rule, False)
    nodes = setlinks.materialize(table.select("sid", "doc_id", "para", "n", "cells", "fine"))
    return rule, nodes, nodes.select(F.explode(F.expr("array(5L, 9L)")).alias("list"), "sid", "n")


def test_long_lists_leave_only_pairs_that_fine_sketches_leave(spark):
    rule, nodes, lists = long_list(spark, 30)
    none = spark.createDataFrame([], "node long, comp long")
    for best in (True, False):
        assert setlinks.across(lists, nodes, none, rule, best).count() == 0


def test_long_lists_give_a_pair_once(spark):
    rule, nodes, _ = long_list(spark, 3)
    # Sizes and sketches of one text under three names: all pairs pass, in either list.
    one = nodes.orderBy("sid").limit(1).drop("sid")
    nodes = setlinks.materialize(one.crossJoin(spark.range(1, 4).withColumnRenamed("id", "sid")).select("sid", *one.columns))
    lists = nodes.select(F.explode(F.expr("array(9L, 5L)")).alias("list"), "sid", "n")
    none = spark.createDataFrame([], "node long, comp long")
    assert setlinks.met(lists, nodes, none, rule, False).count() == 3
    assert sorted(tuple(r) for r in setlinks.across(lists, nodes, none, rule, False).collect()) == [(1, 2, 5), (1, 3, 5), (2, 3, 5)]


def test_long_lists_are_cut_and_joined_before_sketches_are_sent(spark):
    # Lists 7, 3 and 8 have one set of members once 9, which no other fits, is gone; 4 holds one component; 6 has others.
    n = {1: 100, 2: 100, 5: 90, 9: 300}
    rows = [(k, s) for k, own in {7: (1, 2, 5, 9), 3: (1, 2, 5), 8: (5, 2, 1, 9), 4: (1, 2), 6: (1, 5)}.items() for s in own]
    named = spark.createDataFrame([(k, s, n[s], min(s, 3) if s != 2 else 1) for k, s in rows], "list long, sid long, n long, comp long")
    out = sorted((r["list"], r["sid"], r["n"], r["parts"]) for r in setlinks.crossing(named, 85).collect())
    assert out == [(3, 1, 100, 1), (3, 2, 100, 1), (3, 5, 90, 1), (6, 1, 100, 1), (6, 5, 90, 1)]


def test_long_lists_count_the_pairs_of_a_node(spark):
    # Node 1 meets 2 and 3, which do not meet; only a node with several pairs may have one that is nobody's nearest.
    rule, nodes, _ = long_list(spark, 3)
    one = nodes.orderBy("sid").limit(1).drop("sid")
    nodes = setlinks.materialize(one.crossJoin(spark.range(1, 4).withColumnRenamed("id", "sid")).select("sid", *one.columns))
    n = nodes.first()["n"]
    lists = spark.createDataFrame([(5, 1, n), (5, 2, n), (7, 1, n), (7, 2, n), (9, 1, n), (9, 3, n)], "list long, sid long, n int")
    none = spark.createDataFrame([], "node long, comp long")
    found = setlinks.met(lists, nodes, none, rule, True)
    assert {r["x"]: r["m"] for r in found.groupBy("x").agg(F.sum("mates").alias("m")).collect()} == {1: 2, 2: 1, 3: 1}


def test_prefix_and_boundary():
    assert [jaccard_join.prefix(n, 85, 1) for n in (1, 2, 7, 20)] == [1, 1, 2, 4]
    assert jaccard_join.boundary([(n, 1) for n in range(1, 100)], 85, 0.0) >= 6


def test_paragraphs(spark, groups, none):
    df = spark.createDataFrame(groups, SCHEMA).repartition(3)
    sets = {(i, j): shingle_set(p, 5) for i, t, *_ in groups for j, p in enumerate((t or "").split("\n")) if len(WORD.findall(p)) >= 20}
    want = components_of(sets, 80)
    size = collections.Counter(want.values())
    out = {(r["doc_id"], r["place"]): (r["kept_doc_id"], r["kept_place"]) for r in got(paragraph_minhash.clusters(df)) if r["kind"] == "line"}
    assert out == {k: v for k, v in want.items() if size[v] > 1}
    assert got(paragraph_minhash.clusters(none)) == []
    bands, rows_ = paragraph_minhash.tuned(0.8)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.999
    left = {r["doc_id"]: r["text"] for r in got(paragraph_minhash.without_copies(df))}
    gone = [k for k, v in want.items() if v != k]
    assert left[gone[0][0]].count("\n") < dict((r[0], r[1]) for r in groups)[gone[0][0]].count("\n") or left[gone[0][0]] == ""


def test_slots_of_slices():
    import pyarrow as pa

    texts = pa.array([f"Some Words {i} ÄÖ" for i in range(450)], pa.string())
    batch = pa.RecordBatch.from_pydict({"text": texts})
    whole = [sorted(s.tolist()) for s in nbsvm.document_slots(texts)]
    assert [sorted(s.tolist()) for b in nbsvm.sliced([batch], 200) for s in nbsvm.document_slots(b.column("text"))] == whole
    assert len({tuple(s) for s in whole}) == 450


def test_toxicity_ranks_held_out_rows_of_long_batches(spark):
    docs, labels = labelled(spark, 3000)
    out = got(nbsvm.toxicity(docs.coalesce(1), labels).filter("held_out").join(labels.filter("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id"))
    kind = [[r["score"] for r in out if r["toxic"] == y] for y in (0, 1)]
    assert min(map(len, kind)) > 200
    assert sum(a < b for a in kind[0] for b in kind[1]) > 0.95 * len(kind[0]) * len(kind[1])
