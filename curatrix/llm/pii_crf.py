"""Personal data: fixed patterns plus a linear-chain conditional random field.

The base spans of four kinds come from fixed patterns, leftmost and not
overlapping within a kind; a match that fails its test is dropped.

The field adds spans. Its tokens are runs of non-space characters; the features
of a token are its word shape and cues, those of its neighbours, and the label
pair; it is trained by L-BFGS on a small labelled table (`training_table`, or any
table of (text, spans)) and decoded by Viterbi in numpy batches, padded by length.

The field is constrained: a token may get a label other than O only if it has a
digit or one of the signs in DOUBT, or is a cue word right before such a token
(`allowed`; training holds to it as well). All other tokens are O on every path,
so a text can be cut at them without changing the best path, and only segments
around doubtful tokens are decoded. A labelled table that labels plain words
lifts the constraint; then all tokens are decoded.

Defined results: null and empty texts have no spans; texts are decoded whole;
repeated rows give repeated results; an empty table gives an empty table. Added
spans never overlap a base span.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curatrix.llm.common import NULL_ID, id_array, lbfgs, sliced

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the field finds.
MORE_KINDS = ("secret",)
LABELS = ("O", *(f"{p}-{k}" for k in (*KINDS, *MORE_KINDS) for p in "BI"))

LOCAL = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58)])) + "._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run, so the look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
ODD = re.compile(r"[0-9@+=\"_]")
TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each base kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        if at >= done:
            # The local part is the longest run of its characters before the @, back to the last match.
            lo, width = at, 64
            while lo > done:
                piece = text[max(done, at - width) : at]
                rest = piece.rstrip(LOCAL)
                lo = at - (len(piece) - len(rest))
                if rest or at - width <= done:
                    break
                width *= 4
            if lo < at and (m := DOMAIN.match(text, at)):
                done = m.end()
                found["email"].append((lo, done))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found["ip"].append(m.span())
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
    return found


# Tokens and features


def shape(token: str) -> str:
    """Letters, digits and signs of a token in short: runs of more than four are cut."""
    out, last, run = [], "", 0
    for c in token[:64]:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdecimal() else c if c in "@.+-()=_/:\"'" else "#"
        run = run + 1 if k == last else 1
        last = k
        if run <= 4:
            out.append(k)
    return "".join(out)


CUES = re.compile(r"(?i)^\W*(password|passwd|secret|token|apikey|api_key|key|phone|tel|call|fax|card|visa|mail|email|ip|host|server)\b")
DOUBT = re.compile(r"[0-9@+=\"_]")


@lru_cache(maxsize=65536)
def describe(token: str) -> tuple[str, ...]:
    """Features of one token: a plain class only, if it is a plain word without cues."""
    cue = CUES.match(token)
    if not DOUBT.search(token) and not cue:
        core = token.rstrip(".,;:!?")
        case = "none" if not any(map(str.isalpha, core)) else "a" if core.islower() else "AA" if core.isupper() and len(core) > 1 else "Aa" if core[:1].isupper() and (core[1:].islower() or len(core) == 1) else "mix"
        return (f"plain:{case}{'.' if core != token else ''}",)
    digits = sum(map(str.isdecimal, token))
    core = token.strip(".,;:!?\"'()[]")
    feats = [f"shape:{shape(token)}", f"core:{shape(core)}", f"digits:{min(digits, 20) if digits < 8 else 8 + (digits - 8) // 4}", f"len:{min(len(token), 40) // 4}", f"first:{shape(token[:1])}"]
    feats += [f"has:{c}" for c in "@.+-(=\"_:" if c in token]
    if core.isalnum() and digits and len(core) >= 16:
        feats.append("blob:" + ("A" if core.isupper() else "a" if core.islower() else "m"))
    if re.fullmatch(r"[0-9a-f]{16,}", core):
        feats.append("hex")
    if digits >= 12:
        feats.append(f"luhn:{luhn(''.join(c for c in core if c in '0123456789'))}")
    if cue:
        feats.append(f"cue:{cue[1].lower()}")
    return tuple(feats)


def features(tokens: list[str]) -> list[list[str]]:
    own = [describe(t) for t in tokens]
    edge = ("edge",)
    return [[*own[i], *(f"-1{f}" for f in (own[i - 1] if i else edge)), *(f"+1{f}" for f in (own[i + 1] if i + 1 < len(own) else edge))] for i in range(len(own))]


def allowed(tokens: list[str]) -> np.ndarray:
    """Which tokens may have a label other than O under the constraint."""
    doubt = [bool(DOUBT.search(t)) for t in tokens]
    return np.array([d or (i + 1 < len(doubt) and doubt[i + 1] and bool(CUES.match(tokens[i]))) for i, d in enumerate(doubt)], dtype=bool)


# Training table


def training_table(n: int = 400, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table: (text, spans), made by rule from a seed. Kinds in common notations, and look-alikes without label."""
    rng = np.random.default_rng(seed)
    syll = ["ra", "ten", "mo", "li", "ver", "so", "ka", "dun", "el", "ist", "por", "qua", "é", "ü", "ción"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(syll) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        d = "4" + num(14)
        d = next(d + str(c) for c in range(10) if luhn(d + str(c)))
        return pick([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    makers = {
        "email": lambda: f"{word()}{pick(['.', '_', ''])}{pick([num(2), word()])}@{word()}{pick(['', num(1)])}.{pick(['com', 'org', 'example.com', 'net'])}",
        "ip": lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4)),
        "card": card,
        "phone": lambda: pick(["+1 ({}) {}-{}", "({}) {}-{}", "+49 {} {}{}", "{}-{}-{}", "+33 {} {} {}"]).format(num(3), num(3), num(4)),
        "secret": lambda: pick(["AKIA" + upper(15) + num(1), "password=" + hexes(18), "password: " + num(2) + hexes(14), 'token = "' + hexes(40) + '"', "api_key=" + hexes(32), "secret: " + num(1) + hexes(23)]),
    }
    others = [lambda: num(16), lambda: num(16), lambda: f"{num(3)}.{num(3)}.{300 + int(num(2))}.{num(2)}", lambda: num(int(rng.integers(1, 5))), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.0.", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(3)},{num(3)}", lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"${num(3)}", lambda: "+", lambda: f"{word()}_{word()}", lambda: f'"{word()}"', lambda: f"{word()}=", lambda: f"{num(2)}%", lambda: f"{num(1)}+{num(1)}", lambda: f"@{word()}", lambda: f"{upper(4)}{num(2)}", lambda: "key", lambda: "token", lambda: "the password", lambda: f"card {num(2)}", lambda: f"phone {word()}"]
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(6, 18))):
            r = rng.random()
            if r < 0.16:
                kind = pick(list(makers))
                s = makers[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + pick(["", "", "", ".", ",", "###", "%%%"])
            elif r < 0.30:
                text += pick(others)()
            else:
                w = word()
                text += pick([w, w, w, w.capitalize(), w.upper()]) + pick(["", "", "", "", ".", ",", "!!", "$$$"])
            text += pick([" ", " ", " ", "\n"])
        rows.append((text, spans))
    return rows


# The field


class Field:
    """Weights: emit[feature, label], trans[label, label]."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, trans: np.ndarray, constrained: bool = True):
        self.index, self.emit, self.trans, self.constrained = index, emit, trans, constrained

    def scores(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for i, fs in enumerate(features(tokens)):
            for f in fs:
                if (k := self.index.get(f)) is not None:
                    out[i] += self.emit[k]
        if self.constrained:
            out[~allowed(tokens), 1:] = -1e9
        return out

    def decode(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of every segment of scores, in padded batches of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            n, m = len(part), len(segments[part[-1]])
            if not m:
                continue
            e = np.zeros((n, m, len(LABELS)))
            lens = np.array([len(segments[i]) for i in part])
            for k, i in enumerate(part):
                e[k, : lens[k]] = segments[i]
            best, back = e[:, 0].copy(), np.zeros((n, m, len(LABELS)), np.int16)
            for j in range(1, m):
                via = best[:, :, None] + self.trans[None]
                back[:, j] = via.argmax(1)
                step = via.max(1) + e[:, j]
                best = np.where((j < lens)[:, None], step, best)
            last = best.argmax(1)
            path = np.zeros((n, m), np.int64)
            for j in range(m - 1, -1, -1):
                path[:, j] = last
                inside = (j < lens) & (j > 0)
                last = np.where(inside, back[np.arange(n), j, last], last)
            for k, i in enumerate(part):
                out[i] = path[k, : lens[k]]
        return out


def labelled(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], np.ndarray]:
    tokens, labels = [], []
    for m in TOKEN.finditer(text):
        own = next(((k, s) for k, s, e in spans if s < m.end() and m.start() < e), None)
        tokens.append(m[0])
        labels.append(0 if own is None else LABELS.index(f"{'B' if m.start() <= own[1] else 'I'}-{own[0]}"))
    return tokens, np.array(labels, dtype=np.int64)


def train(table: list[tuple[str, list[tuple[str, int, int]]]] | None = None, l2: float = 0.05, steps: int = 80) -> Field:
    """Maximise the penalised likelihood of the labelled table (forward-backward in padded batches)."""
    rows = [r for r in (labelled(t, s) for t, s in (table or training_table())) if r[0]]
    free = [allowed(tokens) for tokens, _ in rows]
    constrained = not any(y[~ok].any() for (_, y), ok in zip(rows, free))
    feats = [features(tokens) for tokens, _ in rows]
    index = {f: k for k, f in enumerate(sorted({f for row in feats for fs in row for f in fs}))}
    size, width, n, m = len(index), len(LABELS), len(rows), max(len(t) for t, _ in rows)
    lens = np.array([len(t) for t, _ in rows])
    where = np.array([(i * m + j) for i, row in enumerate(feats) for j, fs in enumerate(row) for _ in fs])
    which = np.array([index[f] for row in feats for fs in row for f in fs])
    gold = np.zeros((n, m), np.int64)
    for i, (_, y) in enumerate(rows):
        gold[i, : len(y)] = y
    inside = np.arange(m)[None] < lens[:, None]
    shut = np.zeros((n, m), bool)
    if constrained:
        for i, ok in enumerate(free):
            shut[i, : len(ok)] = ~ok
    pairs = inside[:, 1:]
    want = np.zeros((width, width))
    np.add.at(want, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)

    def lse(x, axis):
        top = x.max(axis)
        return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))

    def loss_grad(x):
        emit, trans = x[: size * width].reshape(size, width), x[size * width :].reshape(width, width)
        e = np.zeros((n * m, width))
        np.add.at(e, where, emit[which])
        e = e.reshape(n, m, width)
        e[shut, 1:] = -1e4
        fwd, bwd = np.zeros((n, m, width)), np.zeros((n, m, width))
        fwd[:, 0] = e[:, 0]
        for j in range(1, m):
            step = lse(fwd[:, j - 1, :, None] + trans[None], 1) + e[:, j]
            fwd[:, j] = np.where(inside[:, j, None], step, fwd[:, j - 1])
        for j in range(m - 2, -1, -1):
            step = lse(trans[None] + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
            bwd[:, j] = np.where(inside[:, j + 1, None], step, 0.0)
        z = lse(fwd[:, -1], 1)
        marg = np.exp(fwd + bwd - z[:, None, None]) * inside[:, :, None]
        ex = np.zeros((width, width))
        for j in range(m - 1):
            p = np.exp(fwd[:, j, :, None] + trans[None] + (e[:, j + 1] + bwd[:, j + 1])[:, None, :] - z[:, None, None])
            ex += (p * pairs[:, j, None, None]).sum(0)
        hit = np.take_along_axis(e, gold[:, :, None], 2)[:, :, 0]
        ll = (hit * inside).sum() + (want * trans).sum() - z.sum()
        marg[np.arange(n)[:, None], np.arange(m)[None], gold] -= inside
        marg[shut, 1:] = 0.0
        flat = marg.reshape(n * m, width)
        ge = np.zeros((size, width))
        np.add.at(ge, which, flat[where])
        return -ll + 0.5 * l2 * (x @ x), np.concatenate([ge.ravel() + l2 * emit.ravel(), (ex - want).ravel() + l2 * trans.ravel()])

    x = lbfgs(loss_grad, np.zeros(size * width + width * width), steps)
    return Field(index, x[: size * width].reshape(size, width), x[size * width :].reshape(width, width), constrained)


def pieces(text: str, field: Field):
    """(tokens with positions) of the parts of a text that need decoding."""
    if not field.constrained:
        spots = [(0, len(text))] if text else []
    else:
        spots, reach = [], -1
        for m in ODD.finditer(text):
            if m.start() < reach:
                continue
            lo, hi = m.start(), m.end()
            for _ in range(4):  # own token and three more: a cue and its neighbours, then plain words
                lo = _token_start(text, lo)
                hi = _token_end(text, hi)
            spots.append((lo, hi))
            reach = _token_end(text, m.end(), step=False)
    merged: list[list[int]] = []
    for lo, hi in spots:
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [[(t[0], t.start(), t.end()) for t in TOKEN.finditer(text, lo, hi)] for lo, hi in merged]


SPACE_BACK = re.compile(r"\s")


def _token_start(text: str, at: int) -> int:
    """Start of the token before position at (or of the one at is in)."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def _token_end(text: str, at: int, step: bool = True) -> int:
    n = len(text)
    if step:
        while at < n and text[at].isspace():
            at += 1
    m = SPACE_BACK.search(text, at)
    return m.start() if m else n


TRIM = ".,;:!?#$%&*|'"


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text."""
    segments, owners = [], []
    for i, text in enumerate(texts):
        for seg in pieces(text, field):
            segments.append(seg)
            owners.append(i)
    paths = field.decode([field.scores([t for t, _, _ in seg]) for seg in segments])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, seg, path in zip(owners, segments, paths):
        now: list | None = None
        for (_, a, b), y in zip(seg, path.tolist()):
            kind, begins = (LABELS[y][2:], LABELS[y][0] == "B") if y else ("", False)
            if now and (not y or begins or kind != now[0]):
                out[i].append(tuple(now))
                now = None
            if y:
                now = [now[0], now[1], b] if now else [kind, a, b]
        if now:
            out[i].append(tuple(now))
    trimmed = []
    for text, spans in zip(texts, out):
        kept = []
        for kind, a, b in spans:
            while b > a and text[b - 1] in TRIM:
                b -= 1
            while a < b and text[a] in TRIM:
                a += 1
            digits = sum(c.isdecimal() for c in text[a:b])
            # A span of a base kind needs what the kind is made of.
            need = {"email": "@" in text[a:b], "ip": bool(IP.fullmatch(text[a:b])) and all(int(p) <= 255 for p in text[a:b].split(".")), "card": 12 <= digits <= 19 and luhn("".join(c for c in text[a:b] if c in "0123456789")), "phone": digits >= 7, "secret": digits >= 2 and b - a >= 12}
            if need[kind]:
                kept.append((kind, a, b))
        trimmed.append(kept)
    return trimmed


def find_spans(texts: list[str], field: Field) -> tuple[list[dict], list[list[tuple[str, int, int]]]]:
    """(base spans, added spans) of each text; added ones overlap no base span."""
    base = [base_spans(t) for t in texts]
    added = []
    for own, more in zip(base, field_spans(texts, field)):
        taken = [s for v in own.values() for s in v]
        added.append([(k, a, b) for k, a, b in more if not any(s < b and a < e for s, e in taken)])
    return base, added


def as_string(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate((*KINDS, *MORE_KINDS))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2])))


def personal_data(docs: DataFrame, table=None) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans as text, of every document."""
    import hashlib

    field = docs.sparkSession.sparkContext.broadcast(train(table))

    def found(batches):
        for batch in sliced(batches, 500):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base, added = find_spans(texts, field.value)
            flat = [[(k, a, b) for k in KINDS for a, b in own[k]] for own in base]
            cols = {"doc_id": id_array(batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False))}
            cols |= {f"n_{k}": pa.array([len(own[k]) for own in base], pa.int64()) for k in KINDS}
            cols["base_sha256"] = pa.array([hashlib.sha256(as_string(f).encode()).hexdigest() for f in flat], pa.string())
            cols["spans"] = pa.array([as_string(f + more) for f, more in zip(flat, added)], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(found, schema)


def redact(docs: DataFrame, table=None) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; n_chars follows, if there."""
    field = docs.sparkSession.sparkContext.broadcast(train(table))
    names = docs.columns

    def redacted(batches):
        for batch in sliced(batches, 500):
            texts = batch.column("text").to_pylist()
            base, added = find_spans([t or "" for t in texts], field.value)
            new = []
            for text, own, more in zip(texts, base, added):
                spans = sorted([(a, b, k) for k in KINDS for a, b in own[k]] + [(a, b, k) for k, a, b in more])
                if spans:
                    parts, at = [], 0
                    for a, b, k in spans:
                        if b > at:
                            parts += [text[at : max(a, at)], f"[{k.upper()}]" if a >= at else ""]
                            at = b
                    text = "".join([*parts, text[at:]])
                new.append(text)
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in names:
                kind = batch.schema.field("n_chars").type
                old = batch.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array([len(t) if t is not None and t is not s and t != s else o for t, s, o in zip(new, texts, old)], kind)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], schema=batch.schema)

    return docs.mapInArrow(redacted, docs.schema)
