"""Personal data: base patterns, and a character BiLSTM with CRF transitions beside them.

The base finds emails, IPv4 addresses, card numbers and phone numbers by pattern, in
time linear in the text. The model is a character-level bidirectional LSTM whose
emissions a linear-chain CRF decodes over B/I tags of the four kinds and O. It is
trained here, in numpy, from labelled spans: base spans in a bounded sample of
documents (`TRAIN_DOCS`) and the same personal data rewritten in forms that the base
misses (spaced or bracketed separators, line breaks, no country code), planted into
the sample's own text. Numbers that are no personal data stay unlabelled.

Every one of the kinds has a digit or an "@" in it, so only regions of text about
those characters are decoded; text without them cannot have a span. Long regions are
decoded in overlapping windows, and where windows overlap each character takes the
tag of the window in whose middle it lies more nearly. A span the model adds must
hold what its kind demands (an address, four parts to 255, a Luhn number, phone
digits) and must not touch a base span; base spans always stay.

Defined cases: null text is empty and has no spans; repeated rows each get their own
result; an empty table gives an empty result; without any labelled span the model
adds nothing; other input columns are ignored by `report` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._shared import arrow_map, spread

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0 is O, 1 + 2k is B and 2 + 2k is I of kind k
#: Most documents the labelled spans are taken from, and most surroundings of each, those of least hash.
TRAIN_DOCS, TRAIN_PLACES = 600, 8
#: An address has 254 characters at most, so a region reaches no further along one.
ADDRESS = 254
WINDOW, OVERLAP, REACH = 64, 24, 20
HIDDEN, EMBED, SHAPES = 20, 12, 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_TRIGGER = re.compile(r"[0-9@]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def good_ip(s: str) -> bool:
    parts = [x.lstrip("0") or "0" for x in s.split(".")]
    return all(len(x) < 4 and int(x) <= 255 for x in parts)


def good_card(s: str) -> bool:
    d = digits_of(s)
    return 13 <= len(d) <= 19 and luhn(d)


def good_phone(s: str) -> bool:
    return 9 <= len(digits_of(s)) <= 15


def emails(text: str) -> list[Span]:
    """Leftmost matches, each found from its "@": the local part is all that may stand before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base(text: str) -> list[Span]:
    """Base spans by kind as listed, then by start."""
    if not _TRIGGER.search(text):
        return []
    out = emails(text)
    for kind, pattern, good in (("ip", _IP, good_ip), ("card", _CARD, good_card), ("phone", _PHONE, good_phone)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if good(m.group())]
    return out


def digest_text(spans: list[Span]) -> str:
    """kind:start:end, by kind as listed and start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# The model


def codes(text: str) -> np.ndarray:
    """A small code of each character: signs of their own, letters by case, digits by class."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(c), 1, np.int64)
    for i, sign in enumerate("@.+-()_%:/,=\"'[]#&*!$"):
        out[c == ord(sign)] = 10 + i
    out[(c >= 97) & (c <= 122)] = 2
    out[(c >= 65) & (c <= 90)] = 3
    out[(c >= 48) & (c <= 57)] = 4
    out[c == 32] = 5
    out[(c == 10) | (c == 13) | (c == 9)] = 6
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Weights of the BiLSTM and the CRF."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        h = HIDDEN
        w = {"emb": r.normal(0, 0.3, (SHAPES, EMBED)), "out": r.normal(0, 0.2, (2 * h, TAGS)), "bo": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in "fb":
            w |= {f"W{d}": r.normal(0, 0.25, (EMBED + h, 4 * h)), f"b{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        for i in range(TAGS):  # I needs B or I of its kind before it
            if i and i % 2 == 0:
                w["start"][i] = -20
                w["trans"][[j for j in range(TAGS) if j not in (i, i - 1)], i] = -20
        return cls(w)

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN))
        out, tape = np.zeros((n, steps, HIDDEN)), []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            z = np.concatenate([x[:, t], h], 1)
            a = z @ self.w[f"W{d}"] + self.w[f"b{d}"]
            i, f, o, g = sigmoid(a[:, :HIDDEN]), sigmoid(a[:, HIDDEN : 2 * HIDDEN]), sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            tape.append((t, z, i, f, o, g, before, tc))
        return out, tape

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.w["emb"][x]
        (hf, tf), (hb, tb) = self._lstm(e, "f"), self._lstm(e, "b")
        h = np.concatenate([hf, hb], 2)
        return h @ self.w["out"] + self.w["bo"], (h, tf, tb)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags of windows of character codes; 0 is padding."""
        e, _ = self.emissions(x)
        n, steps, _ = e.shape
        score, back = self.w["start"] + e[:, 0], np.zeros((n, steps, TAGS), np.int8)
        for t in range(1, steps):
            s = score[:, :, None] + self.w["trans"]
            back[:, t] = s.argmax(1)
            score = s.max(1) + e[:, t]
        tags = np.zeros((n, steps), np.int8)
        tags[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        w, g = self.w, {k: np.zeros_like(v) for k, v in self.w.items()}
        e, (h, tf, tb) = self.emissions(x)
        n, steps, k = e.shape
        rows = np.arange(n)
        alpha = np.zeros_like(e)
        alpha[:, 0] = w["start"] + e[:, 0]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        for t in range(1, steps):
            alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + w["trans"], 1) + e[:, t]
        logz = lse(alpha[:, -1], 1)
        gold = w["start"][y[:, 0]] + e[rows, 0, y[:, 0]]
        beta, de = np.zeros((n, k)), np.zeros_like(e)
        for t in range(steps - 1, -1, -1):
            de[:, t] = np.exp(alpha[:, t] + beta - logz[:, None])
            de[rows, t, y[:, t]] -= 1
            if t:
                gold += w["trans"][y[:, t - 1], y[:, t]] + e[rows, t, y[:, t]]
                ahead = w["trans"] + (e[:, t] + beta)[:, None, :]
                g["trans"] += np.exp(alpha[:, t - 1][:, :, None] + ahead - logz[:, None, None]).sum(0)
                np.subtract.at(g["trans"], (y[:, t - 1], y[:, t]), 1)
                beta = lse(ahead, 2)
        g["start"] = de[:, 0].sum(0)
        g["out"], g["bo"] = np.einsum("nth,ntk->hk", h, de), de.sum((0, 1))
        dh = de @ w["out"].T
        dx = np.zeros((n, steps, EMBED))
        for d, tape, part in (("f", tf, dh[:, :, :HIDDEN]), ("b", tb, dh[:, :, HIDDEN:])):
            dc = back = np.zeros((n, HIDDEN))
            for t, z, i, f, o, gg, before, tc in reversed(tape):
                d_h = part[:, t] + back
                dc = dc + d_h * o * (1 - tc * tc)
                da = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), d_h * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                g[f"W{d}"] += z.T @ da
                g[f"b{d}"] += da.sum(0)
                dz = da @ w[f"W{d}"].T
                dx[:, t] += dz[:, :EMBED]
                back, dc = dz[:, EMBED:], dc * f
        np.add.at(g["emb"], x, dx)
        return float((logz - gold).mean()), {a: b / n for a, b in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, seed: int, rate: float = 0.02) -> float:
        """Adam; returns the last mean loss."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        loss = 0.0
        for s in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            loss, g = self.gradient(x[pick], y[pick])
            norm = max(1.0, np.sqrt(sum((a * a).sum() for a in g.values())) / 5)
            for k, a in g.items():
                a = a / norm
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.w[k] -= rate * min(1.0, 2 * (1 - s / (steps + 1))) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
        return loss


def variants(kind: str, value: str, r: np.random.Generator) -> str:
    """The same personal data in a form that the base patterns miss."""
    if kind == "email":
        name, _, host = value.partition("@")
        return [f"{name} @ {host}", f"{name}@ {host}", f"{name} @{host}"][r.integers(3)]
    if kind == "ip":
        return [" . ", "[.]", ". "][r.integers(3)].join(value.split("."))
    d = digits_of(value)
    if kind == "card":
        return [".", "\n", "  ", " - "][r.integers(4)].join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"][r.integers(3)]


def examples(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags from base spans, their variants and places without any."""
    r = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, spans: list[Span], middle: int) -> None:
        a = max(0, min(middle - int(r.integers(8, WINDOW - 8)), len(text) - WINDOW))
        c, y = codes(text[a : a + WINDOW]), np.zeros(WINDOW, np.int64)
        for kind, s, e in spans:
            b, i = 1 + 2 * KINDS.index(kind), range(max(s, a) - a, min(e, a + WINDOW) - a)
            for j in i:
                y[j] = b + 1
            if len(i) and s >= a:
                y[i[0]] = b
        xs.append(np.pad(c, (0, WINDOW - len(c))))
        ys.append(y)

    for text in texts:
        spans = base(text)
        for kind, s, e in spans:
            add(text, spans, (s + e) // 2)
            if kind == "phone" and len(digits_of(text[s:e])) < 10:
                continue
            new = variants(kind, text[s:e], r)
            left, right = text[max(0, s - WINDOW) : s], text[e : e + WINDOW]
            add(left + new + right, [(kind, len(left), len(left) + len(new))] + [(k, a - s + len(left), b - s + len(left)) for k, a, b in spans if b <= s and a >= s - len(left)], len(left) + len(new) // 2)
        for m in list(_TRIGGER.finditer(text))[::16]:
            if not any(s - 2 <= m.start() < e + 2 for _, s, e in spans):
                add(text, spans, m.start())
        add(text, spans, int(r.integers(0, len(text) + 1)))
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)


def fit(docs: DataFrame, text_col: str = "text", steps: int = 260, seed: int = 5) -> Tagger | None:
    """Train on the base spans of at most TRAIN_PLACES surroundings in at most TRAIN_DOCS documents of `docs`.

    The sample is the documents with a digit or "@" whose text has the least hash, and
    of each the surroundings of digits and "@" signs of least hash. None: no span.
    """
    text = F.col(text_col).cast("string")
    some = docs.filter(text.rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), text.alias("t"))
    picked = [r.h for r in some.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).collect()]
    places = F.regexp_extract_all("t", F.lit(rf"(?s).{{0,{WINDOW}}}[0-9@].{{0,{2 * WINDOW}}}"), F.lit(0))
    hashed = F.array_sort(F.transform(places, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))))
    near = F.transform(F.slice(hashed, 1, TRAIN_PLACES), lambda x: x["x"])
    found = some.filter(F.col("h").isin(picked)).select("h", near.alias("near")).dropDuplicates(["h"])
    rows = sorted(found.collect(), key=lambda r: r.h) if picked else []
    x, y = examples([t for r in rows for t in r.near], seed)
    if not (y > 0).any():
        return None
    tagger = Tagger.fresh(seed)
    tagger.train(x, y, steps, 64, seed)
    return tagger


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches about digits and "@" signs, to the ends of the words or addresses they cut, merged."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if out and at + REACH <= out[-1][1]:
            continue
        a, b = max(0, at - REACH), min(len(text), at + REACH)
        least, most = max(0, at - ADDRESS), min(len(text), at + ADDRESS)
        while a > least and not _NOT_LOCAL.match(text[a - 1]):
            a -= 1
        while b < most and not _NOT_LOCAL.match(text[b]):
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def windows(regs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping windows that cover the regions."""
    out = []
    for a, b in regs:
        while b - a > WINDOW:
            out.append((a, a + WINDOW))
            a += WINDOW - OVERLAP
        out.append((a, b))
    return out


def reconcile(wins: list[tuple[int, int]], tags: np.ndarray) -> list[Span]:
    """Spans of a text from its windows, which are in order: where two overlap, each has its nearer half."""
    out: list[list] = []
    last = -1
    for i, (a, b) in enumerate(wins):
        lo = a if not i or wins[i - 1][1] <= a else (a + wins[i - 1][1]) // 2
        hi = b if i + 1 == len(wins) or wins[i + 1][0] >= b else (wins[i + 1][0] + b) // 2
        for at in np.flatnonzero(tags[i, lo - a : hi - a]) + lo:
            tag = int(tags[i, at - a])
            kind = KINDS[(tag - 1) // 2]
            if tag % 2 == 0 and out and last == at - 1 and out[-1][0] == kind:
                out[-1][2] = int(at) + 1
            else:
                out.append([kind, int(at), int(at) + 1])
            last = at
    return [tuple(x) for x in out]


def holds(kind: str, s: str) -> bool:
    """What a span the model adds must have."""
    if kind == "email":
        return s.count("@") == 1 and re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s) is not None
    parts = re.findall("[0-9]+", s)
    if re.search(r"[^0-9 .()\[\]\n+-]", s) or not parts or not s[0].isdigit() and s[0] not in "(+" or not s[-1].isdigit():
        return False
    if kind == "ip":
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return good_card(s)
    return "\n" not in s and 10 <= len(digits_of(s)) <= 15 and len(parts) >= 3 and len(parts[-1]) >= 4


def find(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    bases = [base(t) for t in texts]
    if tagger is None:
        return [(b, b) for b in bases]
    wins = [windows(regions(t)) for t in texts]
    x = np.zeros((sum(map(len, wins)), WINDOW), np.int64)
    at = 0
    for text, ws in zip(texts, wins):
        for a, b in ws:
            x[at, : b - a] = codes(text[a:b])
            at += 1
    tags = np.concatenate([tagger.decode(x[i : i + 1024]) for i in range(0, len(x), 1024)]) if len(x) else x
    out, at = [], 0
    for text, ws, b in zip(texts, wins, bases):
        spans = list(b)
        for kind, s, e in reconcile(ws, tags[at : at + len(ws)]):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1] in " \n.,;":
                e -= 1
            if s < e and not any(s < e2 and s2 < e for _, s2, e2 in spans) and holds(kind, text[s:e]):
                spans.append((kind, s, e))
        at += len(ws)
        out.append((b, spans))
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def report(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans and all spans of each document: RESULT columns."""
    model = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs, text_col))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find(["" if t is None else t for t in batch.column(1).to_pylist()], model.value)
        counts = [[sum(s[0] == k for s in b) for b, _ in found] for k in KINDS]
        digests = [hashlib.sha256(digest_text(b).encode()).hexdigest() for b, _ in found]
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([digest_text(s) for _, s in found], pa.string())]
        return pa.record_batch(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return arrow_map(spread(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))), run, RESULT)


def blanked(text: str, spans: list[Span]) -> str:
    """Each stretch of touching spans becomes the mark of its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """`docs`, with all its columns, personal data replaced by marks; null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs, text_col))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        found = find([t or "" for t in texts], model.value)
        new = [None if t is None else blanked(t, s) for t, (_, s) in zip(texts, found)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return arrow_map(spread(docs), run, docs.schema)
