"""Document quality by positive-unlabelled learning.

The trusted positives are labelled documents of quality 1, the unlabelled web text is
a sample of all other documents. The classifier minimises the non-negative unbiased
risk: prior * E_p[loss(f, +1)] + max(0, E_u[loss(f, -1)] - prior * E_p[loss(f, -1)]).
With that alone the few negatives in unlabelled text are learned from a difference
of two averages; where that difference turns negative it no longer pulls, so that the
model does not fit the unlabelled sample down to nothing.

The class prior of unlabelled text is estimated, not given: a first model separates
positives from unlabelled, and the prior is the least ratio, over its scores, of the
unlabelled share above the score to the positive share above it. Scores are the
sigmoid of a linear model over binned style features, none of which comes from lang,
source, doc_id or a label. Their zero point is put where the threshold belongs: in the
valley of the unlabelled scores next to the share of negatives that the prior leaves,
and never above all but a few trusted positives.

Sampling is bounded and documented: at most `max_labelled` positives and
`max_unlabelled` others, those of least hash of id and text. A row and its exact repeats
(equal id and text) are one draw; copies of a text under many ids are drawn as often as
their share. The bounds do not follow the input: the model has some 500 weights, and
the risk is a mean over the sample, whose error at 12,000 rows is below a hundredth
whatever the corpus. Every document is scored, over its whole text.

Defined cases: null and empty texts have all-zero features and get a score like any
other; repeated rows each get their own row; without positives every score is the
prior; an empty table gives an empty result; other input columns are ignored by
`scores` and kept by `keep`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm._shared import arrow_map, spread

THRESHOLD = 0.3
RESULT = "doc_id long, held_out boolean, score double, predicted int"
FEATURES = ("chars", "words", "word_len", "long_words", "upper", "digits", "space", "newlines", "stops", "commas", "pipes", "marks", "symbols", "other", "distinct", "distinct_lines", "longest", "caps_words", "mixed", "sentence_len", "end_stop", "first_word", "trigram_repeats")
_MARKED = re.compile(r"[^\w\s.,;:'’-]{2,}")
_SENTENCE = re.compile(r"[.!?]+(?:\s|\Z)")
_CAPS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b")

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"|", b"!?", b"#$%&*<>=@^_~+/\\{}[]()\"`")):
    _CLASS[list(_chars)] = _i + 1
_CLASS[128:] = 10


def features(text: str) -> list[float]:
    """Style features of a whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    by = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) / n
    words = text.split()
    k = max(len(words), 1)
    lines = text.split("\n")
    different = set(words)
    grams = set(zip(words, words[1:], words[2:]))
    sentences = len(_SENTENCE.findall(text))
    first = words[0] if words else ""
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / k,
        sum(len(w) > 15 for w in different) / max(len(different), 1),
        by[1], by[2], by[3], by[4], by[5], by[6], by[7], by[8], by[9], by[10],
        len(different) / k,
        len(set(lines)) / len(lines),
        np.log1p(max(map(len, different), default=0)),
        len(_CAPS.findall(text)) / k,
        len(_MARKED.findall(text)) / k,
        np.log1p(k / (sentences + 1)),
        float(text.rstrip()[-1:] in ".!?"),
        words.count(first) / k if words else 0.0,
        len(grams) / max(len(words) - 2, 1),
    ]


@dataclass
class Model:
    """Bin edges of each feature, weights of the bins, and the estimated prior."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Cumulative indicators of each feature's bins."""
        return np.concatenate([x[:, i : i + 1] > e for i, e in enumerate(self.edges)], 1).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights + self.bias, -40, 40)))


def edges(x: np.ndarray) -> list[np.ndarray]:
    """Quantile bins of each feature: 4 to 24, more the more rows there are."""
    bins = int(np.clip(len(x) // 60, 4, 24))
    return [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[:-1])) for i in range(x.shape[1])]


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, l2: float, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the sigmoid cross-entropy loss."""
    both = [np.concatenate([a, np.ones((len(a), 1))], 1) for a in (p, u)]
    p, u = both
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = u.T @ sig(zu) / len(u) - prior * (p.T @ sig(zp)) / len(p)
        g = -prior * (p.T @ sig(-zp)) / len(p) + (g_neg if neg >= 0 else 0)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 150) -> float:
    """Share of positives in unlabelled text.

    A plain positive-against-unlabelled model orders both samples; half of each is
    fitted and the other half measured. A share `prior` of the unlabelled rows lies
    like the positives, so above any score the unlabelled share is at least prior
    times that of the positives; the least ratio, over the scores that at least a
    fifth of the positives pass, is the estimate.
    """
    w, b = _descend_plain(p[::2], u[::2], steps)
    sp, su = np.sort(p[1::2] @ w + b), np.sort(u[1::2] @ w + b)
    if not len(sp) or not len(su):
        return 0.5
    ratios = [1.0]
    for q in np.linspace(0.0, 0.8, 41):
        cut = np.quantile(sp, q)
        above_p, above_u = (sp >= cut).mean(), (su >= cut).mean()
        slack = np.sqrt(above_u * (1 - above_u) / len(su)) + np.sqrt(above_p * (1 - above_p) / len(sp))
        ratios.append((above_u + slack) / above_p)
    return float(np.clip(min(ratios), 0.05, 0.98))


def _descend_plain(p: np.ndarray, u: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    x = np.concatenate([p, u])
    y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    weight = np.where(y > 0, 0.5 / max(len(p), 1), 0.5 / max(len(u), 1))
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ ((z - y) * weight)
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(pos: np.ndarray, unl: np.ndarray, steps: int = 300, l2: float = 1e-3) -> Model:
    """Fit on feature rows of trusted positives and of unlabelled text."""
    width = len(FEATURES)
    pos, unl = pos.reshape(-1, width), unl.reshape(-1, width)
    if not len(pos) or not len(unl):
        prior = 0.5 if not len(pos) else 0.98
        return Model([np.zeros(0)] * width, np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    model = Model(edges(np.concatenate([pos, unl])), np.zeros(0), 0.0, 0.5)
    p, u = model.expand(pos), model.expand(unl)
    model.prior = estimate_prior(p, u)
    model.weights, model.bias = _descend(p, u, model.prior, steps, l2)
    cut = valley(p @ model.weights, u @ model.weights, model.prior)
    model.bias = float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return model


def valley(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """Where unlabelled margins are thinnest near the 1 - prior quantile."""
    z, n = np.sort(zu), len(zu)
    width = max(1, n // 100)
    lo, hi = int(0.5 * (1 - prior) * n), min(n - width - 1, int(1.3 * (1 - prior) * n))
    if hi <= lo:
        return float(np.quantile(zp, 0.003))
    at = lo + int(np.argmax(z[lo + width : hi + width + 1] - z[lo : hi + 1]))
    return float(min(z[at] + 0.4 * (z[at + width] - z[at]), np.quantile(zp, 0.003)))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text is divisible by 5."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def _rows(df: DataFrame) -> np.ndarray:
    """Features of a bounded sample (text, part), computed on the executors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t or "") for t in batch.column(0).to_pylist()]
        return pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "positive"])

    got = arrow_map(df, run, "x array<double>, positive boolean").toPandas()
    return got


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_unlabelled: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on documents outside the evaluation fold.

    `labels` gives only which documents are trusted positives: its quality column of
    1. Every other document is unlabelled, whatever its label says.
    """
    d = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("text")).filter(~held_out("k"))
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("string").alias("g")).distinct()
    draw = F.xxhash64(F.col("text"), F.col("k"), F.lit(11))
    tagged = d.select("k", draw.alias("h")).distinct().join(good, F.col("k") == F.col("g"), "left").select("k", "h", F.col("g").isNotNull().alias("positive"))
    picked = []
    for flag, most in ((True, max_labelled), (False, max_unlabelled)):
        picked.append(tagged.filter(F.col("positive") == flag).orderBy("h", "k").limit(most))
    both = F.broadcast(picked[0].unionByName(picked[1]))  # at most the two bounds together
    once = d.withColumn("h", draw).join(both.select("h", "positive"), "h").dropDuplicates(["h"])
    got: pd.DataFrame = _rows(once.select("text", "positive"))
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    flag = got["positive"].to_numpy(bool) if len(got) else np.zeros(0, bool)
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)
    shuffled = np.random.default_rng(7).permutation(order)
    x, flag = x[shuffled], flag[shuffled]
    return train(x[flag], x[~flag])


def _score_batch(model: Model, texts: list) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    return model.score(np.array([features(t or "") for t in texts], np.float64))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """RESULT columns for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _score_batch(shared.value, batch.column(2).to_pylist())
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return arrow_map(spread(docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string"))), run, RESULT)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs`, with all its columns, without the documents that the model rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_score_batch(shared.value, batch.column(at).to_pylist()) >= threshold))

    return arrow_map(spread(docs), run, docs.schema)
