"""Near-duplicate classes by ProbMinHash, banding and verification.

The words of a text are its runs of non-blank characters; its shingles are five
consecutive words (all words, if fewer), weighted by how often they occur. Equal
texts are put together first, by digest, and one stands for all.

ProbMinHash: each shingle emits a Poisson process of arrivals whose rate is its
weight, every arrival falls into a random register, and a register keeps the shingle
of its first arrival. A shingle stops as soon as its next arrival is later than every
register's. Two texts agree in a register with the probability Jaccard similarity
J_P = sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d), which for
unweighted shingles is the Jaccard similarity.

The registers are cut into bands; texts with an equal band share a bucket. A bucket
never makes all its pairs. Its members are first paired with its leader, the one that
shares most buckets with others: the text that others were copied from shares more with
each of them than they do among themselves, and leads most of their buckets. The pairs
are verified by their exact J_P. Where a bucket then still holds texts of two classes,
members are also paired with their `neighbours` of another class in a random order of
the bucket's own, and these are verified too; two texts share some ten buckets, each
with another order. These two passes only save work: where two classes are then left in
a bucket, its members are compared block by block until no pair of different classes is
untried. A pair that shares several buckets is compared in the first of them alone.
Classes are the connected components of the verified links.

Defined cases: null text is empty; texts without words have no shingles and are
linked by nothing, but equal ones are one class, as are all equal texts; repeated
rows are members like any other; an empty table gives an empty result; other input
columns are ignored by `classes` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm._shared import arrow_map, enter, keyed, pieces, raw, release, row_key, saved, texts_of, unused
from vecspark.llm._words import MIX, chunks, mix64, rolling, signed, within, word_hashes
from vecspark.llm.components import components, joined

RESULT = "doc_id long, class_id long, n_links long, representative boolean"
#: About as many texts, or bytes of them, make a block of the last pass.
BLOCK, BLOCK_BYTES = 1024, 4_000_000


@dataclass(frozen=True)
class NearParams:
    """With 26 bands of 5, a pair of similarity 0.8 shares no bucket once in 30,000."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 26
    rows: int = 5
    neighbours: int = 2


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: document, hash and weight, sorted by document and hash."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    h = word_hashes([x for w in words for x in w])
    starts, docs = within(counts, width)
    e = rolling(h, width)[starts]
    ends = np.cumsum(counts)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = [rolling(h[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in few]
        docs, e = np.concatenate([docs, few]), np.concatenate([e, np.array(short, np.uint64)])
    order = np.lexsort((e, docs))
    docs, e = docs[order], e[order]
    new = np.ones(len(e), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (e[1:] != e[:-1])
    at = np.flatnonzero(new)
    return docs[at], e[at], np.diff(np.append(at, len(e))).astype(np.float64)


def prob_minhash(docs: np.ndarray, e: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures of n_docs weighted sets: the shingle of the first arrival in each of m registers."""
    first, sig = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    latest = np.full(n_docs, np.inf)
    state, time = mix64(e ^ MIX), np.zeros(len(e))
    while len(e):
        state = mix64(state)
        time = time - np.log1p(-((state >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        on = time < latest[docs]
        if not on.all():
            docs, e, weight, state, time = docs[on], e[on], weight[on], state[on], time[on]
            if not len(e):
                break
        at = docs * m + (mix64(state ^ MIX) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        sig[at[won]] = e[won]
        changed = docs[won]
        changed = changed[np.concatenate([[True], changed[1:] != changed[:-1]])] if len(changed) else changed
        latest[changed] = first.reshape(n_docs, m)[changed].max(1)
    return sig.reshape(n_docs, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets, each (sorted hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][i], b[1][j]
    only_a, only_b = np.delete(a[1], i).sum(), np.delete(b[1], j).sum()
    pairs, n = np.unique(np.stack([wa, wb], 1), axis=0, return_counts=True)
    total = 0.0
    for (x, y), k in zip(pairs, n):
        total += k / ((np.maximum(pairs[:, 0] / x, pairs[:, 1] / y) * n).sum() + only_a / x + only_b / y)
    return float(total)


def signed_bands(kd: DataFrame, p: NearParams) -> DataFrame:
    """(id, tk, bands): the band hashes of each text with words, packed as bytes."""
    m = p.bands * p.rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, bands = raw(batch.column(1)), []
        for a, b in chunks([len(t) for t in texts], 2_000_000):
            docs, e, w = shingles(texts[a:b], p.words)
            sig = prob_minhash(docs, e, w, b - a, m).reshape(b - a, p.bands, p.rows)
            h = np.broadcast_to(np.arange(p.bands, dtype=np.uint64), (b - a, p.bands)).copy()
            for r in range(p.rows):
                h = mix64(h * MIX + sig[:, :, r])
            some = np.bincount(docs, minlength=b - a) > 0
            bands += [row.astype("<u8").tobytes() if s else None for row, s in zip(h, some)]
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(bands, pa.binary())], names=["id", "tk", "bands"])

    return arrow_map(kd.select("id", "text", "tk"), run, "id long, tk binary, bands binary")


def buckets(reps: DataFrame, p: NearParams) -> DataFrame:
    """(bucket, band, tk) for each band of each representative."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = batch.filter(batch.column(1).is_valid())
        if not keep.num_rows:
            return None
        tk, bands = keep.column(0), keep.column(1).to_pylist()
        flat = np.frombuffer(b"".join(bands), "<u8")
        index = pa.array(np.repeat(np.arange(len(bands)), p.bands))
        band = np.tile(np.arange(p.bands, dtype=np.int32), len(bands))
        return pa.record_batch([pa.array(signed(flat)), pa.array(band), tk.take(index)], names=["bucket", "band", "tk"])

    return arrow_map(reps.select("tk", "bands"), run, "bucket long, band int, tk binary")


def members_of(reps: DataFrame, p: NearParams) -> DataFrame:
    """(bucket, band, tk, k): the texts of each bucket of at least two, and how many they are."""
    all_ = buckets(reps, p)
    shared = all_.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return all_.join(shared, "bucket")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def star(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's leader, the first in one order of all texts."""
    central = members.groupBy("tk").agg(F.sum("k").alias("c"))
    ranked = members.join(central, "tk").select("bucket", "tk", "c")
    leader = ranked.groupBy("bucket").agg(F.max(F.struct("c", "tk")).alias("first")).select("bucket", F.col("first.tk").alias("b"))
    return _ordered(ranked.join(leader, "bucket").select(F.col("tk").alias("a"), "b"))


def still_mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, band, tk, k, label): the members of buckets that still hold two classes."""
    named = members.join(labels.select(F.col("node").alias("tk"), "label"), "tk")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket")
    return named.join(mixed, "bucket")


def chain(members: DataFrame, labels: DataFrame, p: NearParams) -> DataFrame:
    """(a, b): in buckets that still hold two classes, neighbours of different classes.

    The order is a bucket's own and random, cut into slices, so that a hot bucket is
    no hot task.
    """
    h = F.xxhash64("bucket", "tk")
    sliced = still_mixed(members, labels).withColumn("h", h).withColumn("slice", F.pmod(h, F.ceil(F.col("k") / 512)))
    ring = Window.partitionBy("bucket", "slice").orderBy("h", "tk")
    pairs = None
    for step in range(1, p.neighbours + 1):
        near = sliced.select(F.col("tk").alias("a"), F.lag("tk", step).over(ring).alias("b"), "label", F.lag("label", step).over(ring).alias("other"))
        near = near.filter("b IS NOT NULL AND label <> other").select("a", "b")
        pairs = near if pairs is None else pairs.unionByName(near)
    return _ordered(pairs)


def verified(pairs: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """Saved (a, b): the pairs whose exact similarity reaches the threshold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def of(key: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
            if key not in known:
                if len(known) >= 1000:
                    known.clear()
                known[key] = shingles([text], p.words)[1:]
            return known[key]

        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), raw(batch.column(3))]
        near = [similarity(of(a, ta), of(b, tb)) >= p.similarity for a, b, ta, tb in zip(*columns)]
        return pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    ta, tb = texts.select(F.col("tk").alias("a"), F.col("text").alias("ta")), texts.select(F.col("tk").alias("b"), F.col("text").alias("tb"))
    return saved(arrow_map(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb"), run, "a binary, b binary"), "near")


def cross_links(texts: list[bytes], classes_: list[bytes], bands: np.ndarray, band: int, n_left: int, p: NearParams) -> list[tuple[int, int]]:
    """Links that join the classes of a block, or of two: the first `n_left` texts are then compared with the others.

    Every pair of different classes whose first common bucket is that of `band` is
    tried, until a link has made them one; texts of small classes go first, so that a
    large class is met only by the others. Most pairs fail by an upper bound of J_P.
    With A and B the sums of all weights, the term of a common d is
    1 / (A / a_d + B / b_d - sum over e of min(a_e / a_d, b_e / b_d)); the sum is
    known where a_d = b_d, and at most each text's common weight over a_d or b_d.
    """
    parts = []
    for a, b in chunks([len(t) for t in texts], 2_000_000):
        d, h, w = shingles(texts[a:b], p.words)
        parts.append((d + a, h, w))
    docs, e, w = (np.concatenate(x) for x in zip(*parts))
    n, (vocab, at) = len(texts), np.unique(e, return_inverse=True)
    start, whole = np.searchsorted(docs, np.arange(n + 1)), np.bincount(docs, w, n)
    root = np.unique(np.array([c.hex() for c in classes_]), return_inverse=True)[1]
    one, found = np.zeros(len(vocab)), []
    two, right = n_left < n, np.arange(n) >= n_left
    open_ = np.ones(n, bool)
    for i in np.argsort(np.bincount(root)[root], kind="stable").tolist():
        open_[i] = False
        tried = open_ & (root != root[i])
        if two:
            tried &= right != right[i]
        js = np.flatnonzero(tried)
        js = js[~(bands[js, :band] == bands[i, :band]).any(1)] if band else js
        if not len(js):
            continue
        mine, sizes = slice(start[i], start[i + 1]), start[js + 1] - start[js]
        rest = np.repeat(start[js] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        one[at[mine]] = w[mine]
        x = one[at[rest]]
        one[at[mine]] = 0
        hit = np.flatnonzero(x)
        x, y, j = x[hit], w[rest[hit]], np.repeat(np.arange(len(js)), sizes)[hit]
        least, xs, ys = (np.bincount(j, v, len(js)) for v in (np.minimum(x, y), x, y))
        shared = np.where(x == y, least[j] / x, np.minimum(xs[j] / x, ys[j] / y))
        bound = np.bincount(j, 1 / (whole[i] / x + whole[js][j] / y - shared), len(js))
        for k in js[bound >= p.similarity - 1e-9].tolist():
            other = slice(start[k], start[k + 1])
            if root[k] != root[i] and similarity((e[mine], w[mine]), (e[other], w[other])) >= p.similarity:
                found.append((i, k))
                root[root == root[k]] = root[i]
    return found


def blocks_of(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """(task, second, band, tk, label): for each two blocks of a bucket that hold different classes, their members.

    A class larger than a block has blocks of its own, never compared with one another;
    the others share blocks. Buckets of the same members are compared once, in that of
    the first band.
    """
    twin = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("tk")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "tk")).alias("y")]
    once = mixed.groupBy("bucket", "band").agg(*twin).groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("first")).select("first.bucket")
    sized = mixed.join(once, "bucket").join(texts.select("tk", F.octet_length("text").alias("size")), "tk")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_BYTES), F.lit(1).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")]
    each = sized.groupBy("bucket", "label").agg(*sums).withColumn("parts", parts)
    pool = each.filter("parts = 1").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select("bucket", parts.alias("pool"))
    cut = each.select("bucket", "label", "parts").join(pool, "bucket", "left")
    own = F.col("parts") > 1
    owner = F.when(own, F.col("label")).otherwise(F.unhex(F.lit("")))
    slice_ = F.when(own, F.pmod(F.xxhash64("bucket", "tk"), "parts")).otherwise(F.pmod(F.xxhash64("bucket", "label"), "pool"))
    placed = saved(sized.join(cut, ["bucket", "label"]).select("bucket", "band", "tk", "label", F.struct(owner.alias("owner"), slice_.alias("slice")).alias("block")), "blocks")
    blocks = placed.select("bucket", "block").distinct()
    two = blocks.withColumnRenamed("block", "l").join(blocks.withColumnRenamed("block", "r"), "bucket")
    two = two.filter("l <= r AND (l.owner <> r.owner OR l.owner = X'')")
    name = F.concat_ws("-", "bucket", F.hex("l.owner"), "l.slice", F.hex("r.owner"), "r.slice")
    sides = F.array_distinct(F.array("l", "r"))
    task = two.select("bucket", F.unhex(F.md5(name.cast("binary"))).alias("task"), F.posexplode(sides).alias("second", "block"))
    dealt = task.join(placed, ["bucket", "block"]).select("task", "second", "band", "tk", "label")
    dealt._vecspark_path = placed._vecspark_path
    return dealt


def untried(members: DataFrame, labels: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """Saved (a, b): links found among all pairs of different classes that share a bucket."""

    def compared(rows: list[tuple]) -> pa.RecordBatch | None:
        tks, n_left = [r[3] for r in rows], sum(r[1] == 0 for r in rows)
        bands = np.frombuffer(b"".join(r[5] for r in rows), "<u8").reshape(len(rows), -1)
        found = cross_links([r[6] for r in rows], [r[4] for r in rows], bands, rows[0][2], n_left, p)
        if not found:
            return None
        return pa.record_batch([pa.array([max(tks[i], tks[k]) for i, k in found], pa.binary()), pa.array([min(tks[i], tks[k]) for i, k in found], pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(f"{__name__}.untried")
        rows: list[tuple] = []
        for batch in batches:
            for some in pieces(batch):
                for row in zip(*(some.column(i).to_pylist() for i in range(6)), raw(some.column(6))):
                    if rows and rows[0][0] != row[0]:
                        out, rows = compared(rows), []
                        if out is not None:
                            yield out
                    rows.append(row)
        out = compared(rows) if rows else None
        if out is not None:
            yield out

    mixed = saved(still_mixed(members, labels), "mixed")
    if mixed.isEmpty():
        release(mixed)
        return saved(members.select(F.col("tk").alias("a"), F.col("tk").alias("b")).filter("false"), "untried")
    blocks = blocks_of(mixed, texts)
    dealt = blocks.join(texts, "tk").select("task", "second", "band", "tk", "label", "bands", "text")
    out = saved(dealt.repartition("task").sortWithinPartitions("task", "second", "tk").mapInArrow(run, "a binary, b binary").distinct(), "untried")
    release(mixed, blocks)
    return out


def links(kd: DataFrame, reps: DataFrame, p: NearParams) -> tuple[list[DataFrame], DataFrame]:
    """Saved (a, b) of the three passes: verified links that connect each class; and (node, label) of all texts that share a bucket."""
    members = saved(members_of(reps, p), "buckets")
    texts = saved(texts_of(kd, reps.join(members.select("tk").distinct(), "tk").select("tk", "rep_id", "bands"), "bands"), "texts")
    first = verified(star(members), texts, p)
    of_first = components(first)
    labels = saved(texts.select(F.col("tk").alias("node")).join(of_first, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    release(of_first)
    second = verified(chain(members, labels, p), texts, p)
    labels = joined(labels, second)
    third = untried(members, labels, texts, p)
    labels = joined(labels, third)
    release(members, texts)
    return [first, second, third], labels


def text_classes(docs: DataFrame, p: NearParams, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and saved (tk, rep_id, label, class_id, n_links) of each different text.

    The label is one of the class's text digests; class_id is the least id in the class.
    """
    kd = keyed(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    signed_ = signed_bands(kd, p)
    reps = saved(signed_.groupBy("tk").agg(F.min("id").alias("rep_id"), F.first("bands").alias("bands")), "signatures")
    found, labels = links(kd, reps, p)
    ends = [x.select(F.col(side).alias("node")) for x in found for side in ("a", "b")]
    degree = reduce(DataFrame.union, ends).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = labels.join(degree, "node", "left").withColumnRenamed("node", "tk")
    each = reps.select("tk", "rep_id").join(linked, "tk", "left").select("tk", "rep_id", F.coalesce("label", "tk").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = each.groupBy("label").agg(F.min("rep_id").alias("class_id"))
    out = saved(each.join(ids, "label"), "classes")
    release(reps, *found, labels)
    return kd, out


def classes(docs: DataFrame, params: NearParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT columns: each document's class, its text's links and whether it stands for the class."""
    kd, each = text_classes(docs, params or NearParams(), id_col, text_col)
    got = kd.select("id", "tk").join(each.select("tk", "class_id", "n_links"), "tk")
    return got.select(F.col("id").alias("doc_id"), "class_id", F.col("n_links").cast("long"), F.col("id").eqNullSafe(F.col("class_id")).alias("representative"))


def one_of_each(docs: DataFrame, params: NearParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, with all its columns, one row of each class: that of the least id.

    Where rows repeat that id, one of them stays.
    """
    _, each = text_classes(docs, params or NearParams(), id_col, text_col)
    best = each.groupBy("label").agg(F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "tk")).alias("best"))
    key = unused(docs, "key")
    stay = best.select(row_key(F.col("best.rep_id"), F.col("best.tk")).alias(key))
    text = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.withColumn(key, row_key(F.col(id_col).cast("long"), text)).join(stay, key)
    return rows.dropDuplicates([key]).select(*docs.columns)
