"""Product quantization: codebooks, codes, and asymmetric distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import vectors
from vecspark.operators import scan
from vecspark.operators.knn import blocks, top_k

MB = 1024.0 * 1024.0
#: Rows for each centroid among which training looks for its first centroids; rows encoded at once; tasks whose sums the driver adds up.
STARTS, ENCODED, GATHERED = 16, 1_024, 64
SUMS = "m int, n binary, s binary"


@dataclass(frozen=True)
class PqParams:
    dim: int
    m: int = 8
    n_bits: int = 8

    def __post_init__(self):
        if self.dim % self.m:
            raise ValueError(f"dimension {self.dim} is not divisible by M={self.m}")

    @property
    def width(self) -> int:
        return self.dim // self.m

    @property
    def centroids(self) -> int:
        return 2**self.n_bits

    @property
    def ratio(self) -> float:
        return self.dim * 32 / (self.m * self.n_bits)


def subvectors(df: DataFrame, p: PqParams, *keep: str) -> DataFrame:
    """One row for each subspace: m and the slice `sub`."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(p.m - 1)), lambda i: F.struct(i.alias("m"), F.slice(vectors.doubles(F.col("vector")), i * p.width + 1, F.lit(p.width)).alias("sub")))
    return df.select(*keep, F.inline(parts))


def _spread(start: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: up to k different rows of `start`, each drawn by its squared distance to those before."""
    rng, found = np.random.default_rng(seed), []
    far = np.ones(len(start))
    while len(found) < k and far.sum() > 0:
        c = start[min(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), "right"), len(start) - 1)]
        if found and not far[(start == c).all(1)].any():
            break
        d = ((start - c) ** 2).sum(1)
        found.append(c)
        far = np.minimum(far, d) if len(found) > 1 else d
    return np.array(found).reshape(-1, start.shape[1])


def _sums(books: list[np.ndarray]):
    """Of packed rows, SUMS: for each subspace, by code, the numbers and the sums of the sub-vectors nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape) for b in books]
        for _, x in scan.unpacked(batches):
            for m, b in enumerate(books):
                w = b.shape[1]
                sub = x[:, m * w : (m + 1) * w]
                at = ((b * b).sum(1) - 2 * (sub @ b.T)).argmin(1)
                n[m] += np.bincount(at, minlength=len(b))
                for i in range(w):
                    total[m][:, i] += np.bincount(at, sub[:, i], len(b))
        rows = [(m, c.tobytes(), t.tobytes()) for m, (c, t) in enumerate(zip(n, total, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["m", "n", "s"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of several tasks added up."""
    found: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for m, n, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            each = np.frombuffer(n, np.int64), np.frombuffer(s)
            found[m] = [x + y for x, y in zip(found[m], each, strict=True)] if m in found else list(each)
    for m, (n, s) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([n.tobytes()]), pa.array([s.tobytes()])], ["m", "n", "s"])


def train(corpus: DataFrame, p: PqParams, seed: int = 42) -> DataFrame:
    """Codebook (m, code, centroid): k-means of each subspace, all in one pass over all rows an iteration, 15 at most.

    First centroids come by k-means++, seeds seed + m, from rows chosen by hash, about STARTS for each
    centroid. Rows that are null, of another length or not finite teach nothing.
    """
    sized = F.size("vector") == p.dim
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = corpus.select("doc_id", vectors.doubles(F.col("vector")).alias("vector")).filter(F.coalesce(sized & finite, F.lit(False)))
    packs = scan.dealt(scan.packed(rows, None, "doc_id", "vector")).persist()
    n = packs.agg(F.sum(F.length("ids")) / 8).first()[0] or 0
    share = F.lit(min(1.0, STARTS * p.centroids / max(n, 1)))
    first = sorted((r.doc_id, r.vector) for r in rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) < share * (1 << 40)).collect())
    start = np.array([v for _, v in first]).reshape(-1, p.dim)
    books = [_spread(start[:, m * p.width : (m + 1) * p.width], p.centroids, seed + m) for m in range(p.m)]
    tasks = packs.rdd.getNumPartitions()
    for _ in range(15):
        sums = packs.mapInArrow(_sums(books), SUMS)
        if tasks > GATHERED:
            sums = sums.repartition(p.m, "m").mapInArrow(_added, SUMS)
        rows = sums.toArrow().to_batches()
        moved = 0.0
        for one in _added(rows):
            m, n, s = (c[0].as_py() for c in one.columns)
            n, s = np.frombuffer(n, np.int64), np.frombuffer(s).reshape(books[m].shape)
            has = n > 0
            c = s[has] / n[has, None]
            moved = max(moved, ((c - books[m][has]) ** 2).sum(1).max(initial=0.0))
            books[m][has] = c
        if moved <= 1e-8:
            break
    packs.unpersist()
    learnt = [(m, i, c.tolist()) for m, b in enumerate(books) for i, c in enumerate(b)]
    return corpus.sparkSession.createDataFrame(learnt, "m int, code int, centroid array<double>")


def codebook_from(corpus: DataFrame, p: PqParams, n: int) -> DataFrame:
    """A codebook of the sub-vectors of the n least ids, which are read at once."""
    first = corpus.orderBy("doc_id").limit(n).select("doc_id", vectors.doubles(F.col("vector")).alias("vector")).collect()
    cut = lambda v, m: None if v is None else v[m * p.width : (m + 1) * p.width]
    m, code, centroid = ([r[i] for r in ((m, c, cut(row.vector, m)) for m in range(p.m) for c, row in enumerate(first))] for i in range(3))
    arrays = pa.array(m, pa.int32()), pa.array(code, pa.int32()), pa.array(centroid, pa.list_(pa.float64()))
    return corpus.sparkSession.createDataFrame(pa.Table.from_arrays(arrays, ["m", "code", "centroid"]))


def _packed(codebook: DataFrame) -> DataFrame:
    """The codebook in one row: books[m] = [(code, centroid)]; M * 2^n_bits rows at most."""
    books = codebook.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("book"))
    return books.agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "book"))), lambda b: b["book"]).alias("_books"))


def _books(codebook: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The codebook on the driver: of each m the centroids by code, and the codes; M * 2^n_bits rows at most."""
    book: dict[int, list] = {}
    for r in sorted(codebook.select("m", "code", "centroid").collect(), key=lambda r: (r.m, r.code)):
        book.setdefault(r.m, []).append((r.code, r.centroid))
    return [np.array([c for _, c in b], np.float64) for b in book.values()], [np.array([i for i, _ in b], np.int32) for b in book.values()]


def _filled(v: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of `dim` numbers, what they lack not a number."""
    n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.fill_null(pc.list_flatten(v).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    if (n == dim).all():
        return x.reshape(-1, dim)
    out, i = np.full((len(n), dim), np.nan), np.arange(dim)
    there = i < n[:, None]
    out[there] = x[((np.cumsum(n) - n)[:, None] + i)[there]]
    return out


def _nearest_exactly(sub: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The row of the book nearest to each row, term by term as `functions.vectors` has it; the first on ties."""
    with np.errstate(all="ignore"):
        d = np.zeros((len(sub), len(book)))
        for i in range(sub.shape[1]):
            t = sub[:, i, None] - book[None, :, i]
            d += t * t
        d = np.sqrt(d)
    at = np.where(np.isnan(d), np.inf, d).argmin(1)
    low = d[np.arange(len(at)), at]
    odd = np.isinf(low) | np.isnan(low)
    at[odd] = np.isnan(d[odd]).argmin(1)  # not a number sorts last
    return at


def _nearest(sub: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The same by a matrix product; where that leaves more than one, or may not judge, term by term."""
    sane = lambda s: (s < 1e100) & ((s > 1e-100) | (s == 0))
    with np.errstate(all="ignore"):
        square, own = (book * book).sum(1), (sub * sub).sum(1)
        if not sane(square).all():
            return _nearest_exactly(sub, book)
        d = sub @ (-2 * book.T)
        d += square
        at = d.argmin(1)
        wrong = 4e-16 * (sub.shape[1] + 16) * (np.sqrt(own) + np.sqrt(square.max())) ** 2
        again = ((d <= (d[np.arange(len(at)), at] + 4 * wrong)[:, None]).sum(1) > 1) | ~sane(own)
    if again.any():
        at[again] = _nearest_exactly(sub[again], book)
    return at


def _encoder(books: list[np.ndarray], of: list[np.ndarray], p: PqParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _filled(batch.column(1), p.dim)
            codes = np.empty((len(x), len(books)), np.int32)
            for a in range(0, len(x), ENCODED):
                for m, (book, code) in enumerate(zip(books, of, strict=True)):
                    codes[a : a + ENCODED, m] = code[_nearest(x[a : a + ENCODED, m * p.width : (m + 1) * p.width], book)]
            each = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, len(books), dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), each], ["doc_id", "codes"])

    return run


def encode(corpus: DataFrame, codebook: DataFrame, p: PqParams) -> DataFrame:
    """(doc_id, codes): nearest centroid of each subspace, the least code on ties or where there is no distance.

    Ids are whole numbers. The codebook is read at once; rows are encoded where they are, and distances are those of `functions.vectors`.
    """
    rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "vector")
    return rows.mapInArrow(_encoder(*_books(codebook), p), "doc_id long, codes array<int>")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """(doc_id, vector): the concatenated centroids of the codes; no shuffle."""
    at = lambda c, i: F.filter(F.col("_books")[i], lambda x: x["code"] == c)[0]["centroid"]
    return codes.crossJoin(F.broadcast(_packed(codebook))).select("doc_id", F.flatten(F.transform("codes", at)).alias("vector"))


def distance_table(queries: DataFrame, codebook: DataFrame, p: PqParams) -> DataFrame:
    """(query_id, m, code, distance) of every centroid to the query's sub-vectors."""
    q = subvectors(queries.select("query_id", F.col("query_vector").alias("vector")), p, "query_id")
    return q.join(F.broadcast(codebook), "m").select("query_id", "m", "code", vectors.euclidean(F.col("sub"), F.col("centroid")).alias("distance"))


def search(codes: DataFrame, queries: DataFrame, codebook: DataFrame, p: PqParams, k: int) -> DataFrame:
    """(query_id, doc_id, distance, rank) by asymmetric distance; the codebook is read at once."""
    out, (books, _) = None, _books(codebook)
    for q in blocks(queries):
        hits = scan.nearest(codes, q, k, "codes", vector="codes", books=books)
        near = top_k(hits.drop("part"), "query_id", k, F.col("distance"), F.col("doc_id"))
        out = near if out is None else out.unionByName(near)
    return out


def memory(corpus: DataFrame, p: PqParams) -> DataFrame:
    """Megabytes of vectors, codes and codebook, and the compression ratio: one row; a code takes one byte, or two beyond 8 bits."""
    n = F.count(F.lit(1)).cast("double")
    original, compressed, book = n * p.dim * 4 / MB, n * p.m * (1 if p.n_bits <= 8 else 2) / MB, F.lit(p.m * p.centroids * p.width * 4 / MB)
    return corpus.agg(original.alias("original_mb"), compressed.alias("compressed_mb"), book.alias("codebook_mb"), (compressed + book).alias("total_mb"), (original / (compressed + book)).alias("compression_ratio"))
