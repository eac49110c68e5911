"""Every row against every query of its part, block by block in numpy.

Rows and queries travel packed, some megabytes a row, and meet in a join. A matrix
product finds which rows can be among a query's k nearest; their distances are then
computed as `functions.vectors` does, term by term, so copies tie and no neighbour is
lost to rounding. A pair whose distance is null (a null element, another length, a zero
norm under cosine) stays, with null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vectors import EPSILON

PACK = "part long, dim int, ids binary, x binary"
HITS = "part long, query_id long, doc_id long, distance double"
#: Bytes of a packed row of the corpus, of what a task gathers before it packs, and of one step's matrices.
CHUNK_BYTES, HELD_BYTES, STEP_BYTES = 1 << 20, 64 << 20, 16 << 20
#: Columns whose least stands for them where a k-th least is bounded.
GROUP = 16
#: The id that stands for null inside.
NO_ID = -(1 << 63)


def _sum(terms: np.ndarray) -> np.ndarray:
    """The sum of each row from the first term to the last, as an aggregate adds."""
    s = np.zeros(len(terms))
    for i in range(terms.shape[1]):
        s += terms[:, i]
    return s


def flat(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists: their lengths (-1: a null in it, or none), all their elements, and where each list ends in these."""
    n = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    x, ends = pc.list_flatten(v).cast(pa.float64()), np.cumsum(np.maximum(n, 0))
    if x.null_count:
        holes = np.flatnonzero(pc.is_null(x).to_numpy(zero_copy_only=False))
        n[np.searchsorted(ends, holes, "right")] = -1
    return n, pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False), ends


def _packer(most: int | None):
    """Rows (part, id, vector) as PACK, by part and length; `most` bytes a row, or all in one. Length -1: a null in it, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        total = 0

        def out(key):
            ids, x = zip(*held.pop(key), strict=True)
            return pa.RecordBatch.from_pydict({"part": [key[0]], "dim": [key[1]], "ids": [b"".join(ids)], "x": [b"".join(x)]}, pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())]))

        for b in batches:
            parts, ids, v = (b.column(i) for i in range(3))
            keep = pc.is_valid(parts)
            if not pc.all(keep).as_py():
                parts, ids, v = parts.filter(keep), ids.filter(keep), v.filter(keep)
            dims, x, ends = flat(v)
            parts, ids = parts.to_numpy(zero_copy_only=False), pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False)
            order = np.lexsort((dims, parts))
            cuts = np.flatnonzero((np.diff(parts[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
            for at in np.split(order, cuts) if len(order) else []:
                at.sort()
                key = int(parts[at[0]]), int(dims[at[0]])
                step = len(at) if most is None else max(1, most // (8 * max(1, key[1])))
                for some in (at[i : i + step] for i in range(0, len(at), step)):
                    w = x[(ends[some] - key[1])[:, None] + np.arange(key[1])] if key[1] > 0 else x[:0]
                    held.setdefault(key, []).append((ids[some].tobytes(), w.tobytes()))
                    total += 8 * len(some) + w.nbytes
                    if most is not None and sum(len(p[0]) + len(p[1]) for p in held[key]) >= most:
                        total -= sum(len(p[0]) + len(p[1]) for p in held[key])
                        yield out(key)
            if most is not None and total >= HELD_BYTES:
                for key in list(held):
                    yield out(key)
                total = 0
        for key in list(held):
            yield out(key)

    return run


def packed(df: DataFrame, part: str | None, key: str, vector: str, most: int | None = CHUNK_BYTES) -> DataFrame:
    p = F.col(part).cast("long") if part else F.lit(0).cast("long")
    return df.select(p.alias("part"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_packer(most), PACK)


class Exact:
    """A metric of `functions.vectors` between the rows x and the queries q, both of one length."""

    def __init__(self, metric: str, q: np.ndarray):
        self.metric, self.q = "l2" if metric == "euclidean" else metric, q
        with np.errstate(all="ignore"):
            self.square = _sum(q * q)
        self.norm = np.sqrt(self.square)

    def chunk(self, x: np.ndarray) -> None:
        self.x = x
        self.x_square = _sum(x * x)
        self.x_norm = np.sqrt(self.x_square)
        # Rows and queries whose every distance is null, and those that a matrix product may not judge.
        self.null = self.x_norm == 0 if self.metric == "cosine" else np.zeros(len(x), bool)
        self.q_null = self.norm == 0 if self.metric == "cosine" else np.zeros(len(self.q), bool)
        sane = lambda s: (s < 1e100) & ((s > 1e-100) | (s == 0))
        self.odd, self.q_odd = ~sane(self.x_square), ~sane(self.square)

    def near(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """About the distances (for l2 their squares) of the queries a..b to all rows, and the most that they are wrong by."""
        s, n, m = self.q[a:b] @ self.x.T, self.norm[a:b, None], self.x_norm[None, :]
        u = 4e-16 * (self.q.shape[1] + 16)
        if self.metric == "l2":
            s *= -2
            s += self.x_square
            s += self.square[a:b, None]
            most = np.max(self.x_norm[~self.odd], initial=0)
            return s, u * (self.norm[a:b] + most) ** 2
        if self.metric == "dot":
            most = np.max(self.x_norm[~self.odd], initial=0)
            return np.negative(s, out=s), u * self.norm[a:b] * most
        by = n * m
        if self.metric == "cosine_eps":
            by += EPSILON
        elif self.metric == "cosine_batch":
            by = (n + EPSILON) * (m + EPSILON)
        s /= by
        return np.subtract(1, s, out=s), np.full(b - a, 4 * u)

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The distances of the queries i to the rows j, pair by pair."""
        out = np.empty(len(i))
        step = max(1, STEP_BYTES // (8 * max(1, self.q.shape[1])))
        for a in range(0, len(i), step):
            at, to = i[a : a + step], j[a : a + step]
            q, x = self.q[at], self.x[to]
            if self.metric == "l2":
                out[a : a + step] = np.sqrt(_sum((q - x) * (q - x)))
                continue
            dot = _sum(q * x)
            if self.metric == "dot":
                out[a : a + step] = -dot
            elif self.metric == "cosine":
                out[a : a + step] = 1 - dot / (self.norm[at] * self.x_norm[to])
            elif self.metric == "cosine_eps":
                out[a : a + step] = 1 - dot / (self.norm[at] * self.x_norm[to] + EPSILON)
            else:
                out[a : a + step] = 1 - dot / ((self.norm[at] + EPSILON) * (self.x_norm[to] + EPSILON))
        return out

    def bound(self, d: np.ndarray) -> np.ndarray:
        """Distances on the scale of `near`."""
        return d * d * (1 + 1e-15) if self.metric == "l2" else d


class Codes(Exact):
    """The asymmetric distance of codes to the queries q by codebooks [m][code, element]: about the l2 of the vectors that the codes stand for."""

    def __init__(self, books: list[np.ndarray], q: np.ndarray):
        super().__init__("l2", q[:, : sum(b.shape[1] for b in books)])
        self.books = books

    def chunk(self, x: np.ndarray) -> None:
        x = x.astype(np.int64)
        super().chunk(np.concatenate([b[x[:, m]] for m, b in enumerate(self.books)], 1))

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The root of the squared distances in the subspaces, added in their order."""
        out = np.empty(len(i))
        m = len(self.books)
        step = max(1, STEP_BYTES // (8 * self.q.shape[1]))
        for a in range(0, len(i), step):
            d = self.q[i[a : a + step]] - self.x[j[a : a + step]]
            t = np.sqrt(_sum((d * d).reshape(len(d) * m, -1))).reshape(-1, m)
            out[a : a + step] = np.sqrt(_sum(t * t))
        return out


def _kth(near: np.ndarray, k: int) -> np.ndarray:
    """What the k-th least of each row is at most: the k-th least of the least of GROUP columns each, infinite where there is none."""
    groups = near.shape[1] // GROUP
    if groups >= k:
        near = near[:, : groups * GROUP].reshape(len(near), GROUP, groups).min(1)
    if near.shape[1] < k:
        return np.full(len(near), np.inf)
    most = np.partition(near, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(most), np.inf, most)


class Nearest:
    """The k nearest so far of each query of a pack."""

    def __init__(self, part: int, ids: np.ndarray, scorer, k: int, other: bool):
        self.part, self.ids, self.scorer, self.k, self.other = part, ids, scorer, k, other
        self.last = np.full(len(ids), np.inf)
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        self.size = 0

    def put(self, i, j, d, null) -> None:
        """More pairs: query, id, distance, whether that is null; nulls come first, as Spark sorts."""
        if self.other:
            keep = self.ids[i] != j
            i, j, d, null = i[keep], j[keep], d[keep], null[keep]
        self.kept.append((i, j, d, null))
        self.size += len(i)
        if self.size > 4 * self.k * len(self.ids):
            self.settle()

    def settle(self) -> None:
        i, j, d, null = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((j, d, ~null, i) if null.any() else (j, d, i))
        i = i[order]
        start = np.searchsorted(i, i)
        first = order[np.arange(len(i)) - start < self.k]
        i, j, d, null = (np.concatenate(x)[first] for x in zip(*self.kept, strict=True))
        self.kept, self.size = [(i, j, d, null)], len(i)
        n = np.bincount(i, minlength=len(self.ids))
        full = n >= self.k
        ends = np.cumsum(n) - 1
        at = ends[full]
        self.last[full] = np.where(null[at], -np.inf, np.where(np.isnan(d[at]), np.inf, d[at]))

    def nulls(self, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Rows whose distance to the queries (None: all) is null: the least ids are enough."""
        least = np.sort(ids)[: self.k + 1]
        at = np.arange(len(self.ids)) if queries is None else queries
        i, j = np.repeat(at, len(least)), np.tile(least, len(at))
        self.put(i, j, np.zeros(len(i)), np.ones(len(i), bool))

    def chunk(self, ids: np.ndarray, x: np.ndarray) -> None:
        s = self.scorer
        with np.errstate(all="ignore"):
            s.chunk(x)
            if s.null.any():
                self.nulls(ids[s.null])
            if s.q_null.any():
                self.nulls(ids[~s.null], np.flatnonzero(s.q_null))
            step, k = max(1, (STEP_BYTES >> 4) // (8 * len(ids))), self.k + self.other
            apart, some = s.null | s.odd, bool(s.null.any() or s.odd.any())
            for a in range(0, len(self.ids), step):
                b = min(len(self.ids), a + step)
                near, wrong = s.near(a, b)
                if some:
                    near[:, apart] = np.inf
                most = s.bound(self.last[a:b])
                if not np.isfinite(most).all():
                    most = np.minimum(most, _kth(near, k))
                most = most + 2 * wrong + 4e-15 * np.abs(most, where=np.isfinite(most), out=np.zeros(b - a))
                take = near > most[:, None]
                np.logical_not(take, out=take)
                if some or s.q_null[a:b].any() or s.q_odd[a:b].any():
                    take |= s.odd | s.q_odd[a:b, None]
                    take &= ~s.null & ~s.q_null[a:b, None]
                i, j = np.divmod(np.flatnonzero(take), len(ids))
                self.put(i + a, ids[j], s.distance(i + a, j), np.zeros(len(i), bool))
        self.settle()

    def hits(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        i, j, d, null = self.kept[0]
        for a in range(0, len(i), 100_000):
            at = slice(a, a + 100_000)
            yield _hits(self.part, self.ids[i[at]], j[at], d[at], null[at])


def _hits(part, q, j, d, null) -> pa.RecordBatch:
    id_ = lambda v: pa.array(v, mask=v == NO_ID)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), part)), id_(q), id_(j), pa.array(d, mask=null)], ["part", "query_id", "doc_id", "distance"])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each joined row: part, the rows' length, ids and vectors, and the same of the queries."""
    ints = lambda b: np.frombuffer(b, np.int64)
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            get = lambda n: col[n][r].as_buffer() if pa.types.is_binary(col[n].type) else col[n][r].as_py()  # noqa: E731, B023
            ids, q_ids = ints(get("ids")), ints(get("q_ids"))
            x, q = np.frombuffer(get("x")), np.frombuffer(get("q_x"))
            yield get("part"), get("dim"), ids, x.reshape(len(ids), -1) if get("dim") >= 0 else None, get("q_dim"), q_ids, q.reshape(len(q_ids), -1) if get("q_dim") >= 0 else None


class Bounds:
    """What the k-th nearest of each query id is at most, over all parts that a task has seen."""

    def __init__(self):
        self.ids, self.last = np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray) -> None:
        every = np.union1d(self.ids, ids)
        last = np.full(len(every), np.inf)
        last[np.searchsorted(every, self.ids)] = self.last
        self.ids, self.last = every, last

    def lower(self, n: Nearest) -> None:
        n.last = np.minimum(n.last, self.last[np.searchsorted(self.ids, n.ids)])

    def learn(self, n: Nearest) -> None:
        np.minimum.at(self.last, np.searchsorted(self.ids, n.ids), n.last)


def _merged(found: list[Nearest], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query id in all of `found`, as of part 0."""
    for n in found:
        n.settle()
    kept = [(n.ids[i], j, d, null) for n in found for i, j, d, null in n.kept]
    if not kept:
        return
    q, j, d, null = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((j, d, ~null, q))
    q = q[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, order = q[first], order[first]
    for a in range(0, len(q), 100_000):
        at = order[a : a + 100_000]
        yield _hits(0, q[a : a + 100_000], j[at], d[at], null[at])


def _searcher(metric: str, k: int, other: bool, merged: bool, books: list[np.ndarray] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, bytes], Nearest] = {}
        bounds = Bounds()
        for part, dim, ids, x, q_dim, q_ids, q in _packs(batches):
            key = part, q_dim, q_ids[:1].tobytes()
            if key not in found:
                q = None if q is None else q.copy()
                scorer = None if q is None else Codes(books, q) if metric == "codes" else Exact(metric, q)
                found[key] = Nearest(part, q_ids.copy(), scorer, k, other)
                bounds.add(q_ids)
            n = found[key]
            if merged:
                bounds.lower(n)
            if x is None or n.scorer is None or (metric != "codes" and dim != q_dim) or (metric == "codes" and dim != len(n.scorer.books)):
                n.nulls(ids)
                n.settle()
            else:
                n.chunk(ids, x)
            if merged:
                bounds.learn(n)
        if merged:
            yield from _merged(list(found.values()), k)
        else:
            for n in found.values():
                yield from n.hits()

    return run


def unpacked(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each packed row of vectors."""
    for batch in batches:
        ids, x = (batch.column(batch.schema.get_field_index(n)) for n in ("ids", "x"))
        for i, v in zip(ids, x, strict=True):
            i = np.frombuffer(i.as_buffer(), np.int64)
            yield i, np.frombuffer(v.as_buffer()).reshape(len(i), -1)


def dealt(packs: DataFrame) -> DataFrame:
    """Packed rows over all cores."""
    s = packs.sparkSession
    return packs.repartition(max(2 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions"))))


def _met(rows: DataFrame, queries: DataFrame, by_part: bool) -> DataFrame:
    """Packed rows, dealt out over all cores, beside packed queries."""
    rows = dealt(rows)
    asked = queries.select(F.col("part").alias("q_part"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    asked = F.broadcast(asked)
    met = rows.join(asked, F.col("part") == F.col("q_part")) if by_part else rows.crossJoin(asked)
    return met.drop("q_part")


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str, part: str | None = None, query_part: str | None = None, other: bool = False, vector: str = "vector", books: list[np.ndarray] | None = None, merged: bool = False) -> DataFrame:
    """HITS: for each task and part at least the k nearest of each query; the caller ranks them.

    merged: k for each task and query, whatever the parts, which HITS then has as 0.
    part: a column of the corpus; with it every query is asked of every part, or, with
    query_part too, of the part it names. Ids are whole numbers. `other` leaves out the row of the query's own id.
    queries: few enough to be broadcast. books: of codes, whose packs are as large as those of the vectors that they stand for.
    """
    most = CHUNK_BYTES // books[0].shape[1] if books else CHUNK_BYTES
    asked = packed(queries.repartition(1), query_part, "query_id", "query_vector", None)
    met = _met(packed(corpus, part, "doc_id", vector, most), asked, query_part is not None)
    return met.mapInArrow(_searcher(metric, k, other, merged, books), HITS)


def _all(digits: int):
    """1 / (1 + l2) of all pairs, rounded half away from zero; what is near a half is computed anew, term by term."""
    unit = 10.0**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, dim, ids, x, q_dim, q_ids, q in _packs(batches):
            same = x is not None and q is not None and dim == q_dim
            s = Exact("l2", q) if same else None
            with np.errstate(all="ignore"):
                if same:
                    s.chunk(x)
                step = max(1, (STEP_BYTES >> 3) // (8 * len(ids)))
                for a in range(0, len(q_ids), step):
                    b = min(len(q_ids), a + step)
                    d, null = np.zeros((b - a, len(ids))), np.ones((b - a) * len(ids), bool)
                    if same:
                        d, wrong = s.near(a, b)
                        wrong = 4 * wrong[:, None]
                        score = 1 / (1 + np.sqrt(np.maximum(d, 0)))
                        t = score * unit
                        low = np.floor(t)
                        # The root is wrong by at most wrong / (2 root), or by the root of wrong.
                        err = unit * np.minimum(wrong / np.sqrt(np.maximum(d, 0)), np.sqrt(wrong)) + 1e-9
                        again = ~(np.abs(t - low - 0.5) > err) | ~(d > 4 * wrong) | s.odd | s.q_odd[a:b, None]
                        i, j = np.nonzero(again)
                        t[i, j] = 1 / (1 + s.distance(i + a, j)) * unit
                        low = np.floor(t)
                        d, null = (low + (t - low >= 0.5)) / unit, None
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[a:b], len(ids))), pa.array(np.tile(ids, b - a)), pa.array(d.ravel(), mask=null)], ["query_id", "doc_id", "score"])

    return run


def similarities(corpus: DataFrame, queries: DataFrame, digits: int) -> DataFrame:
    """(query_id, doc_id, score) of all pairs, score 1 / (1 + l2) to so many places."""
    met = _met(packed(corpus, None, "doc_id", "vector"), packed(queries.repartition(1), None, "query_id", "query_vector", None), False)
    return met.mapInArrow(_all(digits), "query_id long, doc_id long, score double")
