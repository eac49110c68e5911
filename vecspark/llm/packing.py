"""Best-fit packing of tokenised documents into fixed-length sequences.

Every document is cut into pieces of at most the token capacity. Pieces are dealt
by a hash, of themselves and their row's place, into groups of about `group_docs`
documents each, and every group is packed on its own, so memory is bounded however
often a row repeats; what grouping costs is at most the last bin of each group.

Inside a group the pieces go, longest first, each into the open bin that a vector
best-fit rule selects: of the bins whose residual token, document-count and
attention-cost capacities all hold the piece, the one whose weighted residual norm
would be least ("norm") or whose residual has the largest weighted dot product with
the piece ("dot"). Attention cost is the sum of squared piece lengths. Ties go to
the oldest bin. A piece that alone costs more than the attention capacity has a
sequence to itself.

Defined cases: null and empty texts are documents of one end id; repeated rows are
packed as often as they occur; a null doc_id stays null; an empty table gives an
empty result; other input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._shared import arrow_map, spread
from vecspark.llm._tokens import crc, encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@dataclass(frozen=True)
class PackParams:
    """Capacities of a sequence, and how a bin is selected.

    With the default document and attention capacities, which the registered query and
    the pipeline have, only tokens bind: a piece has a token at least, and a sum of
    squares is at most the squared sum.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"
    group_docs: int = 2048

    def __post_init__(self):
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {self.rule!r}")

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


def cut(df: DataFrame, path: str, tokens: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each tokenised document: PIECES columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        out: list[list] = [[], [], [], [], []]
        for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_many(texts)):
            ids = np.append(ids, end_id)
            for k, start in enumerate(range(0, len(ids), tokens)):
                part = ids[start : start + tokens]
                for column, value in zip(out, (doc, k, start, len(part), crc(part))):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(spread(df.select(F.col(id_col).cast("long"), F.col(text_col))), run, PIECES)


def best_fit(lengths: np.ndarray, p: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; vector best-fit, longest first."""
    cap, weights = p.capacity, np.array(p.weights)
    n = len(lengths)
    left = np.zeros((n, 3))
    bins, offsets, opened = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        open_ = left[:opened]
        fits = np.flatnonzero((open_[:, 0] >= need[0]) & (open_[:, 1] >= 1) & (open_[:, 2] >= need[2]))
        if len(fits):
            rest = open_[fits]
            if p.rule == "norm":
                at = fits[np.argmin(((((rest - need) / cap) ** 2) * weights).sum(1))]
            else:
                at = fits[np.argmax(((rest / cap) * (need / cap) * weights).sum(1))]
        else:
            at, opened = opened, opened + 1
            left[at] = cap
        bins[i], offsets[i] = at, cap[0] - left[at, 0]
        left[at] -= need
    return bins, offsets


def pack_pieces(pieces: DataFrame, groups: int, p: PackParams) -> DataFrame:
    """Deal pieces into groups and pack each: PACKED columns."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), p)
        return pdf.drop(columns="g").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    # The place tells repeated rows apart: no group gets all copies of one.
    g = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("g", g).groupBy("g").applyInPandas(run, PACKED)


def pack(df: DataFrame, params: PackParams | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack every document of `df`: PACKED columns."""
    p = params or PackParams()
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    groups = max(1, -(-df.count() // p.group_docs))
    return pack_pieces(cut(df, path, p.tokens, 0, id_col, text_col), groups, p)
