"""Shared-folder, Arrow and representative-row helpers of the llm operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder every executor and the driver can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local master,
    as in tests, may leave it unset and gets a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.environ.get("VECSPARK_LOCAL_SHARED")
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="vecspark-")
            os.environ["VECSPARK_LOCAL_SHARED"] = root
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Scratch folders not deleted yet; what a returned frame still reads goes when the driver ends.
_FOLDERS: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh, unused folder name in the shared folder."""
    folder = f"{shared_root(spark)}/vecspark/{name}-{uuid.uuid4().hex}"
    _FOLDERS.add(folder)
    return folder


@atexit.register
def _clear() -> None:
    for folder in list(_FOLDERS):
        with contextlib.suppress(OSError):
            remove(folder)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    The files survive lost executors, unlike cached blocks. The shuffles that led to
    them are of no more use, and Spark deletes those files once the driver's garbage
    is collected, which is asked for here.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._vecspark_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of `saved` frames that nothing reads any more."""
    for df in frames:
        remove(df._vecspark_path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and plain path of a folder URI."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return pafs.LocalFileSystem(), uri


def remove(uri: str) -> None:
    """Delete a scratch folder, if it is there."""
    _FOLDERS.discard(uri)
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


#: What clears a worker's memories when it turns to other work, and the work it did last.
CLEARERS: list[Callable[[], None]] = []
_WORK: list[str] = [""]


def enter(work: str) -> None:
    """A reused Python worker starts some work: what it remembered for other work goes."""
    if _WORK[0] != work:
        _WORK[0] = work
        for clear in CLEARERS:
            clear()


#: Bytes of columns that a function of `arrow_map` gets at once; a longer row comes alone.
PIECE_BYTES = 4_000_000


def _row_bytes(column: pa.Array) -> np.ndarray:
    """About the bytes of each row of a column; exact for text and binary."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return n * max(8, column.values.nbytes // max(1, len(column.values)))
    return np.full(len(column), 8, np.int64)


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `limit` bytes, or one row."""
    if batch.nbytes <= limit or batch.num_rows < 2:
        yield batch
        return
    ends = np.cumsum(sum(_row_bytes(c) for c in batch.columns))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of a bounded piece of a batch, which may return None."""

    work = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(work)
        for batch in batches:
            for piece in pieces(batch):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many parts as there are cores.

    Only an input that its files cut into fewer is dealt anew, so no large one is:
    work on each row costs more than moving a small table.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    piece = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < piece * cores else df


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, tk): null text is empty, tk is the 16-byte digest of the text.

    Only these three columns are kept, so extra input columns cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spread(docs.select(F.col(id_col).alias("id"), text.alias("text")))
    return rows.select("id", "text", F.unhex(F.md5("text")).alias("tk"))


def representatives(kd: DataFrame) -> DataFrame:
    """(tk, rep_id, copies): one row for each different text.

    A hash aggregate with partial sums: a text that fills a third of the rows
    costs one row for each map task.
    """
    return kd.groupBy("tk").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))


def row_key(id_col: Column, tk: Column) -> Column:
    """One key of (id, digest), null ids included."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary"), tk)))


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(kd: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """(tk, text, more) of the representative rows in `nodes` (tk, rep_id, more), once each."""
    rows = kd.select(row_key(F.col("id"), F.col("tk")).alias("k"), "tk", "text")
    got = rows.join(nodes.select(row_key(F.col("rep_id"), F.col("tk")).alias("k"), *more), "k")
    return got.dropDuplicates(["k"]).select("tk", "text", *more)
