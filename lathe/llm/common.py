"""Shared helpers of the training-data operators.

Shapes used everywhere: a *buffer* is the UTF-8 bytes of several texts end to
end with int64 offsets, so numpy works on many texts at once; a *cut* is a
table written to the shared checkpoint folder, which ends lineage in a form any
executor can read again after another is lost.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: The same pattern for Java regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that numpy handles at once, so that memory doesn't grow with the batch.
CHUNK_BYTES = 2 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where none is set, a session in one process (master ``local``) takes a folder
    under /tmp; on a cluster this raises, since executors would not share it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = found.get() if found.isDefined() else None
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top}/lathe-{spark.sparkContext.applicationId}"


#: Rows in an Arrow batch: texts may be long, and a batch is held several times over.
BATCH_ROWS = 1000


def lean(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small; a session with smaller ones keeps them."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def tidied(run):
    """A task function that hands freed memory back when it ends: Python workers outlive their tasks."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def gathered(df: DataFrame) -> DataFrame:
    """``df``, whose rows are narrow beside the texts they come from, in an eighth of the shuffle partitions.

    Else each partition would become a file of a few kilobytes.
    """
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def cut(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    df = gathered(df) if narrow else df
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null becomes empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES):
    """Slices of a batch that hold about ``size`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words (runs without ASCII white space) of all texts in a buffer.

    ``start`` and ``end`` are byte positions, ``doc`` the row of each word,
    ``count`` words by row, ``first`` index of each row's first word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        solid = ~_SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        if len(data):
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
            inner = offsets[1:-1]
            before[inner[inner < len(data)]] = True
            after[inner[inner > 0] - 1] = True
        self.solid = solid
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.rows).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def array(self) -> pa.LargeBinaryArray:
        """All words as one Arrow column."""
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.data[self.solid]))])

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Exact numbers of the words, and the words that they number."""
        found = self.array().dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def row_number_base() -> int:
    """First of the row numbers that the running task may give out."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder with a row number as its last column."""

    @tidied
    def run(batches):
        uid = row_number_base()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(uid, uid + batch.num_rows))], names=[*batch.schema.names, name])
            uid += batch.num_rows

    return cut(lean(df).mapInArrow(run, df.select("*", F.lit(0).cast("long").alias(name)).schema), "numbered")


def word_count(text) -> F.Column:
    """Number of words as a JVM expression; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
