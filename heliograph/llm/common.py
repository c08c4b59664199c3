"""What the operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the shingle and language-model contracts are split at these bytes (fixed values).
SPACES = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n: the folds of the held-out rows (null key: null)."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % n


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names.

    The folder comes from spark.checkpoint.dir; only where that is unset (tests, notebooks) a folder under
    the session's warehouse is used, which is shared wherever tables are.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        conf = df.sparkSession.conf
        folder = conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def modest(spark: SparkSession, rows: int = 2000) -> None:
    """Let the session hand workers batches of at most `rows` rows, so that batches of texts stay small on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def lean(part):
    """part, giving back the memory it no longer needs when it ends, as workers stay for other tasks."""

    def run(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from part(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return run


def release(spark: SparkSession) -> None:
    """Let the driver find out which shuffles nothing needs any more, so that their files go."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slots(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session: the unit in which packed rows are dealt."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1) of an Arrow string or binary array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def cut_words(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Texts cut at SPACES: which distinct word each word of all texts is, the distinct words, and how many words each text has.

    offsets: where in raw each text begins, and where the last one ends.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    table = np.ones(256, bool)
    table[list(SPACES)] = False
    data = np.frombuffer(raw, np.uint8)
    inside = table[data]
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False  # no word crosses texts
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    stops = np.r_[0, np.cumsum(last - first + 1)].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(stops), pa.py_buffer(data[inside])]).dictionary_encode()
    distinct = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
    each = pc.binary_join(distinct, pa.scalar(b" ", pa.large_binary()))[0].as_py().split(b" ") if len(words.dictionary) else []
    return words.indices.to_numpy(), each, np.diff(np.searchsorted(first, offsets))


def runs(offsets: np.ndarray, most: int):
    """Slices (from, to) of rows with about `most` bytes each; one row may be longer."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def sha256_hex(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()
