"""Shared pieces of the training-data operators: tables, shared storage, Arrow passes.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``, which is what
``bytes.split()`` cuts at, and only A-Z are lower-cased, which is what
``bytes.lower()`` does; so texts travel to Python as UTF-8 bytes.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Stands for a null doc_id wherever ids are compared: it comes after all others. A doc_id of this value counts as null there.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where the session names none, a temporary one if it runs on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        given = tempfile.mkdtemp(prefix="driftlens-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it back.

    Unlike a checkpoint this forgets the partitioning, so a later join shuffles
    both sides by itself and adaptive execution can split its hot keys.
    """
    path = f"{shared_dir(df.sparkSession)}/driftlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads again; what was made of them must be written by now."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(col: str = "doc_id"):
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def utf8(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def release() -> None:
    """Gives freed memory back to the system; at the end of a task, as workers stay and wait."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(df: DataFrame, most: int = 1024) -> DataFrame:
    """df; batches of rows that its session sends to Python hold at most this many from now on, as texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(df.sparkSession.conf.get(name))
    if given <= 0 or given > most:
        df.sparkSession.conf.set(name, str(most))
    return df


def arrow_pass(df: DataFrame, rows: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, batch: int = 4096) -> DataFrame:
    """df through rows(), which turns an iterator of tuples into one of tuples of schema.

    Batches of either side stay small, so memory doesn't follow the partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        try:
            for row in rows(tuples()):
                held.append(row)
                if len(held) >= batch:
                    yield pack(held)
                    held = []
            if held:
                yield pack(held)
        finally:
            release()

    def pack(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return small_batches(df).mapInArrow(run, schema)


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _Q
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes], memo: dict[bytes, int], limit: int = 400_000) -> np.ndarray:
    """XXH64 of each word; memo saves most calls, holds no long words and is emptied at limit words."""
    from xxhash import xxh64_intdigest

    if len(memo) > limit:
        memo.clear()
    get = memo.get
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = xxh64_intdigest(w, 42)
            if len(w) <= 64:
                memo[w] = h
        out[i] = h
    return out


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, order included, from the words' hashes."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out * _P) + mix(h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return mix(out)


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name: run sees and gives them by place."""
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])
    return small_batches(df).toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, plain).toDF(*schema.names)


def arrow_filter(df: DataFrame, keeper: Callable[[], Callable[[list[bytes]], list[bool]]], col: str = "text") -> DataFrame:
    """The rows of df, whole and with all columns, that keep() says yes to by their texts; keeper() makes one keep() a task."""
    at = df.columns.index(col)
    assert isinstance(df.schema[at].dataType, StringType), f"{col} isn't a string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keeper()
        try:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                    yield part.filter(pa.array(keep(texts), pa.bool_()))
        finally:
            del keep  # what it remembers goes first
            release()

    return mapped(df, run, df.schema)
