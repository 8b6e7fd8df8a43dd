"""What the operators of this package share: the shared folder, vectorised words, connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at a time (longer texts come alone).
SLICE_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# --- shared storage -------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where it is unset (local mode, tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="vectrill-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems, wherever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session is gone at exit
        return


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_path(df: DataFrame) -> str:
    """The folder of a materialized DataFrame."""
    return df.inputFiles()[0].rpartition("/")[0]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs that are run inside send Arrow batches of so many rows at most; for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete a materialized DataFrame that nothing will read again."""
    if df.inputFiles():
        delete_path(df.sparkSession, source_path(df))


def fold(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: 0 marks the held-out fold."""
    return F.crc32(id_column.cast("string")) % modulus


def release() -> None:
    """Give memory that is free back to the system: Python workers live on after their tasks, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# --- words of whole Arrow batches -----------------------------------------------------------


def byte_table(is_member) -> np.ndarray:
    return np.array([bool(is_member(b)) for b in range(256)])


#: Words `[^\x20\x09-\x0D]+`: what ASCII white space separates.
SPACED = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a to z and all that is not ASCII.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A to Z become a to z, all other bytes stay.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _Powers:
    """Powers of the hash base and of its inverse, as long as asked for."""

    up = down = np.ones(1, _U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                factors = np.full(size, _BASE & (2**64 - 1), _U64)
                factors[0] = 1
                cls.up = np.cumprod(factors, dtype=_U64)
                factors[1:] = _INVERSE
                cls.down = np.cumprod(factors, dtype=_U64)
        return cls.up, cls.down


class Words:
    """The words of some texts: start and end bytes, and the first word of each text.

    data: the texts' bytes, lower-cased (A-Z) if asked; offsets: where each text starts in them;
    bounds: for text i, words bounds[i] to bounds[i+1] are its own.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, lower: bool) -> None:
        raw, offsets = text_bytes(texts)
        self.data = LOWER[raw] if lower else raw
        self.offsets, n = offsets, len(raw)
        inside = table[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and where each starts (as a word's index); no run leaves its text."""
        where = np.flatnonzero(np.arange(len(hashes)) + n <= np.repeat(self.bounds[1:], self.counts))
        with np.errstate(over="ignore"):
            out = np.full(len(where), _U64(n), _U64)
            for j in range(n):
                out = mix(out * _U64(0xD6E8FEB86659FD93) + hashes[where + j])
        return out, where


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    with np.errstate(over="ignore"):
        return run_hashes(data.astype(_U64) + _U64(1), start, end)


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of 64-bit values, from prefix sums of a polynomial modulo 2**64."""
    if not len(start):
        return np.zeros(0, _U64)
    up, down = _Powers.get(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, _U64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U64))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each run of count, one run after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps, and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `most` bytes of text; a longer text comes alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


# --- connected components -------------------------------------------------------------------


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of an undirected graph of edges (a, b): root is the component's smallest node.

    Alternates large-star and small-star steps. Each is a pre-aggregated minimum and a join to these minima, which are
    written first: so a hub's edges meet in a plain join that adaptive execution can split. The edges shrink to stars in
    logarithmically many rounds. Loops and repeated edges are allowed; nodes without an edge to another do not appear.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    seen = None
    while True:
        old = now
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        now = materialize(small, tag)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(old)
        discard(low)
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
