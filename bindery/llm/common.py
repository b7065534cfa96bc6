"""What the corpus operators share: input columns, shared folder, written tables, word hashing.

Input rule of every operator: only the id and the text column are read, so further columns
may have any name, also one that an operator uses for its output.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of all corpus operators: space and U+0009 to U+000D.
#: bytes.split() without an argument cuts at exactly these.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary one; a cluster is refused, as its
    machines would not see each other's folders."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="bindery-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bindery-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._bindery_path = path
    return read


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._bindery_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, modulus: int):
    """crc32 of the decimal doc_id, modulo modulus; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | None]:
    """The texts one at a time, so that a batch of long ones isn't held twice."""
    for x in batch.column(batch.schema.get_field_index(name)):
        yield x.as_py()


def released() -> None:
    """Gives the memory that this process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Callable) -> Callable:
    """work on batches that leaves no freed memory with its Python worker, which lives on beside later tasks."""

    @wraps(work)
    def run(batches, *args, **kwargs):
        yield from work(batches, *args, **kwargs)
        released()

    return run


# --- word hashing ------------------------------------------------------------------------

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; base is odd."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            made = np.cumprod(full, dtype=np.uint64)
        if n > 1 << 22:
            return made
        have = _powers[base] = made
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([1], _SPACE[data].view(np.int8), [1])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums over blocks of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > block:  # in blocks that end where words end
        out, k = [], 0
        while k < len(starts):
            to = max(k + 1, int(np.searchsorted(ends, starts[k] + block, "right")))
            a = int(starts[k])
            out.append(word_hashes(data[a : int(ends[to - 1])], starts[k:to] - a, ends[k:to] - a, 1 << 62))
            k = to
        return np.concatenate(out)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * powers(BYTE_BASE, len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(inverse(BYTE_BASE), len(data))[starts])


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of every run of size words."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * powers(base, n), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * powers(inverse(base), n)[: n - size + 1])
