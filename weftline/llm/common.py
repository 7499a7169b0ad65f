"""What the operators of this folder share: the shared folder, Arrow buffers, tokens and hashes."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters to lower case, all other bytes as they are.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes outside [0-9a-z\x80-\xff] become spaces, after lower-casing.
ALNUM = bytes(LOWER[b] if 48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))
_LOWER_NP = np.frombuffer(LOWER, np.uint8)
_SPACE_NP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words longer than this are hashed one by one.
LONG_WORD = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and Spark runs in one process (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: With this on, an execution's shuffle files go from the executors' disks when it ends, not when the driver's collector finds the plan.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files; what they made must be stored."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a table in the shared folder, which outlives any executor. Computes df once."""
    path = new_folder(df.sparkSession, "table")
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftline_table = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that checkpoint() made and that no result reads any more."""
    for t in tables:
        remove_folder(t.sparkSession, t._weftline_table)


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def raw(text: str = "text") -> Column:
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))


def map_texts(df: DataFrame, fn: Callable[[list[bytes]], dict], schema: str, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """keys, then the columns that fn makes of a list of texts; schema is theirs. Works batch by batch, without a shuffle."""
    names = list(keys)
    given = df.select(*[c.alias(n) for n, c in keys.items()], raw(text).alias("__text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = fn(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(v if isinstance(v, pa.Array) else pa.array(v) for v in got.values())], [*names, *got])
            give_back()

    return given.mapInArrow(run, out)


def filter_texts(df: DataFrame, keep: Callable[[list[bytes]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of df whose texts keep marks, with all columns. Null is an empty text. Works batch by batch, without a shuffle."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=at):
                yield part.filter(pa.array(keep([(x or "").encode() for x in part.column(at).to_pylist()]), pa.bool_()))
            give_back()

    return df.mapInArrow(run, df.schema)


def give_back() -> None:
    """Returns freed memory to the system, so that several workers of one executor don't each keep their largest need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def slices(batch: pa.RecordBatch, most: int = 2 << 20, column: str | int = "__text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about most bytes of text each, a row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array, without a copy; the offsets count from the bytes given."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    n, kind = len(arr), np.int64 if wide else np.int32
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, kind, n + 1, arr.offset * np.dtype(kind).itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(inside: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that no text boundary, and no change of kind, cuts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.ones(len(inside) + 1, bool)
    cut[1:-1] = inside[1:] != inside[:-1] if kind is None else kind[1:] != kind[:-1]
    cut[offsets[offsets < len(inside)]] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    keep = inside[starts]
    return starts[keep], ends[keep]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data, the same wherever the span stands."""
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    short = size <= LONG_WORD
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    sizes = size[order]
    lo = int(np.searchsorted(-sizes, -LONG_WORD, side="left"))
    counts = np.searchsorted(-sizes, -np.arange(1, LONG_WORD + 1), side="right")
    g, s = h[order], starts[order]
    for j in range(LONG_WORD):
        hi = int(counts[j])
        if hi <= lo:
            break
        x = g[lo:hi]
        x ^= data[s[lo:hi] + j]
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    h[order] = g
    h = mix(h)
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return h


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased word hashes of texts, words being [^\\x20\\x09-\\x0D]+, and how many each text has."""
    data = _LOWER_NP[data]
    starts, ends = runs(~_SPACE_NP[data], offsets)
    n = np.diff(np.searchsorted(starts, offsets))
    return hash_spans(data, starts, ends), n


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
