"""Helpers shared by the training-data operators: shared folders, written tables, word splitting and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: Words are runs of anything but space, tab, LF, VT, FF and CR: exactly what bytes.split() yields.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary one; any other is refused, as its executors would each write to a disk of their own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Arrow batches of whole texts are held on both sides of the pipe to Python: inside, they are small."""
    want = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder as Parquet and reads it again. Survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that all that follows has been written without."""
    for df in tables:
        _delete(df)


def lookup(rows: DataFrame, per_key: DataFrame, keys: list[str], times: str, most: int = 2000) -> DataFrame:
    """rows joined with per_key, a written table with a row for each key that says how many of rows have it (times).

    Keys of more than a share of 1 / most of these rows are fewer than most, so they are broadcast and their rows stay where
    they are; only the others are dealt by key. So no task gets a hot key's rows."""
    total, top = per_key.agg(F.sum(times), F.max(times)).first()
    limit = max((total or 0) // most, 4096)
    if not top or top <= limit:
        return rows.join(per_key, keys)
    hot, rest = per_key.where(F.col(times) > limit), per_key.where(F.col(times) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def _delete(df: DataFrame) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the JVM drop what is no longer referenced, so that the cleaner removes the shuffle files of finished jobs."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def _ordered(kind: DataType) -> bool:
    """Whether values of a type have an order, as those of maps have not."""
    if isinstance(kind, ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind)
    return not isinstance(kind, (MapType, VariantType))


def smallest(df: DataFrame, name: str) -> Column:
    """The smallest of structs of all of df's columns, called name; columns whose values have no order don't count."""
    own = [f.name for f in df.schema if _ordered(f.dataType)]
    if len(own) == len(df.columns):
        return F.min(name)
    return F.min_by(name, F.struct(*[F.col(name).getField(c) for c in own]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(values) -> list[bytes]:
    """An Arrow string column as bytes, null as empty."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def strings(values) -> list[str]:
    """An Arrow string column as strings, null as empty."""
    return [v or "" for v in values.to_pylist()]


def stretches(values, limit: int = 1 << 22, read: Callable = utf8) -> Iterator[tuple[int, list]]:
    """(first index, texts as `read` gives them) of an Arrow string column in stretches of about `limit` bytes, null as empty;
    a longer text is a stretch of its own. Only one stretch at a time is Python objects."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    lo, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield lo, read(values.slice(lo, k - lo))
            lo, size = k, 0
        size += n
    if len(values):
        yield lo, read(values.slice(lo))


@functools.cache
def one_thread() -> None:
    """Matrix products on one thread: a task has a core, and OpenBLAS's threads would wait for each other busily."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line and ".so" in line}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
            if hasattr(library, name):
                getattr(library, name)(1)


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Without the search for cycles, which large dictionaries make dear, around code that makes none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def give_back() -> None:
    """Gives memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """What make gives, kept by this Python worker for later tasks of the same operator."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def trimmed(run: Callable, keep: tuple | None = None) -> Callable:
    """For mapInArrow: workers are used again, so what other operators hold is dropped (but `keep`), and what a finished task
    has freed is given back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in [k for k in _HELD if k != keep]:
            del _HELD[key]
        yield from run(batches)
        give_back()

    return whole


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_GAP = re.compile(rb"[\x20\x09-\x0D]")
_DIGEST = xxhash.xxh3_128_digest


def _hashes(text: bytes) -> np.ndarray:
    """Two rows of hashes of a text's words, the halves of 128 bits of XXH3. Long texts are split in pieces of about a
    megabyte."""
    out, lo = [], 0
    while lo < len(text):
        end = _GAP.search(text, lo + (1 << 20)) if len(text) - lo > 1 << 20 else None
        hi = end.start() if end else len(text)
        out.append(np.frombuffer(b"".join(map(_DIGEST, text[lo:hi].split())), np.uint64).reshape(-1, 2).T)
        lo = hi
    return out[0] if len(out) == 1 else np.concatenate([np.zeros((2, 0), np.uint64), *out], 1)


def word_hashes(texts: list[bytes], both: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, one after the other, and len(texts) + 1 offsets into them; both: two rows,
    so 128 bits for each word."""
    parts = [_hashes(t) for t in texts]
    at = np.concatenate([[0], np.cumsum([p.shape[1] for p in parts], dtype=np.int64)]).astype(np.int64)
    whole = np.concatenate([np.zeros((2, 0), np.uint64), *parts], 1)
    return (whole if both else whole[0]), at


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, (seed * 0x9E3779B97F4A7C15 + int(n)) & (2**64 - 1), np.uint64)
    for j in range(n):
        out = (out ^ h[j : len(h) - n + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD + 2 * seed)
        out ^= out >> np.uint64(32)
    return mix(out)
