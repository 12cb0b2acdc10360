"""Files put together from chunks by ranges: no file is ever one value.

Where each chunk of a file begins is a prefix sum of lengths. Chunks then go to tasks by ranges of (file, place), and each task
writes its stretch into the file's temporary at that place; so a large file is written by many tasks, and a task holds a batch
of chunks. A file is renamed to its name when all its bytes are there. A folder `.tmp-...` below root keeps three
tables, from which the result is read, one of them with a row for each chunk; `pool.stale_temporaries` names such. Needs a
POSIX file system that all executors share."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.operators.pool import packed
from treeline.sources.store import _inside


@contextlib.contextmanager
def _small_batches(spark: SparkSession, size: str = "16m") -> Iterator[None]:
    """Arrow batches of chunks are held whole on both sides of the pipe to Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def assemble_files(files: DataFrame, pool: DataFrame, root: str, batch: str = "16m") -> DataFrame:
    """files: path (below root), pos, hash, a row for each chunk. pool: hash, data. Writes the files all of whose chunks are
    there and are what they are called; gives path, complete, size, parts and sha256 (null where not complete). Chunks of one
    file are in order of pos. Writing again replaces a file as a whole."""
    spark, root = files.sparkSession, root.removeprefix("file://")
    work = os.path.join(root, f".tmp-{uuid.uuid4().hex}")
    own = files.select("path", "pos", packed(F.col("hash")).alias("hash"))
    good = pool.select("hash", "data").where(F.sha2("data", 256) == F.col("hash")).withColumn("hash", packed(F.col("hash")))
    lengths = good.select("hash", F.octet_length("data").cast("bigint").alias("length")).distinct()  # of equal digests, one
    sound = good.dropDuplicates(["hash"])
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    # of lengths only: a row of some 60 bytes for each chunk of a file
    rows = own.join(lengths, "hash", "left")
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("complete", F.count_if(F.col("length").isNull()).over(whole) == 0)
    rows = rows.withColumn("size", F.sum("length").over(whole)).withColumn("parts", F.count(F.lit(1)).over(whole))
    # three jobs ask where chunks lie: it is written down, with the names of those only that are fetched
    at = f"file://{os.path.join(work, 'placed')}"
    rows.withColumn("hash", F.when(F.col("complete") & (F.col("length") > 0), F.col("hash"))).drop("length").write.parquet(at)
    placed = spark.read.schema(rows.drop("length").schema).parquet(at)

    def name(path: str) -> str:
        digest = hashlib.sha256(path.encode()).hexdigest()
        return os.path.join(work, digest[:2], digest)  # tasks wait for each other where they all make files in one folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in range(256):
            os.makedirs(os.path.join(work, f"{k:02x}"), exist_ok=True)
        at, f = None, None
        try:
            for rows in batches:
                done: dict[str, int] = {}
                for path, offset, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                    if path != at:
                        if f is not None:
                            os.close(f)
                        at, f = path, os.open(name(path), os.O_WRONLY | os.O_CREAT, 0o644)
                    view, lo = memoryview(data.as_buffer()), 0
                    while lo < len(view):
                        lo += os.pwrite(f, view[lo:], offset + lo)
                    done[path] = done.get(path, 0) + len(view)
                yield pa.RecordBatch.from_arrays([pa.array(done.keys(), pa.string()), pa.array(done.values(), pa.int64())], names=["path", "written"])
        finally:
            if f is not None:
                os.close(f)
        os.sync()  # once for all files of the task, none of which has its name before all tasks have ended

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=4096)
        def made(folder: str) -> None:
            """A checked folder, once for the files in it that follow."""
            os.makedirs(os.path.dirname(_inside(root, folder + "_")), exist_ok=True)

        for rows in batches:
            digests = []
            for path, size, written in zip(*(rows.column(k).to_pylist() for k in (0, 2, 4)), strict=True):
                source, target = name(path), os.path.join(root, path)
                if written != size:
                    raise OSError(f"{path}: {written} of {size} bytes")
                made("".join(path.rpartition("/")[:2]))
                with contextlib.suppress(FileNotFoundError):  # an attempt of this task before has renamed it
                    os.replace(source, target)
                with open(target, "rb") as f:
                    digests.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(digests, pa.string())], names=["path", "complete", "size", "parts", "sha256"])

    ready = placed.where("hash is not null").join(sound, "hash").select("path", "pos", "offset", "data")
    # files take the time, not bytes: tasks of a number that is not made smaller for few bytes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = ready.repartitionByRange(tasks, "path", "pos").sortWithinPartitions("path", "pos").select("path", "offset", "data")
    summary = os.path.join(work, "summary")
    with _small_batches(spark, batch):
        ready.mapInArrow(write, "path string, written bigint").write.parquet(f"file://{summary}")
    sums = spark.read.schema("path string, written bigint").parquet(f"file://{summary}").groupBy("path").agg(F.sum("written").alias("written"))
    one = placed.groupBy("path").agg(F.first("complete").alias("complete"), F.first("size").alias("size"), F.first("parts").alias("parts"))
    ready = one.where("complete and size > 0").join(sums, "path").select("path", "complete", "size", "parts", "written")
    out = os.path.join(work, "out")
    ready.repartitionByRange(tasks, "path").sortWithinPartitions("path").mapInArrow(publish, "path string, complete boolean, size bigint, parts bigint, sha256 string").write.parquet(f"file://{out}")
    for k in range(256):
        with contextlib.suppress(OSError):  # what a failed attempt left in one stays
            os.rmdir(os.path.join(work, f"{k:02x}"))
    rest = one.where("not (complete and size > 0)").select("path", "complete", F.when(F.col("complete"), F.col("size")).alias("size"), "parts", F.lit(None).cast("string").alias("sha256"))
    return spark.read.schema("path string, complete boolean, size bigint, parts bigint, sha256 string").parquet(f"file://{out}").unionByName(rest)
