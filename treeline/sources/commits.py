"""One commit for several tables: heads, their retention and the references they bring become visible together or not at all.

A version is one small file that names the files of every table. Tasks write Parquet into a folder of the transaction that
nothing reads; when all have ended the driver's half makes the next version's file by an exclusive create, which is the
commit. Whoever finds it there has lost the race: the write fails, and what its tasks wrote is removed. Data are on disk
(fsync of files, then of folders) before the version that names them. A killed task or driver leaves files that no version
names; `vacuum` removes them. Exclusive creates need a POSIX file system that all executors share."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from treeline.operators import cycles, retention
from treeline.sources.store import HeadConflict

#: Marks a lost race in the error that Spark reports for a failed write.
_LOST = "another writer made version"
_TABLE = "_table"


def _sync(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (table, file) pairs."""

    files: list[tuple[str, str]]


class CommitWriter(DataSourceArrowWriter):
    """Options: path; base, the version that the plan was made from; transaction, the name of its folder; tables, JSON of
    name -> [columns, whether rows are added to what the table has]."""

    def __init__(self, options: dict[str, str]):
        self.root, self.base, self.transaction = options["path"], int(options["base"]), options["transaction"]
        self.tables = json.loads(options["tables"])

    @property
    def folder(self) -> str:
        return os.path.join(self.root, "data", self.transaction)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        writers: dict[str, tuple[str, pq.ParquetWriter]] = {}
        os.makedirs(self.folder, exist_ok=True)
        try:
            for batch in iterator:
                rows = pa.Table.from_batches([batch])
                for name, (columns, _) in self.tables.items():
                    own = rows.filter(pc.equal(rows[_TABLE], name)).select(columns)
                    if not own.num_rows:
                        continue
                    if name not in writers:  # each attempt of a task has files of its own
                        path = os.path.join(self.folder, f"{name}-{uuid.uuid4().hex}.parquet")
                        writers[name] = (path, pq.ParquetWriter(path, own.schema))
                    writers[name][1].write_table(own)
        finally:
            for _, writer in writers.values():
                writer.close()
        for path, _ in writers.values():
            _sync(path)
        return Written([(name, os.path.relpath(path, self.root)) for name, (path, _) in writers.items()])

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        log = CommitLog(self.root)
        version = log.version(self.base)
        for name, (_, added) in self.tables.items():
            version[name] = (version.get(name, []) if added else []) + [path for table, path in files if table == name]
        if files:
            _sync(self.folder)
        log.publish(self.base, version)
        kept = {os.path.basename(path) for _, path in files}
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if name not in kept:  # of attempts that did not count
                os.unlink(os.path.join(self.folder, name))

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class CommitSource(DataSource):
    """The sink of CommitLog.commit."""

    @classmethod
    def name(cls) -> str:
        return "treeline_commit"

    def writer(self, schema: StructType, overwrite: bool) -> CommitWriter:
        return CommitWriter(dict(self.options))


class CommitLog:
    """Tables under one sequence of versions. Version 0 is empty."""

    def __init__(self, root: str):
        self.root = root.removeprefix("file://")

    def _versions(self) -> str:
        return os.path.join(self.root, "versions")

    def newest(self) -> int:
        try:
            return max((int(n) for n in os.listdir(self._versions()) if n.isdigit()), default=0)
        except FileNotFoundError:
            return 0

    def version(self, number: int) -> dict[str, list[str]]:
        """The files of each table."""
        if not number:
            return {}
        with open(os.path.join(self._versions(), str(number)), encoding="utf-8") as f:
            return json.load(f)

    def publish(self, base: int, version: dict[str, list[str]]) -> None:
        """Makes version base + 1, or fails if it is there."""
        os.makedirs(self._versions(), exist_ok=True)
        temporary = os.path.join(self._versions(), f".tmp-{uuid.uuid4().hex}")
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(version, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, os.path.join(self._versions(), str(base + 1)))
        except FileExistsError as e:
            raise HeadConflict(f"{_LOST} {base + 1}") from e
        finally:
            os.unlink(temporary)
        _sync(self._versions())

    def commit(self, base: int, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None) -> int:
        """One write of all tables: `replaced` become these rows, `added` get them too; others stay as in version base. Gives
        the new version, or HeadConflict if another writer made it."""
        tables = {n: (df, False) for n, df in (replaced or {}).items()} | {n: (df, True) for n, df in (added or {}).items()}
        rows = None
        for name, (df, _) in tables.items():
            own = df.withColumn(_TABLE, F.lit(name))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        spark, transaction = rows.sparkSession, uuid.uuid4().hex
        spark.dataSource.register(CommitSource)
        options = {"path": self.root, "base": str(base), "transaction": transaction, "tables": json.dumps({n: [df.columns, more] for n, (df, more) in tables.items()})}
        try:
            rows.write.format(CommitSource.name()).options(**options).mode("append").save()
        except Exception as e:
            if _LOST in str(e):
                raise HeadConflict(f"{_LOST} {base + 1}") from e
            raise
        return base + 1

    def read(self, spark: SparkSession, table: str, schema: str, number: int | None = None) -> DataFrame:
        """A table as of a version (the newest), by Spark's own reader of Parquet."""
        files = self.version(self.newest() if number is None else number).get(table, [])
        if not files:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"file://{os.path.abspath(os.path.join(self.root, f))}" for f in files))

    def vacuum(self, keep: int = 2, older: float = 3600.0) -> int:
        """Removes versions but the newest `keep`, and files older than so many seconds that none of these names."""
        newest = self.newest()
        named = {f for n in range(max(1, newest - keep + 1), newest + 1) for f in sum(self.version(n).values(), [])}
        for n in os.listdir(self._versions()) if newest else []:
            if n.isdigit() and int(n) <= newest - keep:
                os.unlink(os.path.join(self._versions(), n))
        gone = 0
        for folder, _, names in os.walk(os.path.join(self.root, "data")):
            for name in names:
                path = os.path.join(folder, name)
                if os.path.relpath(path, self.root) not in named and os.path.getmtime(path) < time.time() - older:
                    os.unlink(path)
                    gone += 1
        return gone


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where it is unset, a local session gets a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", "file://" + path)
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise RuntimeError("commits need a POSIX file system")
    return os.path.join(path, f"{name}-{uuid.uuid4().hex}")


HEADS, REFS = "ws bigint, seq bigint, id bigint", "ws bigint, hash string"


def put_heads(log: CommitLog, requests: DataFrame, roles: DataFrame, workspaces: DataFrame, manifests: DataFrame, closed: DataFrame, store: DataFrame, keep: int = retention.HEAD_KEEP, attempts: int = 32, before_commit: Callable[[int], None] = lambda _: None) -> int:
    """The boundary at which heads are written, as one commit: the requests' verdicts on the present heads, the accepted heads
    with retention, and their references. A lost race is judged anew on the heads that won. Gives the version that holds the
    tables heads, refs and verdicts. See cycles.commits."""
    spark = requests.sparkSession
    for attempt in range(attempts):
        base = log.newest()
        heads, refs = log.read(spark, "heads", HEADS, base), log.read(spark, "refs", REFS, base)
        verdicts = cycles.commits(requests, roles, workspaces, manifests, closed, store, heads.groupBy("ws").agg(F.max("seq").alias("seq")))
        after, referred = cycles.writes(verdicts, manifests, heads, refs, keep)
        cast = lambda df, schema: df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))
        new = cast(referred, REFS).join(refs, ["ws", "hash"], "left_anti").select("ws", "hash")
        before_commit(attempt)
        try:
            return log.commit(base, {"heads": cast(after, HEADS), "verdicts": verdicts}, {"refs": new})
        except HeadConflict:
            continue
    raise HeadConflict(f"lost {attempts} races")


def announced(log: CommitLog, spark: SparkSession, number: int) -> DataFrame:
    """The hints (ws, seq) of a version: heads that the one before does not have. To be sent after the commit."""
    now, before = (log.read(spark, "heads", HEADS, n) for n in (number, number - 1))
    return now.join(before, ["ws", "seq"], "left_anti").groupBy("ws").agg(F.max("seq").alias("seq"))
