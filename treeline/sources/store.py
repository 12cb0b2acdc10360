"""Manifests as JSON, a chunk pool as Parquet, trees written from plans, and the log of heads.

Publishing is an exclusive create of the next number's file, which is atomic on a local or POSIX file system; an object
store needs one with conditional writes. Everything here works on plan-sized data on the driver, but for the pool."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from treeline.operators import predicates as P
from treeline.operators.diffing import ENTRY, violations

ENTRY_TYPE = "struct<size: bigint, mode: int, mtime_secs: bigint, mtime_nanos: bigint, chunks: array<string>>"
DOCUMENT = f"version int, workspace_id string, scanned_at_secs bigint, files map<string, {ENTRY_TYPE}>"
MANIFEST = "ws string, path string, size bigint, mode int, mtime_secs bigint, mtime_nanos bigint, chunks array<string>"


class HeadConflict(Exception):
    """Another writer published first."""


def write_atomic(path: str, data: bytes) -> None:
    """Whole or not at all: a temporary file, fsync, rename, fsync of the folder."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    temporary = os.path.join(folder, f".tmp-{uuid.uuid4().hex}")
    with open(temporary, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    fd = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def parse_documents(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Adds doc (the parsed document) and parseable: all required fields are there, in every entry too."""
    rows = rows.withColumn("doc", F.from_json(json_col, DOCUMENT))
    whole = F.forall(F.map_values("doc.files"), lambda e: e.isNotNull() & e["size"].isNotNull() & e["mode"].isNotNull() & e["mtime_secs"].isNotNull() & e["mtime_nanos"].isNotNull() & e["chunks"].isNotNull())
    ok = F.col("doc.files").isNotNull() & F.col("doc.version").isNotNull() & F.col("doc.workspace_id").isNotNull() & whole
    return rows.withColumn("parseable", F.coalesce(ok, F.lit(False)))


def explode_documents(parsed: DataFrame) -> DataFrame:
    """One row for each path of the parseable documents."""
    rows = parsed.where("parseable").select(F.col("doc.workspace_id").alias("ws"), F.explode("doc.files").alias("path", "entry"))
    return rows.select("ws", "path", *[F.col(f"entry.{c}").alias(c) for c in ENTRY])


def to_documents(manifest: DataFrame, scanned_at: int = 0) -> DataFrame:
    """ws, json: one document for each workspace, files in path order."""
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct(*ENTRY).alias("entry")))))
    rows = manifest.groupBy(F.col("ws").cast("string").alias("ws")).agg(entry.alias("files"))
    return rows.select("ws", F.to_json(F.struct(F.lit(1).alias("version"), F.col("ws").alias("workspace_id"), F.lit(scanned_at).cast("bigint").alias("scanned_at_secs"), "files")).alias("json"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """A validated manifest, or None where there is no file."""
    if not os.path.exists(path):
        return None
    parsed = parse_documents(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
    if not parsed.first().parseable:
        raise ValueError(f"{path} is not a manifest")
    rows = explode_documents(parsed)
    bad = violations(rows).orderBy("path").first()
    if bad:
        raise ValueError(f"{bad.path}: {bad.violation}")
    return rows


class Pool:
    """Chunks under their digest, as Parquet in folders by the first two digits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        """Whether anything was put, on whatever file system the path names."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        schema = "hash string, data binary, shard string"
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def put(self, chunks: DataFrame) -> int:
        """Appends what is not there; bytes that are not their name's are refused. Gives how many were written."""
        new = chunks.dropDuplicates(["hash"]).join(self.read().select("hash"), "hash", "left_anti")
        new = new.withColumn("shard", F.when(F.sha2("data", 256) == F.col("hash"), F.substring("hash", 1, 2)).otherwise(F.raise_error(F.lit("bytes are not their name's"))))
        written = Observation("put")
        new.select("hash", "data", "shard").observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("shard").parquet(self.path)
        return written.get["n"]


class HeadLog:
    """Heads of workspaces as numbered files; the one who creates a number has published it."""

    def __init__(self, root: str, keep: int = 50):
        self.root, self.keep = root, keep

    def _folder(self, ws: str) -> str:
        return os.path.join(self.root, "heads", ws)

    def head(self, ws: str) -> tuple[int, str, str] | None:
        """seq, hash and document of the newest head."""
        try:
            seq = max(int(n) for n in os.listdir(self._folder(ws)) if n.isdigit())
        except (FileNotFoundError, ValueError):
            return None
        with open(os.path.join(self._folder(ws), str(seq)), encoding="utf-8") as f:
            doc = f.read()
        return seq, hashlib.sha256(doc.encode()).hexdigest(), doc

    def put(self, ws: str, base: int, doc: str) -> tuple[int, str]:
        """Publishes base + 1, or HeadConflict if the head is not base. Old heads over `keep` go."""
        now = self.head(ws)
        if (now[0] if now else 0) != base:
            raise HeadConflict(f"the head is {now[0] if now else 0}, not {base}")
        os.makedirs(self._folder(ws), exist_ok=True)
        temporary = os.path.join(self._folder(ws), f".tmp-{uuid.uuid4().hex}")
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(doc)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, os.path.join(self._folder(ws), str(base + 1)))  # fails if it is there
        except FileExistsError as e:
            raise HeadConflict(f"{base + 1} was published meanwhile") from e
        finally:
            os.unlink(temporary)
        for n in os.listdir(self._folder(ws)):
            if n.isdigit() and int(n) <= base + 1 - self.keep:
                os.unlink(os.path.join(self._folder(ws), n))
        return base + 1, hashlib.sha256(doc.encode()).hexdigest()


def converge(log: HeadLog, ws: str, base: DataFrame, local: DataFrame, device: str, stamp: str, attempts: int = 32, before_publish: Callable[[int], None] = lambda _: None):
    """Merges local with the published head and publishes the result; on a lost race merges again with the head merged
    before as base. Gives seq, the merged manifest, conflicts and whether something was published. A workspace without a
    head publishes even an empty tree."""
    from treeline.operators import merging

    spark = local.sparkSession
    for attempt in range(attempts):
        head = log.head(ws)
        if head is None:
            remote = spark.createDataFrame([], MANIFEST)
        else:
            remote = explode_documents(parse_documents(spark.createDataFrame([(head[2],)], "json string")))
        decided = merging.decide(base, local, remote).cache()
        lost = merging.conflicts(decided, device, stamp)
        merged = merging.merged_rows(decided, lost).cache()
        doc = to_documents(merged).first()
        doc = doc.json if doc else json.dumps({"version": 1, "workspace_id": ws, "scanned_at_secs": 0, "files": {}})
        if head and not merging.diff(remote, merged).limit(1).count():
            return head[0], merged, lost, False
        before_publish(attempt)
        try:
            seq, _ = log.put(ws, head[0] if head else 0, doc)
            return seq, merged, lost, True
        except HeadConflict:
            base, local = remote, merged
    raise HeadConflict(f"lost {attempts} races")


def preserve(lost: DataFrame, root: str) -> int:
    """Copies what local losers (path, copy) hold to their conflict names, whole and on disk before anything is written over
    them; a copy that is there already is left, as a cycle that broke off may have made it."""
    n = 0
    for row in lost.where("loser = 'local'").select("path", "copy").orderBy("path").toLocalIterator():
        source, target = _inside(root, row.path), _inside(root, row["copy"])
        if os.path.exists(target):
            continue
        with open(source, "rb") as f:
            write_atomic(target, f.read())
        shutil.copystat(source, target)
        n += 1
    return n


def materialize(plan: DataFrame, lost: DataFrame, files: DataFrame, root: str) -> int:
    """Local losers first, then the plan; nothing is applied unless all copies are on disk."""
    preserve(lost, root)
    return apply(plan, files, root)


def apply(plan: DataFrame, files: DataFrame, root: str, after: DataFrame | None = None) -> int:
    """Carries out a plan (path, change, phase) on a tree: files has path, mode, mtime_secs, mtime_nanos, data. Deletes
    climb while the parent is empty. Rows stream to the driver in phase order, a file at a time. Paths that differ in case
    only could be one file: where the plan writes such, or after (path: the tree as it will be) has such, nothing is applied."""
    paths = plan.where("change <> 'deleted'").select("path")
    paths = paths if after is None else paths.unionByName(after.select("path"))
    clash = paths.groupBy(F.lower("path").alias("folded")).agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").orderBy("a").first()
    if clash:
        raise ValueError(f"{clash.a} and {clash.b} differ in case only")
    for row in plan.where("phase in (1, 3)").orderBy("phase", "path").toLocalIterator():
        _inside(root, row.path)
    n = 0
    for phase in (1, 2, 3, 4):
        rows = plan.where(F.col("phase") == phase).orderBy("path")
        if phase in (2, 4):
            rows = rows.join(files, "path").orderBy("path")
        for row in rows.toLocalIterator():
            target = _inside(root, row.path)
            if phase in (1, 3):
                _delete(root, target)
            else:
                write_atomic(target, bytes(row.data))
                os.chmod(target, row.mode & 0o777)
                os.utime(target, ns=(row.mtime_secs * 10**9 + row.mtime_nanos,) * 2)
            n += 1
    return n


def _inside(root: str, path: str) -> str:
    """The place of a path, no folder of which may be a link."""
    at = root
    for part in path.split("/")[:-1]:
        if part in ("", ".", ".."):
            raise ValueError(f"{path} leaves the tree")
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise ValueError(f"{path} goes through a link")
    return os.path.join(root, path)


def _delete(root: str, target: str) -> None:
    try:
        os.unlink(target)
    except FileNotFoundError:
        return
    folder = os.path.dirname(target)
    while os.path.realpath(folder) != os.path.realpath(root):
        try:
            os.rmdir(folder)
        except OSError:
            return
        folder = os.path.dirname(folder)


def apart(source: str, target: str) -> bool:
    """Neither tree holds the other."""
    a, b = os.path.realpath(source), os.path.realpath(target)
    return a != b and not a.startswith(b + os.sep) and not b.startswith(a + os.sep)


def workspace(root: str, wanted: str | None = None) -> str:
    """The identity of a tree, made once; another one asked for explicitly is an error."""
    path = os.path.join(root, P.STATE_DIR, "workspace.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            own = json.load(f)["id"]
        if wanted and wanted != own:
            raise ValueError(f"this is workspace {own}")
        return own
    own = wanted or uuid.uuid4().hex
    write_atomic(path, json.dumps({"id": own, "version": 1}).encode())
    return own
