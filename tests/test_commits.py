"""Several tables under one commit: races, tasks that die, and what is visible when."""

import os

import pytest
from pyspark.sql import functions as F

from treeline.sources import commits
from treeline.sources.commits import HEADS, REFS, CommitLog
from treeline.sources.store import HeadConflict


def heads(spark, *rows):
    return spark.createDataFrame(rows, HEADS)


def refs(spark, *rows):
    return spark.createDataFrame(rows, REFS)


def files(log):
    return {os.path.relpath(os.path.join(d, n), log.root) for d, _, names in os.walk(os.path.join(log.root, "data")) for n in names if n.endswith(".parquet")}


def test_tables_together(spark, tmp_path):
    log = CommitLog(str(tmp_path / "log"))
    assert log.newest() == 0 and log.read(spark, "heads", HEADS).count() == 0
    assert log.commit(0, {"heads": heads(spark, (1, 1, 10))}, {"refs": refs(spark, (1, "a"), (1, "b"))}) == 1
    assert log.commit(1, {"heads": heads(spark, (1, 2, 11))}, {"refs": refs(spark, (1, "c"))}) == 2
    assert [tuple(r) for r in log.read(spark, "heads", HEADS).collect()] == [(1, 2, 11)]
    assert sorted(r.hash for r in log.read(spark, "refs", REFS).collect()) == ["a", "b", "c"]
    assert [tuple(r) for r in log.read(spark, "heads", HEADS, 1).collect()] == [(1, 1, 10)]  # versions stay as they were
    assert [tuple(r) for r in commits.announced(log, spark, 2).collect()] == [(1, 2)]
    log.commit(2, {"heads": heads(spark)})
    assert log.read(spark, "heads", HEADS).count() == 0 and log.read(spark, "refs", REFS).count() == 3
    assert log.vacuum(keep=1, older=-1) == 2 and log.read(spark, "refs", REFS).count() == 3  # two files of heads


def test_one_of_two_writers_wins(spark, tmp_path):
    log = CommitLog(str(tmp_path / "log"))
    log.commit(0, {"heads": heads(spark, (1, 1, 10))}, {"refs": refs(spark, (1, "a"))})
    log.commit(1, {"heads": heads(spark, (1, 2, 20))}, {"refs": refs(spark, (1, "b"))})
    with pytest.raises(HeadConflict):
        log.commit(1, {"heads": heads(spark, (1, 2, 30))}, {"refs": refs(spark, (1, "x"))})
    assert [tuple(r) for r in log.read(spark, "heads", HEADS).collect()] == [(1, 2, 20)]
    assert sorted(r.hash for r in log.read(spark, "refs", REFS).collect()) == ["a", "b"]
    assert files(log) == set(sum(log.version(2).values(), [])) | set(sum(log.version(1).values(), []))  # the loser's are gone


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    log = CommitLog(str(tmp_path / "log"))
    log.commit(0, {"heads": heads(spark, (1, 1, 10))})
    before = files(log)
    broken = spark.range(8, numPartitions=4).select("id", F.lit(2).cast("bigint").alias("seq"), F.when(F.col("id") == 7, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).cast("bigint").alias("ws"))
    with pytest.raises(Exception, match="dies"):
        log.commit(1, {"heads": broken.select("ws", "seq", "id")}, {"refs": refs(spark, (1, "x"))})
    assert log.newest() == 1 and files(log) == before and log.read(spark, "refs", REFS).count() == 0


def test_put_heads(spark, tmp_path):
    log = CommitLog(str(tmp_path / "log"))
    entry = "id bigint, ws bigint, path string, size bigint, mode int, mtime_secs bigint, mtime_nanos bigint, chunks array<string>"
    request = "id bigint, ws bigint, user_name string, device string, sealed boolean, base bigint"
    roles = spark.createDataFrame([(1, "u", 2), (2, "u", 2)], "ws bigint, user_name string, role int")
    flavours, closed = spark.createDataFrame([(1, False), (2, False)], "ws bigint, e2e boolean"), spark.createDataFrame([], "ws bigint")
    store = spark.createDataFrame([(w, c * 64) for w in (1, 2) for c in "abc"], REFS)

    def put(rows, chunks, **more):
        manifests = spark.createDataFrame([(r[0], r[1], "f", 1, 420, 1, 0, [chunks[r[0]] * 64]) for r in rows], entry)
        return commits.put_heads(log, spark.createDataFrame(rows, request), roles, flavours, manifests, closed, store, keep=2, **more)

    n = put([(1, 1, "u", "d", False, 0), (2, 1, "u", "d", False, 0), (3, 2, "x", "d", False, 0)], {1: "a", 2: "b", 3: "c"})
    verdicts = log.read(spark, "verdicts", request + ", verdict string, seq bigint", n)
    assert {r.id: (r.verdict, r.seq) for r in verdicts.collect()} == {1: ("ok", 1), 2: ("conflict", None), 3: ("not_found", None)}
    assert [tuple(r) for r in log.read(spark, "refs", REFS).collect()] == [(1, "a" * 64)]

    def other(attempt):  # another writer is first
        if attempt == 0:
            put([(9, 1, "u", "d", False, 1)], {9: "b"})

    n = put([(4, 1, "u", "d", False, 1), (5, 2, "u", "d", False, 0)], {4: "c", 5: "c"}, before_commit=other)
    verdicts = log.read(spark, "verdicts", request + ", verdict string, seq bigint", n)
    assert {r.id: r.verdict for r in verdicts.collect()} == {4: "conflict", 5: "ok"}
    assert sorted(tuple(r) for r in log.read(spark, "heads", HEADS).collect()) == [(1, 1, 1), (1, 2, 9), (2, 1, 5)]
    assert sorted((r.ws, r.hash[0]) for r in log.read(spark, "refs", REFS).collect()) == [(1, "a"), (1, "b"), (2, "c")]
    put([(6, 1, "u", "d", False, 2)], {6: "a"})
    assert sorted((r.ws, r.seq) for r in log.read(spark, "heads", HEADS).collect()) == [(1, 2), (1, 3), (2, 1)]  # two are kept
