"""Trees, chunks, frames, the pool, the head log and feeds."""

import os
import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import merging
from treeline.sources import chunks, store, tree
from treeline.streaming import feeds

#: Files, settings and what is captured: a rule of the scan each.
TREES = [
    # a folder's own ignore file counts below it only, and a later line takes a pattern back
    ({"score/.gitignore": "take-*\n!take-9\n", "score/take-1": "", "score/take-9": "", "score/deep/take-2": "", "take-3": ""}, "", {"score/.gitignore", "score/take-9", "take-3"}),
    # what git keeps is captured whatever ignore files say, and so are .env files
    ({".gitignore": "*\n", ".git/refs/heads/trunk": "", ".env.staging": "", "plan.md": ""}, "", {".git/refs/heads/trunk", ".env.staging"}),
    # built-in names go at every depth, but only as whole folder names
    ({"dist/a.js": "", "web/dist/b.js": "", "web/distance.txt": "", "__pycache__/m": "", "pkg/.venv/bin/py": "", "pkg/venv/x": ""}, "", {"web/distance.txt", "pkg/venv/x"}),
    # an include takes back a part of a built-in folder and nothing beside it
    ({"dist/public/logo.svg": "", "dist/tmp/logo.svg": "", "dist/publicity": ""}, 'include = ["dist/public"]', {"dist/public/logo.svg", "treeline.toml"}),
    # an exclude wins over an include and over .env
    ({"dist/public/logo.svg": "", "dist/public/raw/huge.psd": "", "dist/public/.env": "", "dist/public/raw/.env": ""}, 'include = ["dist"]\nexclude = ["dist/public/raw"]', {"dist/public/logo.svg", "dist/public/.env", "treeline.toml"}),
    # the state folder is left out at the root, and is a folder like others elsewhere
    ({".treeline/store/aa": "", "samples/.treeline/readme": "", "one": ""}, "", {"samples/.treeline/readme", "one"}),
]


@pytest.mark.parametrize("case", range(len(TREES)))
def test_scan(spark, tmp_path, case):
    files, config, want = TREES[case]
    for path, text in files.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(text)
    if config:
        (tmp_path / "treeline.toml").write_text("[sync]\n" + config)
    rows = tree.scan(spark, str(tmp_path)).collect()
    assert {r.path for r in rows if r.kind == "file"} == want
    assert all(r.size is not None and r.mtime_secs > 0 for r in rows if r.kind == "file")


def test_ignore_rules():
    rules = tree.IgnoreRules("# no\n*.log\n!keep.log\n/top\ndir/\na/**/z\ndoc/*.txt\n[ab].c\n")
    says = {"x.log": True, "d/x.log": True, "keep.log": False, "top": True, "d/top": None, "a/z": True, "a/b/c/z": True, "doc/a.txt": True, "doc/x/a.txt": None, "a.c": True, "c.c": None}
    assert {p: rules.verdict(p, False) for p in says} == says and rules.verdict("dir", True) and rules.verdict("dir", False) is None


def test_chunks(spark):
    rng = random.Random(1)
    data = rng.randbytes(200_000)
    parts = list(chunks.cut(data, 1024, 4096, 16384))
    assert b"".join(parts) == data and all(1024 <= len(p) <= 16384 for p in parts[:-1]) and len(parts) > 20
    edited = list(chunks.cut(data[:100_000] + bytes(100) + data[100_100:], 1024, 4096, 16384))
    assert len(set(parts) ^ set(edited)) <= 12
    rows = chunks.chunked(spark.createDataFrame([(1, data), (2, b""), (3, None)], "k int, data binary"), least=1024, average=4096, most=16384)
    assert b"".join(bytes(r.chunk) for r in sorted(rows.collect(), key=lambda r: r.idx)) == data
    framed = chunks.framed(rows.select("k", "idx", "hash", F.col("chunk").alias("data")), "k")
    back = chunks.unframe(bytes(framed.first().frame))
    assert b"".join(d for _, d in back) == data
    for bad in (b"", b"\1\0\0\0", bytes(framed.first().frame) + b"x", bytes(framed.first().frame)[:-1]):
        with pytest.raises(ValueError):
            chunks.unframe(bad)


def test_pool(spark, tmp_path):
    own = store.Pool(spark, str(tmp_path / "pool"))
    rows = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "data binary").withColumn("hash", F.sha2("data", 256))
    assert own.put(rows) == 2 and own.put(rows) == 0
    with pytest.raises(Exception, match="bytes are not"):
        own.put(spark.createDataFrame([("0" * 64, b"c")], "hash string, data binary"))


def test_two_writers(spark, tmp_path):
    log = store.HeadLog(str(tmp_path))
    row = lambda p, s, t: ("w", p, s, 420, t, 0, [f"{s:02x}" * 32])
    make = lambda *rows: spark.createDataFrame(list(rows), store.MANIFEST)
    empty = make()
    assert store.converge(log, "w", empty, make(row("f", 1, 10), row("x", 1, 1)), "a", "S")[::3] == (1, True)
    base = make(row("f", 1, 10), row("x", 1, 1))
    raced = []

    def race(attempt):
        if not raced:
            raced.append(store.converge(log, "w", base, make(row("f", 3, 30), row("x", 1, 1)), "b", "S")[0])

    seq, merged, lost, done = store.converge(log, "w", base, make(row("f", 2, 20), row("x", 1, 1)), "a", "S", before_publish=race)
    assert raced == [2] and seq == 3 and done
    assert {(r.path, r.size) for r in merged.collect()} == {("f", 3), ("f (conflict from a S)", 2), ("x", 1)}
    with pytest.raises(store.HeadConflict):
        log.put("w", 1, "{}")
    again = store.converge(log, "w", merged, merged, "a", "S")
    assert again[0] == 3 and not again[3]


def test_documents(spark):
    entry = '{"size":812,"mode":384,"mtime_secs":77,"mtime_nanos":5,"chunks":["%s"]}' % ("5e" * 32)
    rows = spark.createDataFrame([('{"version":1,"workspace_id":"north","files":{"notes/plan.md":%s}}' % entry,), ("not json",), ('{"version":1}',), ('{"version":1,"workspace_id":"b","files":{"x":{"size":1}}}',)], "json string")
    parsed = store.parse_documents(rows)
    assert [r.parseable for r in parsed.collect()] == [True, False, False, False]
    assert store.explode_documents(parsed).first().path == "notes/plan.md"


def test_apply(spark, tmp_path):
    (tmp_path / "old/deep").mkdir(parents=True)
    (tmp_path / "old/deep/f").write_text("x")
    changes = spark.createDataFrame([("w", "old/deep/f", "deleted"), ("w", "new/g", "added"), ("w", ".git/h", "added")], "ws string, path string, change string")
    files = spark.createDataFrame([("new/g", 0o100755, 5, 7, b"hi"), (".git/h", 420, 5, 0, b"")], "path string, mode int, mtime_secs bigint, mtime_nanos bigint, data binary")
    assert store.apply(merging.apply_phases(changes), files, str(tmp_path)) == 3
    assert not (tmp_path / "old").exists() and (tmp_path / "new/g").read_text() == "hi" and (tmp_path / "new/g").stat().st_mtime_ns == 5 * 10**9 + 7
    assert (tmp_path / "new/g").stat().st_mode & 0o777 == 0o755


def test_apply_refuses_names_that_differ_in_case_only(spark, tmp_path):
    changes = spark.createDataFrame([("w", "old", "deleted"), ("w", "d/README", "added")], "ws string, path string, change string")
    files = spark.createDataFrame([("d/README", 420, 5, 0, b"hi")], "path string, mode int, mtime_secs bigint, mtime_nanos bigint, data binary")
    (tmp_path / "old").write_text("x")
    after = spark.createDataFrame([("d/readme",), ("d/README",), ("other",)], "path string")
    with pytest.raises(ValueError, match="d/README"):
        store.apply(merging.apply_phases(changes), files, str(tmp_path), after)
    both = changes.unionByName(spark.createDataFrame([("w", "D/readme", "added")], changes.schema))
    with pytest.raises(ValueError):
        store.apply(merging.apply_phases(both), files, str(tmp_path))
    assert (tmp_path / "old").exists() and not (tmp_path / "d").exists()  # nothing was applied
    assert store.apply(merging.apply_phases(changes), files, str(tmp_path), after.where("path <> 'd/readme'")) == 2


def test_feeds(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1").write_text('{"type":"head_now","workspace":"a","seq":3}\nnoise\n{"type":"head_changed","workspace":"a","seq":5}\n{"type":"other","workspace":"a","seq":9}\n{"type":"head_changed","workspace":"b","seq":1}\n')
    seen = []
    known = {"b": 1}
    feeds.follow(feeds.parse_hints(spark.readStream.text(str(src))), lambda ws, seq: seen.append((ws, seq)), str(tmp_path / "cp"), known).awaitTermination()
    assert seen == [("a", 5)] and known == {"a": 5, "b": 1}
    assert feeds.waits([0] * 7 + [100, 0]) == [1, 2, 4, 8, 16, 30, 30, 1, 2]
    assert feeds.keepalive([1, 50, 50, 1]) == ["none", "ping", "dead", "none"]
