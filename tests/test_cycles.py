"""Cycles, versioned tables, envelopes and what the queries of the catalogue don't reach."""

import json
import os

import pytest
from pyspark.sql import functions as F

from treeline.functions import crypto, scalars
from treeline.operators import access, cycles, diffing, digests, envelopes, merging, pool, predicates, retention, tables
from treeline.sources import store
from treeline.streaming import feeds

ROW = "ws string, path string, size bigint, mode int, mtime_secs bigint, mtime_nanos bigint, chunks array<string>"


def manifest(spark, *rows):
    return spark.createDataFrame([("w", p, 1, 420, t, 0, [c * 64]) for p, t, c in rows], ROW)


def test_pool_by_uri(spark, tmp_path):
    own = store.Pool(spark, f"file://{tmp_path}/pool")
    rows = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "data binary").withColumn("hash", F.sha2("data", 256))
    assert [own.put(rows), own.put(rows), own.read().count()] == [2, 0, 2]
    asked = rows.select("hash").distinct().unionByName(spark.createDataFrame([("f" * 64,)], "hash string"))
    stored = own.read().select("hash", "data").unionByName(spark.createDataFrame([("f" * 64, b"other")], "hash string, data binary"))
    assert sorted((r.data, r.torn) for r in pool.get(asked, stored).select(F.coalesce(F.decode("data", "UTF-8"), F.lit("")).alias("data"), "torn").collect()) == [("", True), ("a", False), ("b", False)]


def test_losers_are_saved_first(spark, tmp_path):
    """A device whose file loses finds its bytes under the conflict name, also when the cycle is run twice."""
    (tmp_path / "song.mid").write_text("mine")
    os.chmod(tmp_path / "song.mid", 0o600)
    base, local, remote = manifest(spark, ("song.mid", 1, "a")), manifest(spark, ("song.mid", 2, "b")), manifest(spark, ("song.mid", 3, "c"))
    decided = merging.decide(base, local, remote)
    lost = merging.conflicts(decided, "dev", "S")
    changes = merging.apply_list(local, merging.merged_rows(decided, lost), lost)
    steps = [(r.step, r.path, r.target) for r in cycles.steps(changes, lost).orderBy("step").collect()]
    assert steps == [(0, "song.mid", "song (conflict from dev S).mid"), (2, "song.mid", "song.mid")]
    files = spark.createDataFrame([("song.mid", 420, 3, 0, b"theirs")], "path string, mode int, mtime_secs bigint, mtime_nanos bigint, data binary")
    for _ in range(2):
        store.materialize(merging.apply_phases(changes), lost, files, str(tmp_path))
        assert (tmp_path / "song.mid").read_text() == "theirs" and (tmp_path / "song (conflict from dev S).mid").read_text() == "mine"
    assert (tmp_path / "song (conflict from dev S).mid").stat().st_mode & 0o777 == 0o600


def test_a_link_is_not_followed(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "in").mkdir()
    os.symlink(tmp_path / "out", tmp_path / "in/away")
    changes = merging.apply_phases(spark.createDataFrame([("w", "away/f", "added")], "ws string, path string, change string"))
    files = spark.createDataFrame([("away/f", 420, 1, 0, b"x")], "path string, mode int, mtime_secs bigint, mtime_nanos bigint, data binary")
    with pytest.raises(Exception, match="link"):
        store.apply(changes, files, str(tmp_path / "in"))
    assert os.listdir(tmp_path / "out") == []
    assert store.apart(str(tmp_path / "in"), str(tmp_path / "out")) and not store.apart(str(tmp_path), str(tmp_path / "in"))


def test_manifest_file(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert store.load_manifest(spark, path) is None
    rows = manifest(spark, ("b", 1, "b"), ("a", 1, "a"))
    store.write_atomic(path, store.to_documents(rows).first().json.encode())
    assert [r.path for r in store.load_manifest(spark, path).orderBy("path").collect()] == ["a", "b"]
    same = store.load_manifest(spark, path)
    print_of = lambda m: digests.roots(m).first().digest
    assert print_of(rows) == print_of(same) != print_of(manifest(spark, ("a", 1, "a")))
    store.write_atomic(path, store.to_documents(manifest(spark, ("a", 1, "a"), ("a/b", 1, "b"))).first().json.encode())
    with pytest.raises(ValueError, match="file_dir"):
        store.load_manifest(spark, path)
    assert {r.violation for r in diffing.violations(manifest(spark, ("../x", 1, "a"), ("y", 1, "z"))).collect()} == {"path", "hash"}


def test_workspace(tmp_path):
    own = store.workspace(str(tmp_path))
    assert store.workspace(str(tmp_path)) == store.workspace(str(tmp_path), own) == own
    with pytest.raises(ValueError, match="this is workspace"):
        store.workspace(str(tmp_path), "other")


def test_versions(spark):
    log = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False), (2, "c", 2, True), (3, None, 5, False)], "k int, v string, version int, gone boolean")
    assert sorted((r.k, r.v) for r in tables.current(log, ["k"]).collect()) == [(1, "b"), (3, None)]
    asked, got = spark.createDataFrame([(2, "x"), (1, "y"), (0, "x")], "ord int, hash string"), spark.createDataFrame([("x", 1), ("y", 2)], "hash string, data int")
    assert [(r.ord, r.data) for r in tables.positional(asked, got, "hash", "ord").collect()] == [(0, 1), (1, 2), (2, 1)]
    with pytest.raises(Exception, match="fewer answers"):
        tables.positional(asked, got.where("data = 1"), "hash", "ord").collect()


def test_envelopes(spark):
    keys = spark.createDataFrame([("w", 1, b"1" * 32), ("w", 2, b"2" * 32)], "ws string, generation int, key binary")
    stored = envelopes.seal_documents(spark.createDataFrame([("w", "{}")], "ws string, json string"), keys, spark.createDataFrame([("w", "b"), ("w", "a"), ("w", "b")], "ws string, hash string"))
    envelope = json.loads(stored.first().stored)
    assert envelope["generation"] == 2 and envelope["hashes"] == ["a", "b"]
    bare = stored.unionByName(spark.createDataFrame([("old", '{"version":1}')], "ws string, stored string"))
    assert {r.ws: r.json for r in envelopes.open_documents(bare, keys).collect()} == {"w": "{}", "old": '{"version":1}'}
    assert envelopes.open_documents(stored, keys.where("generation = 1")).first().json is None
    sealed = envelopes.seal_chunks(spark.createDataFrame([("w", b"x"), ("w", b"x")], "ws string, data binary"), keys)
    assert sealed.count() == 1 and bytes(envelopes.open_chunks(sealed, keys).first().data) == b"x"
    torn = sealed.withColumn("hash", F.lit("0" * 64))
    assert envelopes.open_chunks(torn, keys).first().data is None
    ring = spark.createDataFrame([(b"k" * 32,), (b'{"3":"' + b"ab" * 32 + b'"}',), (b"junk",)], "p binary").select(envelopes.keyring_of_wrapped(F.col("p")).alias("r"))
    assert [r.r for r in ring.collect()] == [{1: (b"k" * 32).hex()}, {3: "ab" * 32}, None]
    blob = spark.createDataFrame([(b"x",)], "d binary").select(crypto.decrypt(crypto.encrypt_blob(F.col("d"), F.lit(b"7" * 32)), F.lit(b"7" * 32)).alias("d"))
    assert bytes(blob.first().d) == b"x"


def test_boundary_order(spark):
    """One request for one base wins; a commit and its references are one decision."""
    req = spark.createDataFrame([(1, "w", "u", "d", False, 3), (2, "w", "u", "d", False, 3), (3, "w", "u", "d\n", False, 3), (4, "w", "r", "d", False, 3), (5, "w", "x", "d", False, 3), (6, "w", "u", "d", True, 3), (7, "w", "u", "d", False, 2)], "id int, ws string, user_name string, device string, sealed boolean, base int")
    roles = spark.createDataFrame([("w", "u", 2), ("w", "r", 1)], "ws string, user_name string, role int")
    sub = spark.createDataFrame([(k, "w", "f", 1, 420, 1, 0, ["a" * 64]) for k in range(1, 8)], "id int, " + ROW)
    ws, heads = spark.createDataFrame([("w", False)], "ws string, e2e boolean"), spark.createDataFrame([("w", 3, 0)], "ws string, seq int, id int")
    named = spark.createDataFrame([("w", "a" * 64)], "ws string, hash string")
    out = cycles.commits(req, roles, ws, sub, ws.where("e2e").select("ws"), named, heads.select("ws", "seq"))
    assert {r.id: r.verdict for r in out.collect()} == {1: "ok", 2: "conflict", 3: "device", 4: "forbidden", 5: "not_found", 6: "e2e_mismatch", 7: "conflict"}
    after, refs = cycles.writes(out, sub, heads, named.limit(0), 1)
    assert [(r.ws, r.seq, r.id) for r in after.collect()] == [("w", 4, 1)] and refs.count() == 1


def test_small_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(predicates.is_hex(F.lit("ab" * 4), 4)) and not value(predicates.is_hex(F.lit("AB" * 4), 4))
    assert value(predicates.has_include_below(F.lit("dist"), ["dist/public"])) and not value(predicates.has_include_below(F.lit("dis"), ["dist/public"]))
    assert value(cycles.device_ok(F.lit("x" * 64))) and not value(cycles.device_ok(F.lit("x" * 65))) and not value(cycles.device_ok(F.lit(None).cast("string")))
    names = spark.createDataFrame([(".tmp-1", 10), (".tmp-2", 95), ("keep", 1)], "name string, mtime int")
    assert [r.name for r in pool.stale_temporaries(names, 100).collect()] == [".tmp-1"]
    tries = spark.createDataFrame([("w", "h", 1, "old"), ("w", "h", 2, "new"), ("w", "h", 3, None)], "ws string, hash string, generation int, data string")
    assert retention.first_decrypting(tries).first().data == "new"
    pins = access.pin_state(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "user_name string, pubkey string"), spark.createDataFrame([("a", "1"), ("b", "9")], "user_name string, pinned string"))
    assert {r.user_name: r.state for r in pins.collect()} == {"a": "match", "b": "mismatch", "c": "first_sight"}
    bad = spark.createDataFrame([("YQ==",), ("YQ",), ("?",)], "t string")
    assert [r.x is not None for r in bad.select(scalars.strict_base64(F.col("t")).alias("x")).collect()] == [True, False, False]


def test_upload_outcome(spark):
    sent = spark.createDataFrame([(1, h, k, 10 + k) for k, h in enumerate("abcd")] + [(2, "a", 1, 5), (2, "e", 2, 6), (3, "e", 1, 6), (3, "f", 2, 7), (4, "g", 1, 8)], "ws bigint, hash string, ord bigint, length bigint")
    present = spark.createDataFrame([("a",), ("a",), (None,)], "hash string")
    told = [(1, "b", True, None), (1, "c", None, "late"), (1, "d", False, None), (2, "e", True, None), (3, "e", True, None), (4, "g", True, None), (4, "g", True, None), (5, "x", True, None)]
    statuses, report = cycles.upload_outcome(sent, present, spark.createDataFrame(told, "ws bigint, hash string, stored boolean, failure string"))
    assert {(r.ws, r.hash): r.status for r in statuses.collect()} == {
        (1, "a"): "present", (1, "b"): "stored", (1, "c"): "failed", (1, "d"): "concurrent", (2, "a"): "present", (2, "e"): "stored",
        (3, "e"): "unconfirmed", (3, "f"): "unconfirmed", (4, "g"): "unconfirmed",  # one answer too few, one too many
    }
    assert sorted(map(tuple, report.collect())) == [(1, 1, 11, 1, 12, "c", "late"), (2, 1, 6, 0, 0, None, None), (3, 0, 0, 2, 13, None, None), (4, 0, 0, 1, 8, None, None)]
    assert [x.count() for x in cycles.upload_outcome(sent.limit(0), present, spark.createDataFrame([], "ws bigint, hash string, stored boolean, failure string"))] == [0, 0]
