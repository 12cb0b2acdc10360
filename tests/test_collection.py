"""Stored rows, torn chunks and registration, on small cases."""

import hashlib
import json

from pyspark.sql import functions as F

from treeline.operators import cycles, pool
from treeline.sources import collection


def document(*chunks, **more):
    entry = {"size": 1, "mode": 420, "mtime_secs": 5, "mtime_nanos": 0, "chunks": list(chunks)}
    return json.dumps({"version": 1, "workspace_id": "w", "scanned_at_secs": 1, "files": {"a": entry, "b": entry}} | more)


def envelope(*chunks):
    return json.dumps({"generation": 2, "ciphertext": "AA==", "hashes": list(chunks)})


def test_stored_chunks(spark):
    texts = [document("x", "y", "x"), envelope("p", "p", "q"), envelope(), document(files={}), document()[:-1], '{"generation": 2, "hashes": ["p"]}', document(files={"a": {"size": 1}}), "", None]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "ws int, id int, stored string")
    got = {r.id: r.hashes for r in collection.stored_chunks(rows).collect()}
    assert got == {0: ["x", "y"], 1: ["p", "q"], 2: [], 3: [], 4: None, 5: None, 6: None, 7: None, 8: None}
    assert collection.stored_chunks(rows.limit(0)).collect() == []


def test_collect(spark, tmp_path):
    """One text that cannot be read saves a whole workspace; a workspace without rows keeps its references."""
    a, b, c, d, e = (hashlib.sha256(x.encode()).hexdigest() for x in "abcde")
    rows = spark.createDataFrame([(1, 1, document(a)), (1, 2, envelope(b)), (2, 1, document(a)), (2, 2, "{"), (None, 1, document(e))], "ws int, id int, stored string")
    refs = spark.createDataFrame([(1, a), (1, c), (2, c), (2, d), (3, d)], "ws int, hash string")
    blobs = spark.createDataFrame([(x, 1, 0) for x in (a, b, c, d, e)] + [("0" * 64, 1, 0), ("1" * 64, 1, 99), ("odd", 1, 0)], "hash string, length int, mtime int")
    delta, swept, skipped = collection.collect(refs, rows, blobs, 100, 10, str(tmp_path / "rows"))
    assert {tuple(r) for r in delta.where("ws is not null").collect()} == {(1, c, "delete"), (1, b, "add")}
    assert {r.ws for r in skipped.collect()} == {2}
    assert {r.hash for r in swept.collect()} == {"0" * 64}  # c and d are still named by 2 and 3
    none = collection.collect(refs.limit(0), rows.limit(0), blobs, 100, 10, str(tmp_path / "none"))
    assert [x.count() for x in none] == [0, 6, 0]


def test_heal(spark):
    h = {x: hashlib.sha256(x.encode()).hexdigest() for x in "abcd"}
    stored = spark.createDataFrame([(h["a"], b"a", 7), (h["b"], b"", 7), (h["c"], None, 7), (h["d"], b"torn", 7)], "hash string, data binary, mtime int")
    asked = spark.createDataFrame([(h["a"],), (h["a"],), (h["b"],), ("0" * 64,), (None,)], "hash string")
    read, rest = pool.heal(asked, stored)
    assert [(r.hash, bytes(r.data)) for r in read.collect()] == [(h["a"], b"a")]
    assert {r.hash for r in rest.collect()} == {h["a"], h["c"], h["d"]} and rest.columns == stored.columns  # d was not asked for
    again = pool.put(spark.createDataFrame([(h["a"], b"a"), (h["b"], b"b")], "hash string, data binary"), rest)
    assert [r.hash for r in again.collect()] == [h["b"]]


def test_register(spark):
    teams = spark.createDataFrame([(1, "red"), (2, "blue")], "team int, name string")
    members = spark.createDataFrame([(1, "ann", 3), (1, "bob", 1), (2, "ann", 2), (2, "cay", 2)], "team int, user_name string, role int")
    there = spark.createDataFrame([("w1", "n1", "ann", None, False), ("w2", "n2", "ann", 1, True), ("w3", "n3", "cay", 2, False), ("w4", "n2", "ann", None, False)], "ws string, name string, owner string, team int, e2e boolean")
    asked = [
        ("w1", "zz", "ann", None, False, "existed", "n1"),
        ("w1", "zz", "ann", None, False, "again", "n1"),
        ("w2", "zz", "bob", "red", True, "attached", "n2"),
        ("w3", "zz", "ann", "blue", True, "flavour", "n3"),
        ("w4", "zz", "ann", "red", False, "name_taken", "n2"),  # w2 has the name
        ("w5", "new", "ann", "blue", True, "create", "new"),
        ("w6", "new", "cay", "blue", False, "name_taken", "new"),  # w5 was first
        ("w7", "new", "ann", "red", False, "create", "new"),
        ("w8", "own", "bob", "red", False, "not_writer", "own"),
        ("w9", "own", "eve", None, False, "create", "own"),
        ("w10", "own", "eve", "green", False, "unknown_team", "own"),
    ]
    rows = spark.createDataFrame([(k, *r[:5]) for k, r in enumerate(asked)], "ord int, ws string, name string, user_name string, team_name string, e2e boolean")
    got = {r.ord: (r.outcome, r.name) for r in cycles.register(rows, there, teams, members).collect()}
    assert got == {k: r[5:] for k, r in enumerate(asked)}
    alone = spark.createDataFrame([(0, "w3", "zz", "ann", "red", False), (1, "w1", "zz", "ann", "red", False)], "ord int, ws string, name string, user_name string, team_name string, e2e boolean")
    assert {r.ord: r.outcome for r in cycles.register(alone, there, teams, members).collect()} == {0: "not_owner", 1: "attach"}
    assert cycles.register(alone.limit(0), there, teams, members).count() == 0


def test_failure_class(spark):
    rows = spark.createDataFrame([(200, False), (204, None), (409, True), (409, False), (403, False), (404, None), (408, False), (429, False), (503, False), (None, False)], "status int, moved boolean")
    assert [r.c for r in rows.select(cycles.failure_class(F.col("status"), F.col("moved")).alias("c")).collect()] == [None, None, "retry", "transient", "read_only", "fatal", "transient", "transient", "transient", "transient"]
