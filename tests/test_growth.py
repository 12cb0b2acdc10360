"""What grows with the square of the input is not made, or not dealt: rows written to exchanges are counted."""

import hashlib
import json
import struct

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treeline.functions import scalars
from treeline.operators import access, envelopes, pool
from treeline.plans import adapters as A
from treeline.plans import catalogue
from treeline.plans import cycles as cycle_plans
from treeline.sources import chunks, collection
from treeline.streaming import feeds

SPACES, USERS = 2000, 600


@pytest.fixture(scope="module")
def one_nation(spark, tmp_path_factory):
    """A nation with 2000 customers and 600 suppliers: 1.2 million pairs."""
    d = str(tmp_path_factory.mktemp("nation"))
    con = duckdb.connect()
    src = "/root/testdata/sf0.001"
    tables = {
        "customer": f"select range as c_custkey, 'c' as c_name, 3 as c_nationkey from range({SPACES})",
        "supplier": f"select range as s_suppkey, 's' || range as s_name, 3 as s_nationkey from range({USERS})",
        "orders": f"select o_orderkey, o_orderkey % {SPACES} as o_custkey, o_orderdate from '{src}/orders.parquet'",
    }
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"copy ({tables.get(t, f'''select * from '{src}/{t}.parquet' ''')}) to '{d}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, con


def dealt(spark, df):
    """The rows of df, and how many rows were written to exchanges for them."""
    store, gate = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gate.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    before = stages()
    rows = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first()
    return rows[0], sum(s.shuffleWriteRecords() for k, s in stages().items() if k not in before)


@pytest.mark.parametrize("name", [
    "role_gate", "role_gate_admins", "capability_matrix", "effective_roles", "departed_members", "key_rotation", "rotated_rings", "rotation_report",
    "remove_member_cascade", "wrapped_key_deletes", "wrapped_key_lookups", "commit_verdicts", "chunk_visibility", "resolve_workspace",
])
def test_pairs_of_workspaces_and_members(spark, one_nation, name):
    d, con = one_nation
    df = catalogue.QUERIES[name](spark, d)
    rows, moved = dealt(spark, df)
    assert moved < SPACES * USERS / 10
    cols = ", ".join(f'"{c}"' for c in df.columns)
    assert rows == con.execute(f"select count(*) from (select {cols} from ({catalogue.SQL[name]}) q) z").fetchall()[0][0]


def test_scopes_are_the_relation(spark):
    """The keys by scopes are those of the SQL."""
    for text, inside in ((catalogue._LAST, catalogue._LAST_IN), (catalogue._NOWM, catalogue._NOWM_IN)):
        whole = A.rows(spark, "/root/testdata/sf0.001", text)
        parts = A.rows(spark, "/root/testdata/sf0.001", catalogue._SPACES).join(A.rows(spark, "/root/testdata/sf0.001", inside), "scope").select("ws", "user_name")
        assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()


def test_roles_of_odd_rows(spark):
    """Workspaces of two teams, members twice, owners who are members, no team, no owner."""
    spaces = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, None), (3, None, "b"), (4, 2, "c"), (5, 9, "d")], "ws int, team int, owner string")
    members = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "b", 2), (2, "b", 1), (2, "c", 2), (None, "x", 3), (2, "e", 1)], "team int, user_name string, role int")
    want = {(1, "a"): 3, (1, "b"): 2, (1, "c"): 2, (1, "e"): 1, (2, None): 3, (2, "a"): 1, (2, "b"): 2, (3, "b"): 3, (4, "c"): 3, (4, "b"): 1, (4, "e"): 1, (5, "d"): 3}
    rows = access.effective_roles(spaces, members).collect()
    assert len(rows) == len(want) and {(r.ws, r.user_name): r.role for r in rows} == want
    counts = {r.role: r.n for r in access.role_counts(spaces, members).collect()}
    assert counts == {k: list(want.values()).count(k) for k in (1, 2, 3)}
    asked = spark.createDataFrame([(w, u) for w in range(1, 7) for u in "abcdex"] * 2, "ws int, user_name string")
    assert {(r.ws, r.user_name): r.role for r in access.roles_for(asked, spaces, members).collect()} == {k: v for k, v in want.items() if k[1]}


def test_stamps_of_far_years(spark):
    got = spark.range(1).select(*[scalars.conflict_stamp(F.lit(s)).alias(str(s)) for s in (253402300799, 253402300800)]).first()
    assert tuple(got) == ("9999-12-31 235959", "10000-01-01 000000")


def test_retries_of_one_time(spark):
    """Two cycles at one time are in order of id, however the rows come."""
    rows = [(1, 7, 10, True), (1, 8, 10, False), (2, 7, 10, False), (2, 8, 10, True)]
    for some in (rows, rows[::-1]):
        got = feeds.retries(spark.createDataFrame(some, "ws int, id int, at bigint, ok boolean")).where("retry_at is not null").collect()
        assert [(r.ws, r.id, r.retry_at) for r in got] == [(1, 8, 15)]


def test_visible_by_classes(spark):
    """Users of several teams, owners inside and outside of teams, rows twice, no user: as visible says, and as asked for."""
    spaces = spark.createDataFrame([(1, 1, "a"), (2, 2, "z"), (3, None, "b"), (4, 1, "b"), (5, 3, None), (1, 2, "a")], "ws int, team int, owner string")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (1, "c"), (9, "d"), (None, "e"), (3, None)], "team int, user_name string")
    refs = spark.createDataFrame([(w, f"h{w * k % 7}") for w in range(1, 7) for k in range(3)], "ws int, hash string").distinct()
    whole = pool.visible(spaces, members, refs)
    want = {tuple(r) for r in whole.groupBy("user_name").agg(F.count(F.lit(1)), F.min("hash")).collect()}
    got = [tuple(r) for r in pool.visible_counts(spaces, members, refs).collect()]
    assert len(got) == len(want) and set(got) == want
    asked = spark.createDataFrame([(u, f"h{k}") for u in "abcdez" for k in range(8)] * 2, "user_name string, hash string")
    got = [tuple(r) for r in pool.visible_of(asked, spaces, members, refs).collect()]
    assert sorted(got) == sorted(tuple(r) for r in whole.where("user_name is not null").collect() if r[0] in "abcdez")


def test_packed_digests(spark):
    """Digests are 32 bytes; other texts, also of 31 to 33 bytes, come back as they were."""
    rows = ["ab" * 32, "AB" * 32, "a" * 64 + "0", "", "x" * 31, "x" * 32, "x" * 33, "ä", None]
    df = spark.createDataFrame([(r,) for r in rows], "hash string").select("hash", pool.packed(F.col("hash")).alias("data"))
    got = df.select("hash", F.octet_length("data").alias("n"), pool.unpacked(F.col("data")).alias("back")).collect()
    assert all(r.back == r.hash for r in got) and [r.hash for r in got if r.n == 32] == ["ab" * 32]


def test_stored_digests_are_packed(spark, tmp_path):
    """What a collection writes down has 32 bytes a digest, and parts are named after their rows were dealt."""
    h = [hashlib.sha256(bytes([k])).hexdigest() for k in range(3)]
    text = json.dumps({"generation": 1, "ciphertext": "AA==", "hashes": h[:2]})
    rows = spark.createDataFrame([(1, 1, text), (2, 1, text), (2, 2, "{")], "ws int, id int, stored string")
    refs = spark.createDataFrame([(1, h[2]), (2, h[2]), (3, h[2])], "ws int, hash string")
    delta, _, _ = collection.collect(refs, rows, refs.selectExpr("hash", "1 as length", "0 as mtime"), 100, 10, str(tmp_path / "rows"))
    assert {tuple(r) for r in delta.collect()} == {(1, h[2], "delete"), (1, h[0], "add"), (1, h[1], "add")}
    assert spark.read.parquet(str(tmp_path / "rows")).schema["hashes"].dataType.simpleString() == "array<binary>"
    plan = cycle_plans._stored(catalogue.Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan[plan.index("Exchange") :] and plan.count("FileScan") == 2


def test_first_references_are_dealt_finely(spark):
    files = spark.range(1000).select((F.col("id") % 3).alias("ws"), (F.col("id") % 7).alias("file"), "id", F.sha2((F.col("id") % 50).cast("string"), 256).alias("hash")).withColumnRenamed("id", "pos")
    rows = pool.first_reference(files)
    assert rows.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) and rows.count() == 150


def test_chunks_are_opened_by_the_newest_key(spark):
    """Sealed under an older generation, torn, and twice; the keys of a workspace do not make a row each."""
    keys = spark.createDataFrame([("w", g, bytes([g]) * 32) for g in (1, 2, 3)], "ws string, generation int, key binary")
    chunks = spark.createDataFrame([("w", b"a"), ("w", b"a"), ("w", b"b")], "ws string, data binary")
    sealed = envelopes.seal_chunks(chunks, keys.where("generation < 3"))
    torn = sealed.limit(1).select("ws", F.lit("0" * 64).alias("hash"), "data")
    got = [r.data and bytes(r.data) for r in envelopes.open_chunks(sealed.unionByName(sealed).unionByName(torn), keys).collect()]
    assert sorted(got, key=str) == sorted([None, b"a", b"b"], key=str)
    plan = envelopes.open_chunks(sealed, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan


def test_frames_come_in_pieces():
    frame = struct.pack("<I", 1) + b"0" * 64 + struct.pack("<Q", 100) + b"x" * 100
    got = list(chunks.unframed_batches(iter([pd.DataFrame({"k": range(10), "frame": [frame] * 9 + [b"?"]})]), "k", 3 * len(frame)))
    assert [len(g) for g in got] == [3, 3, 3, 1] and list(got[3]["error"]) == ["a frame has four bytes at least"]


def test_stamps_as_in_the_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select unnest([0, 11, 12, 2932943, 6672090, 6672091, 6672095, 8999999]::bigint[]) as o_orderkey) to '{tmp_path}/orders.parquet'")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    got = sorted((r.o_orderkey, r.stamp) for r in catalogue.QUERIES["conflict_stamp"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"select o_orderkey, stamp from ({catalogue.SQL['conflict_stamp']}) q").fetchall())


def test_pairs_are_written_short(spark, tmp_path):
    """Keys of 20 scopes with 1000 users each have 1.4 MB of payloads: the rows of a task have those of few scopes."""
    spaces = spark.range(2000).select(F.col("id").alias("ws"), (F.col("id") % 20).cast("int").alias("scope"))
    name, payload = F.concat(F.lit("u"), F.col("id")), F.sha2(F.col("id").cast("string"), 256)
    wrapped = spark.range(20_000).select((F.col("id") % 20).cast("int").alias("scope"), name.alias("user_name"), payload.alias("payload"))
    gone = spark.range(2000).select(F.col("id").alias("ws"), name.alias("user_name"))
    access.unwrapped(gone, spaces, wrapped).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000 * 1000 - 2000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * 2_000_000


def test_blocks_of_users(spark, monkeypatch):
    """Users twice, without a name, in classes of less and more than a block; those in less are in any block."""
    monkeypatch.setattr(access, "BLOCK", 3)
    spaces = [(w, w % 4 if w % 4 else None, [(f"u{(w * k) % 9}",) for k in range(w % 5)] + [(None,)] * (w % 2) if w % 7 else None) for w in range(60)]
    users = [(s, f"u{u}", u * r) for s in range(1, 4) for u in range(s * s) for r in (1, 2)] + [(1, None, 5), (2, None, 6), (None, "u1", 7)]
    frames = spark.createDataFrame(spaces, "ws int, scope int, less array<struct<user_name: string>>"), spark.createDataFrame(users, "scope int, user_name string, n int")
    got = access.expanded(*frames, "scope", "less").select("ws", "user_name", "n").collect()
    want = [(w, u, n) for w, s, less in spaces for t, u, n in users if s is not None and s == t and (u,) not in (less or [])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pairs_keep_their_order(spark):
    """Blocks come one after the other: the sort before the join is not left out."""
    spaces = spark.range(300).select(F.col("id").alias("ws"), F.lit(1).alias("scope"))
    users = spark.range(2000).select(F.lit(1).alias("scope"), F.col("id").cast("string").alias("user_name"))
    parts = access.expanded(spaces, users, "scope").select("ws", "user_name").rdd.mapPartitions(lambda rows: [sum(a != b for a, b in zip(ws, ws[1:])) + 1 for ws in [[r.ws for r in rows]]]).collect()
    assert sum(parts) >= 300 * 4 - len(parts)  # a workspace comes once a block, not once with all its users


def test_missing_is_dealt_by_numbers(spark):
    """Asked chunks are named after they were dealt; rows are dealt for calls only where one ends in a cell."""
    plan = catalogue.QUERIES["chunks_missing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan[plan.index("Exchange") :]
    asked = spark.range(20_000).select(F.lit("a").alias("user_name"), F.col("id").alias("ord"), F.col("id").alias("hash"))
    calls = pool.calls(asked, most=5000, cell=300)
    rows, moved = dealt(spark, calls)
    assert rows == 20_000 and moved < 5000
    assert sorted(tuple(r) for r in calls.groupBy("call").count().collect()) == [(k, 5000) for k in range(4)]
    few, none = asked.limit(0).select("user_name", "hash"), spark.createDataFrame([], "hash bigint")
    assert pool.missing(calls, none, few, most=5000).count() == 20_000
    with pytest.raises(Exception, match="too many hashes"):
        pool.missing(calls, none, few, most=4999).count()


def test_visible_by_numbers(spark):
    spaces = spark.createDataFrame([(1, 1, "a"), (2, 2, "z"), (2, 1, "z"), (3, None, "b")], "ws int, team int, owner string")
    members = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "a")], "team int, user_name string")
    refs = spark.createDataFrame([(1, 10), (2, 20), (2, 20), (3, 30), (4, 40)], "ws int, hash bigint")
    asked = spark.createDataFrame([(u, h) for u in ("a", "b", "c", None) for h in (10, 20, 30, 40, None)] * 2, "user_name string, hash bigint")
    assert sorted(tuple(r) for r in pool.visible_of(asked, spaces, members, refs).collect()) == [("a", 10), ("a", 20), ("b", 20), ("b", 30)]
