"""Files from chunks, against their concatenation."""

import hashlib
import random

import pytest

from treeline.sources import assembly

FILES, POOL = "path string, pos int, hash string", "hash string, data binary"


def test_files(spark, tmp_path):
    rng = random.Random(3)
    chunks = [rng.randbytes(rng.choice([1, 1000, 300_000])) for _ in range(30)]
    names = [hashlib.sha256(c).hexdigest() for c in chunks]
    wanted = {"a": [0, 1, 2], "deep/b": [3, 0, 0, 4], "big": [rng.randrange(30) for _ in range(150)], "gone": [5, -1], "torn": [6, 7]}
    torn = hashlib.sha256(b"something else").hexdigest()
    of = lambda k: "0" * 64 if k < 0 else torn if k == 7 else names[k]
    wanted["big"] = [8 if k == 7 else k for k in wanted["big"]]
    rows = [(p, pos, of(k)) for p, ks in wanted.items() for pos, k in enumerate(ks)]
    rng.shuffle(rows)
    pool = [(n, bytearray(c)) for k, (n, c) in enumerate(zip(names, chunks, strict=True)) if k != 7] + [(torn, bytearray(b"damaged")), (names[0], bytearray(chunks[0]))]
    files = spark.createDataFrame(rows, FILES).repartition(5)
    for _ in range(2):  # again over what is there
        got = {r.path: r for r in assembly.assemble_files(files, spark.createDataFrame(pool, POOL), str(tmp_path), "1m").collect()}
        assert {p: r.complete for p, r in got.items()} == {"a": True, "deep/b": True, "big": True, "gone": False, "torn": False}
        for p in ("a", "deep/b", "big"):
            data = b"".join(chunks[k] for k in wanted[p])
            assert (tmp_path / p).read_bytes() == data and got[p].sha256 == hashlib.sha256(data).hexdigest() and (got[p].size, got[p].parts) == (len(data), len(wanted[p]))
        assert not (tmp_path / "gone").exists() and not (tmp_path / "torn").exists()
    assert assembly.assemble_files(files.limit(0), spark.createDataFrame(pool, POOL), str(tmp_path)).count() == 0


def test_paths_stay_below_the_root(spark, tmp_path):
    one = hashlib.sha256(b"x").hexdigest()
    with pytest.raises(Exception, match="leaves the tree"):
        assembly.assemble_files(spark.createDataFrame([("../x", 0, one)], FILES), spark.createDataFrame([(one, bytearray(b"x"))], POOL), str(tmp_path / "root"))


def test_places_are_written_down(spark, tmp_path):
    """Where chunks lie is worked out once: the result reads it, with packed names of what is fetched only."""
    one = hashlib.sha256(b"x").hexdigest()
    files = spark.createDataFrame([("a", 0, one), ("a", 1, one), ("b", 0, one), ("b", 1, "odd"), ("c", 0, None)], FILES)
    got = assembly.assemble_files(files, spark.createDataFrame([(one, bytearray(b"x"))] * 2, POOL), str(tmp_path))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.complete, r.size, r.parts) for r in got.collect()} == {("a", True, 2, 2), ("b", False, None, 2), ("c", False, None, 1)}
    placed = spark.read.parquet(*[str(p) for p in tmp_path.glob(".tmp-*/placed")])
    assert sorted((r.path, r.offset, r.hash and bytes(r.hash).hex()) for r in placed.collect() if r.hash) == [("a", 0, one), ("a", 1, one)]


def test_file_work_is_spread(spark, tmp_path):
    """Small files are few bytes and much work: tasks are not made fewer for it, and leave no empty folders. Paths are checked
    however often their folder came before."""
    data = [bytes([k]) * 3 for k in range(50)]
    names = [hashlib.sha256(d).hexdigest() for d in data]
    files = spark.createDataFrame([(f"d{k % 20}/f{k}", pos, names[(k + pos) % 50]) for k in range(400) for pos in range(2)], FILES)
    pool = spark.createDataFrame([(n, bytearray(d)) for n, d in zip(names, data, strict=True)], POOL)
    got = {r.path: r.sha256 for r in assembly.assemble_files(files, pool, str(tmp_path)).collect()}
    assert got == {f"d{k % 20}/f{k}": hashlib.sha256(data[k % 50] + data[(k + 1) % 50]).hexdigest() for k in range(400)}
    for table in ("summary", "out"):
        assert len(list(tmp_path.glob(f".tmp-*/{table}/part-*.parquet"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(p.name for p in next(iter(tmp_path.glob(".tmp-*"))).iterdir()) == ["out", "placed", "summary"]
    for bad in ("d1//x", "/x", "./x", "d1/../x"):
        with pytest.raises(Exception, match="leaves the tree"):
            assembly.assemble_files(spark.createDataFrame([("d1/a", 0, names[0]), (bad, 0, names[0])], FILES), pool, str(tmp_path))
