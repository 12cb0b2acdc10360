"""Digest trees, chunks and BLAKE3 against plain definitions of what they compute."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.functions import blake3
from treeline.operators import diffing, digests
from treeline.sources import chunks

ROW = "ws bigint, path string, size bigint, mode int, mtime_secs bigint, mtime_nanos bigint, chunks array<string>"


def manifest(spark, rows, parts=3):
    return spark.createDataFrame([(w, p, s, 420, t, 0, [c]) for w, p, s, t, c in rows], ROW).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    return [(w, f"d{k % 7}/f{k}", k, 5, f"c{k % 9}") for w in (1, 2) for k in range(300)]


def test_roots(spark, rows):
    a = manifest(spark, rows)
    assert digests.unequal(a, manifest(spark, rows[::-1], 7)).count() == 0  # whatever the order
    for other in ([*rows[:-1], (*rows[-1][:3], 6, rows[-1][4])], rows[:-1], [*rows, (2, "new", 0, 0, "c")]):
        assert [r.ws for r in digests.unequal(a, manifest(spark, other)).collect()] == [2]
    assert [r.ws for r in digests.unequal(a, manifest(spark, [r for r in rows if r[0] == 1])).collect()] == [2]
    swapped = [*rows[:-2], (*rows[-2][:2], *rows[-1][2:]), (*rows[-1][:2], *rows[-2][2:])]  # the same contents under other names
    assert [r.ws for r in digests.unequal(a, manifest(spark, swapped)).collect()] == [2]
    assert digests.unequal(a.limit(0), a.limit(0)).count() == 0


def test_tree(spark, rows):
    a = digests.tree(manifest(spark, rows), 2)
    one = {(r.ws, r.node): r for r in a.collect()}
    for (ws, node), r in one.items():
        own = [p for w, p, *_ in rows if w == ws and hashlib.sha256(p.encode()).hexdigest().startswith(node)]
        assert r.n == len(own)
    assert one[1, ""].n == 300 and max(len(n) for _, n in one) == 2
    changed = [(*r[:3], 9, r[4]) if r[:2] == (1, "d3/f10") else r for r in rows]
    b = digests.tree(manifest(spark, changed), 2)
    assert [tuple(r) for r in digests.descend(a, b, 2).collect()] == [(1, hashlib.sha256(b"d3/f10").hexdigest()[:2])]
    differ = {(r.ws, r.node) for r in b.collect()} & {k for k, r in one.items() if (k[0], k[1], r.digest) not in {(x.ws, x.node, x.digest) for x in b.collect()}}
    assert {n for _, n in differ} == {"", *(hashlib.sha256(b"d3/f10").hexdigest()[:k] for k in (1, 2))}  # one way down


def test_one_changed_file_reads_one_shard(spark, rows, tmp_path):
    changed = [(*r[:3], 9, r[4]) if r[:2] == (1, "d3/f10") else r for r in rows]
    a, b = manifest(spark, rows), manifest(spark, changed)
    old, new = digests.Sharded(f"file://{tmp_path}/old", 1).write(a), digests.Sharded(f"file://{tmp_path}/new", 1).write(b)
    got, shards = digests.sharded_diff(old, new, a)
    assert [tuple(r) for r in got.collect()] == [(1, "d3/f10", "changed")] and len(shards) == 1
    read = old.read(a, shards)
    files = {r.f for r in read.select(F.input_file_name().alias("f")).collect()}
    assert {os.path.basename(os.path.dirname(f)) for f in files} == {f"shard=s{shards[0]}"}
    assert digests.sharded_diff(old, old, a)[1] == []
    gone = digests.Sharded(f"file://{tmp_path}/gone", 1).write(manifest(spark, [r for r in rows if r[0] == 1 and r[1] != "d3/f10"]))
    want = sorted(tuple(r) for r in diffing.diff(a, gone.read(a)).collect())
    assert sorted(tuple(r) for r in digests.sharded_diff(old, gone, a)[0].collect()) == want and len(want) == 301


def cut(data, least, average, most):
    """Byte by byte, by the definition."""
    gear = [int.from_bytes(hashlib.sha256(b"gear %d" % i).digest()[:8], "little") for i in range(256)]
    mask = lambda bits: sum(1 << (63 - 2 * k) for k in range(bits))
    bits, at = max(1, average.bit_length() - 1), 0
    strict, loose = mask(bits + 1), mask(max(1, bits - 1))
    while at < len(data):
        h, stop = 0, min(len(data), at + most)
        for i in range(at + least, stop):
            h = ((h << 1) + gear[data[i]]) % 2**64
            if not h & (strict if i < min(len(data), at + average) else loose):
                stop = i + 1
                break
        yield data[at:stop]
        at = stop


def test_cuts():
    rng = np.random.default_rng(1)
    for least, average, most in ((256, 1024, 4096), (0, 16, 100), (1, 8, 8), (64, 64, 128), (10, 300, 300), (500, 128, 900)):
        for n in (0, 1, 63, 64, 65, 5000, 40_000):
            for data in (rng.integers(0, 256, n, np.uint8).tobytes(), rng.integers(0, 2, n, np.uint8).tobytes(), bytes(n)):
                assert list(chunks.cut(data, least, average, most)) == list(cut(data, least, average, most))
    data = rng.integers(0, 256, (1 << 20) + 50_000, np.uint8).tobytes()  # over the edge of a block
    assert list(chunks.cut(data, 256, 1024, 4096)) == list(cut(data, 256, 1024, 4096))


def test_an_edit_changes_few_chunks():
    data = bytearray(np.random.default_rng(2).integers(0, 256, 8 << 20, np.uint8).tobytes())
    before = [hashlib.sha256(c).digest() for c in chunks.cut(bytes(data))]
    data[4 << 20 : (4 << 20) + 100] = bytes(100)
    after = [hashlib.sha256(c).digest() for c in chunks.cut(bytes(data))]
    assert len(before) > 4 and len(set(before) ^ set(after)) <= 4


def test_chunked_names(spark):
    data = np.random.default_rng(3).integers(0, 256, 20_000, np.uint8).tobytes()
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray())], "k int, data binary")
    got = sorted(tuple(r) for r in chunks.chunked(df, least=256, average=1024, most=4096, names="blake3").collect())
    assert b"".join(bytes(r[4]) for r in got) == data and {r[0] for r in got} == {1}
    assert [r[2] for r in got] == [d.hex() for d in blake3.digests([bytes(r[4]) for r in got])]


def plain(data, key=None):
    """BLAKE3 as its definition says, recursively, a value at a time."""
    iv = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
    start, mode = (iv, 0) if key is None else (tuple(int.from_bytes(key[4 * k : 4 * k + 4], "little") for k in range(8)), 16)
    order = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)

    def compress(cv, block, counter, size, flags):
        m = [int.from_bytes(block[4 * k : 4 * k + 4].ljust(4, b"\0"), "little") for k in range(16)]
        v = [*cv, *iv[:4], counter % 2**32, counter >> 32, size, flags]
        rot = lambda x, n: (x >> n | x << (32 - n)) % 2**32
        for _ in range(7):
            for k, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
                for x, (r, s) in ((m[2 * k], (16, 12)), (m[2 * k + 1], (8, 7))):
                    v[a] = (v[a] + v[b] + x) % 2**32
                    v[d] = rot(v[d] ^ v[a], r)
                    v[c] = (v[c] + v[d]) % 2**32
                    v[b] = rot(v[b] ^ v[c], s)
            m = [m[k] for k in order]
        return tuple(v[k] ^ v[k + 8] for k in range(8))

    def node(part, at, root):
        if len(part) <= 1024:
            cv, blocks = start, [part[k : k + 64] for k in range(0, len(part), 64)] or [b""]
            for k, b in enumerate(blocks):
                last = k == len(blocks) - 1
                cv = compress(cv, b, at, len(b), mode | (k == 0) | 2 * last | 8 * (last and root))
            return cv
        left = 1 << ((len(part) - 1) // 1024).bit_length() - 1
        both = node(part[: 1024 * left], at, False) + node(part[1024 * left :], at + left, False)
        return compress(start, b"".join(w.to_bytes(4, "little") for w in both), 0, 64, mode | 4 | 8 * root)

    return b"".join(w.to_bytes(4, "little") for w in node(data, 0, True)).hex()


def test_blake3(spark):
    assert blake3.digests([b""])[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.digests([b"abc"])[0].hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    rng, key = random.Random(4), bytes(range(7, 39))
    values = [bytes(k % 251 for k in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 5000, 9217)]
    values += [rng.randbytes(rng.randrange(6000)) for _ in range(20)]
    assert [d.hex() for d in blake3.digests(values)] == [plain(v) for v in values]
    assert [d.hex() for d in blake3.digests(values, key)] == [plain(v, key) for v in values]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in enumerate(values[:9])] + [(99, None)], "k int, v binary")
    got = {r.k: r.d for r in df.select("k", blake3.blake3(F.col("v")).alias("d")).collect()}
    assert got == {**{k: plain(v) for k, v in enumerate(values[:9])}, 99: None}
    with pytest.raises(ValueError):
        blake3.digests([b""], b"short")
