"""Golden rows for diff, merge, validity, retention, packing and debouncing."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.functions import crypto, scalars
from treeline.operators import access, diffing, folds, merging, packing, pool, predicates, retention
from treeline.plans import catalogue
from treeline.sources.store import MANIFEST

STAMP = "2019-08-03 221107"


def e(path, seed, mtime, nanos=0, ws="w", mode=420):
    return (ws, path, seed + 1, mode, mtime, nanos, [f"{seed:02x}" * 32])


def manifest(spark, *rows):
    return spark.createDataFrame(list(rows), MANIFEST)


def test_diff(spark):
    old = manifest(spark, e("keep", 1, 1), e("change", 2, 1), e("delete", 3, 1), e("f", 1, 1))
    new = manifest(spark, e("keep", 1, 1), e("change", 4, 1), e("add", 5, 1), e("f", 1, 1, mode=493))
    assert {(r.path, r.change) for r in diffing.diff(old, new).collect()} == {("add", "added"), ("change", "changed"), ("delete", "deleted"), ("f", "changed")}


#: What a side may have: nothing, or content, seconds and nanoseconds. All triples are tried.
SIDES = [None, (40, 700, 0), (41, 700, 0), (41, 650, 9), (42, 700, 1)]


def outcome(base, local, remote):
    """Winner and loser, in words: who did not change takes the other's, an edit beats a delete, equal contents take the
    later time, else the later one wins and the other is kept; the remote side wins ties."""
    if local == remote or remote == base:
        return local, None
    if local == base:
        return remote, None
    if local is None or remote is None:
        return local or remote, None
    later = remote if remote[1:] >= local[1:] else local
    return later, None if local[0] == remote[0] else "local" if later == remote else "remote"


CASES = [(b, x, y, *outcome(b, x, y)) for b in SIDES for x in SIDES for y in SIDES]


def test_merge_cases(spark):
    sides = [manifest(spark, *[e("f", *c[k], ws=str(i)) for i, c in enumerate(CASES) if c[k]]) for k in range(3)]
    decided = merging.decide(*sides)
    lost = merging.conflicts(decided, "dev", STAMP)
    merged = {(r.ws, r.path): (r.size - 1, r.mtime_secs, r.mtime_nanos) for r in merging.merged_rows(decided, lost).collect()}
    losers = {r.ws: (r.loser, r.copy) for r in lost.collect()}
    applied = {(r.ws, r.path, r.change) for r in merging.apply_list(sides[1], merging.merged_rows(decided, lost), lost).collect()}
    for i, (_, local, _, want, loser) in enumerate(CASES):
        assert merged.get((str(i), "f")) == (want or None), i
        assert losers.get(str(i)) == ((loser, f"f (conflict from {'dev' if loser == 'local' else 'remote'} {STAMP})") if loser else None), i
        change = None if want == local else "added" if local is None else "deleted" if want is None else "changed"
        assert {c for w, p, c in applied if w == str(i) and p == "f"} == ({change} if change else set()), i
        assert ((str(i), f"f (conflict from remote {STAMP})", "added") in applied) == (loser == "remote")


def test_conflict_names(spark):
    # where the mark goes: before the last extension, after a name that has none or only begins with a dot
    names = {"song.mid": "song{}.mid", "music/2024/take.v2.wav": "music/2024/take.v2{}.wav", ".profile": ".profile{}", "cfg/.keys.json": "cfg/.keys{}.json", "LICENSE": "LICENSE{}", "odd.": "odd{}.", ".git/index": ".treeline/conflicts/.git/index{}", "t": "t{} 3", "d": "d{} 2"}
    mark = f" (conflict from dev {STAMP})"
    base = manifest(spark, *[e(p, 1, 1) for p in names])
    local = manifest(spark, *[e(p, 2, 2) for p in names], e(f"t{mark} 2", 9, 9), e(f"d{mark}/x", 9, 9))
    remote = manifest(spark, *[e(p, 3, 3) for p in names], e(f"t{mark}", 8, 8))
    lost = merging.conflicts(merging.decide(base, local, remote), "dev", STAMP).collect()
    assert {r.path: r.copy for r in lost} == {p: c.format(mark) for p, c in names.items()}
    assert {r.path for r in lost if r.local_only} == {".git/index"}
    assert spark.range(1).select(merging.device_label(F.lit(" tom/s\\box\n "))).first()[0] == "tom_s_box_" and spark.range(1).select(merging.device_label(F.lit("  "))).first()[0] == "device"


def test_convergence(spark):
    base = manifest(spark, *[e(f"f{k}", 1, 1) for k in range(30)])
    local = manifest(spark, *[e(f"f{k}", 2 if k % 2 else 1, k) for k in range(30) if k % 7])
    remote = manifest(spark, *[e(f"f{k}", 3 if k % 3 else 1, 15) for k in range(30) if k % 5])
    decided = merging.decide(base, local, remote)
    merged = merging.merged_rows(decided, merging.conflicts(decided, "a", STAMP))
    again = merging.decide(remote, remote, merged)
    assert merging.conflicts(again, "b", STAMP).count() == 0
    assert diffing.diff(merged, merging.merged_rows(again, merging.conflicts(again, "b", STAMP))).count() == 0
    assert tuple(merging.unsettled(again).first()) == (0, 0)
    for one, two, three in ((base, local, remote), (local, base, remote), (base, remote, local), (local, local, remote), (remote.limit(0), local, remote)):
        decided = merging.decide(one, two, three)  # not settled: counted as by aligning again
        lost = merging.conflicts(decided, "b", STAMP)
        assert tuple(merging.unsettled(decided).first()) == (lost.count(), diffing.diff(three, merging.merged_rows(decided, lost)).count())
    same = merging.decide(local.select("*"), local, remote)
    assert same.exceptAll(merging.decide(local, local, remote)).isEmpty() and merging.decide(local, local, remote).exceptAll(same).isEmpty()


def test_convergence_is_worked_out_once(spark):
    """The first merge is written down, and the second aligns two sides, so few relations are read."""
    df = catalogue.QUERIES["merge_convergence"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 7 and tuple(df.first())[1:] == (0, 0)


@pytest.mark.parametrize(("f", "good", "bad"), [
    (predicates.path_valid, ["docs/img/./logo.png", ".git/config", "x", "deep/.treeline/y", ".env.prod"], ["lib//core", "lib/", "/etc/hosts", "lib/../../etc", "..", "./lib", "", ".TreeLine/tmp", ".treeline", "lib///"]),
    (predicates.is_chunk_hash, ["0123456789abcdef" * 4, "f" * 64], ["0" * 65, "F0" * 32, "0" * 62, "", "zz" * 32]),
    (predicates.is_dotenv, ["api/.env.prod", ".env", "web/app/.envfile", ".env-old"], ["web/.Env", ".env.d/readme", "prod.env", "environment", "api/env", ".e"]),
    (predicates.valid_name, ["a", "a b", "é"], ["", ".", "..", "a/b", "a\nb", "x" * 129]),
    (predicates.valid_workspace_id, ["a-b_1.c"], ["...", "a b", "x" * 129, ""]),
    (predicates.is_wrapped_key, ["ab" * 60], ["ab" * 59, "abc", "AB" * 60]),
])
def test_predicates(spark, f, good, bad):
    rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "v string, want boolean")
    assert rows.where(f(F.col("v")) != F.col("want")).collect() == []


def test_prefix_precedence(spark):
    rows = spark.createDataFrame([("src/f9", False), ("src/f9/a", False), ("src/f91", True), ("src/f", True)], "path string, want boolean")
    assert rows.where(predicates.captured(F.col("path"), ["build/generated"], ["src/f9"], F.lit(False)) != F.col("want")).collect() == []
    got = catalogue.QUERIES["prefix_precedence"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() and got.where("path like 'src/f9%' and captured").count()


def test_file_dir(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "a/b"), ("2", "a"), ("2", "a-x"), ("2", "a/b"), ("3", "a/b"), ("3", "a/c")], "ws string, path string")
    assert {(r.ws, r.path) for r in diffing.file_dir_conflicts(rows).collect()} == {("1", "a"), ("2", "a")}


def test_retention(spark):
    now = 1_000_000_000
    cases = [([(k, k * 60) for k in range(1, 11)], set()), ([(1, 3599)], set()), ([(1, -42)], set()), ([(1, 604799)], set()), ([(1, 604800)], {1}), ([(1, 7200), (2, 7800), (3, 10800)], {2}), ([(7, 7200), (9, 7200)], {7}), ([(1, 108000), (2, 144000)], {2})]
    rows = spark.createDataFrame([(c, i, now - age) for c, (x, _) in enumerate(cases) for i, age in x], "ws int, id bigint, created_at bigint")
    gone = {(r.ws, r.id) for r in retention.checkpoint_fates(rows, now).where("pruned").collect()}
    assert gone == {(c, i) for c, (_, want) in enumerate(cases) for i in want}
    heads = spark.range(1, 61).select(F.lit("w").alias("ws"), F.col("id").alias("seq"), F.lit("x").alias("hash"))
    assert retention.retained_heads(heads).count() == 50 and retention.current_head(heads).first().seq == 60


def test_gc(spark):
    h = {n: f"{k:02x}" * 32 for k, n in enumerate(("old", "new", "odd"))}
    rows = spark.createDataFrame([("w", s, True) for s in range(2, 52)] + [("bad", 1, False)], "ws string, file int, parseable boolean")
    chunks = spark.createDataFrame([("w", s, h["old" if s == 1 else "new"]) for s in range(1, 52)], "ws string, file int, hash string")
    refs = spark.createDataFrame([("w", h["old"]), ("w", h["new"]), ("bad", h["odd"])], "ws string, hash string")
    blobs = spark.createDataFrame([(h["old"], 0), (h["new"], 0), (h["odd"], 0), (".tmp-x", 0), ("A" * 64, 0), ("f" * 64, 10**9)], "hash string, mtime bigint")
    delta, gone = pool.gc(refs, rows, chunks, blobs, 1000, 600)
    assert [tuple(r) for r in delta.collect()] == [("w", h["old"], "delete")] and [r.hash for r in gone.collect()] == [h["old"]]


def test_sweeps(spark):
    d, bound = "/root/testdata/sf0.001", catalogue.Tables(spark, "/root/testdata/sf0.001")
    for name in ("gc_sweep", "local_sweep"):
        got = catalogue.QUERIES[name](spark, d)
        assert got.count() and not got.join(bound.chunks if name == "local_sweep" else pool.live(retention.retained_heads(bound.heads, 5), bound.chunks), "hash", "left_semi").count()


def test_missing_in_calls(spark):
    rows = [("a", k * k, f"h{k % 7}") for k in range(103)] + [("b", 5, "h1"), (None, 1, "h1")]
    asked = spark.createDataFrame(rows, "user_name string, ord bigint, hash string")
    calls = pool.calls(asked, most=10, cell=7)
    assert {(r.user_name, r.ord): r.call for r in calls.collect()} == {("a", k * k): k // 10 for k in range(103)} | {("b", 5): 0, (None, 1): 0}
    blobs = spark.createDataFrame([("h1",), ("h2",)], "hash string")
    seen = spark.createDataFrame([("a", "h1")], "user_name string, hash string")
    got = sorted((tuple(r) for r in pool.missing(calls, blobs, seen, most=10).collect()), key=str)
    assert got == sorted((r for r in rows if (r[0], r[2]) != ("a", "h1")), key=str)
    with pytest.raises(Exception, match="too many hashes"):
        pool.missing(calls, blobs, seen, most=9).collect()


def test_fetch_plan(spark):
    mib = 1 << 20
    cases = [([], []), ([(0, 0)], []), ([(10, 10)] * 13, [120, 10]), ([(8 * mib, 2)] * 5, [8, 2]), ([(4 * mib, 1)] * 8 + [(1, 1)], [8, 1]), ([(1, 1), (64 * mib, 17), (1, 1)], [1, 17, 1]), ([(4096, 200)], [200]), ([(8 * mib, 3)] * 10, [12, 12, 6])]
    rows = spark.createDataFrame([(c, o, s, n) for c, (x, _) in enumerate(cases) for o, (s, n) in enumerate(x)], "ws bigint, ord bigint, size bigint, new bigint")
    got = {}
    for r in sorted(folds.next_fit(rows).collect()):
        got.setdefault(r.ws, []).append(r.hashes)
    assert got == {c: want for c, (_, want) in enumerate(cases) if want}


def packed(rows, most_hashes, most_bytes):
    """The definition, a row at a time."""
    out, ws, batch, hashes, size = [], None, 0, 0, 0
    for w, _, s, n in [*sorted(rows), (None, 0, 0, 0)]:
        if w != ws:
            out += [(ws, batch, hashes, size)] if hashes else []
            ws, batch, hashes, size = w, 0, 0, 0
        if hashes and (hashes + n > most_hashes or size + s > most_bytes):
            out.append((ws, batch, hashes, size))
            batch, hashes, size = batch + 1, 0, 0
        hashes, size = hashes + n, size + s
    return out


@pytest.mark.parametrize("seed", range(4))
def test_next_fit_over_partitions(spark, seed):
    """One workspace lies in many partitions, others in one; files without hashes, without bytes, and over the caps."""
    rng = random.Random(seed)
    sizes, news = [[0, 0, 1, 9, 40], [0, 3], [0, 0, 0, 0, 70], [1]][seed], [[0, 0, 1, 2, 9], [0] * 30 + [1], [0, 0, 12], [1]][seed]
    rows = [(w, k, rng.choice(sizes), rng.choice(news)) for w, n in enumerate([600, 1, 0, 40, 7, 500, 3]) for k in range(n)]
    df = spark.createDataFrame(rows, "ws bigint, ord bigint, size bigint, new bigint").repartition(5)
    for partitions in (1, 13):
        got = packing.next_fit(df.withColumn("batch", F.lit("x")), 8, 50, partitions).collect()
        assert sorted(map(tuple, got)) == sorted(packed(rows, 8, 50))


def test_next_fit_edges(spark):
    shape = "ws bigint, ord bigint, size bigint, new bigint"
    assert packing.next_fit(spark.createDataFrame([], shape)).collect() == []
    rows = [(None, 1, 1, 1), (1, 1, None, 1), (1, 2, 5, None), (1, 3, 1, 200), (1, 4, 0, 0), (1, 5, 0, 1), (2, 1, 7, 0)]
    got = sorted(map(tuple, packing.next_fit(spark.createDataFrame(rows, shape)).collect()))
    assert got == [(1, 0, 1, 5), (1, 1, 200, 1), (1, 2, 1, 0)]


def test_debounce(spark):
    rows = spark.createDataFrame([(1, k, t, w) for k, (t, w) in enumerate([(0, False), (1, True), (10, False), (12, True), (14, True), (16, True), (18, False)])], "ws bigint, id bigint, at bigint, wanted boolean")
    got = [(r.opened, r.last, r.n, r.capped, r.runs) for r in sorted(folds.debounce(rows, 3, 6).collect(), key=lambda r: r.opened)]
    assert got == [(0, 1, 2, False, True), (10, 16, 4, True, True), (18, 18, 1, False, False)]


def test_access(spark):
    ring = "ws int, generation int, key string"
    mine, other = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], ring), spark.createDataFrame([(1, 1, "a"), (1, 2, "B"), (1, 3, "c"), (2, 1, "a")], ring)
    rows = access.keyring_union(mine, other).collect()
    assert {(r.ws, r.generation, r.key) for r in rows} == {(1, 1, "a"), (1, 2, "B"), (1, 3, "c"), (2, 1, "a")} and {(r.ws, r.generation) for r in rows if r.adopted} == {(1, 2), (1, 3)}
    ws = spark.createDataFrame([("ws-1", 1, "jane", "n")], "ws string, team int, owner string, name string")
    members = spark.createDataFrame([(1, "jane", 3), (1, "bob", 2), (1, "carol", 1)], "team int, user_name string, role int")
    need = spark.createDataFrame([("ws-1", u, n) for u in ("jane", "bob", "carol", "dave") for n in (1, 2)], "ws string, user_name string, need int")
    got = {(r.user_name, r.need): r.status for r in access.gate(need, access.effective_roles(ws, members)).collect()}
    assert got == {("jane", 1): 200, ("jane", 2): 200, ("bob", 1): 200, ("bob", 2): 200, ("carol", 1): 200, ("carol", 2): 403, ("dave", 1): 404, ("dave", 2): 404}


def test_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for secs, want in ((1774366200, "2026-03-24 153000"), (0, "1970-01-01 000000"), (1709208000, "2024-02-29 120000"), (1767225599, "2025-12-31 235959"), (-5, "1970-01-01 000000")):
        assert one(scalars.conflict_stamp(F.lit(secs))) == want
    assert [one(scalars.backoff(F.lit(k))) for k in range(1, 8)] == [1, 2, 4, 8, 16, 30, 30]
    assert bytes(one(scalars.strict_base64(F.lit("YWJj")))) == b"abc" and one(scalars.strict_base64(F.lit("YWJ"))) is None
    mac = one(F.hex(crypto.hmac_sha256(F.unhex(F.lit("0b" * 20)), F.encode(F.lit("Hi There"), "UTF-8"))))
    assert mac.lower() == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"  # RFC 4231, case 1
    okm = one(F.hex(crypto.hkdf_sha256(F.unhex(F.lit("0b" * 22)), F.unhex(F.lit("000102030405060708090a0b0c")), F.unhex(F.lit("f0f1f2f3f4f5f6f7f8f9")), 2)))
    assert okm.lower().startswith("3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865")  # RFC 5869, case 1
