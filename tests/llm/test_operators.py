"""Every operator against a library, brute force or SQL, on a table of awkward rows, an empty one and the small documents."""

import base64
import hashlib
import zipfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import bpe, exact_dedup, language, minhash, mixing, queries, substring_dedup, token_counts, topk, toxicity, warc
from treeline.llm.components import components

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977}é" for k in range(30_000))
P40 = " ".join(f"shared{k}" for k in range(40))
TEXTS = [None, "", "   \n", "one", "One", "a b c", "A B  C", P40, f"x {P40} y", f"{P40} {P40}", LONG, LONG + " end", "He " * 200, "tab\tnl\n\n  sp   x", "ß 漢字 <|endoftext|> 'll don't 123 4", "\x1c\x1d odd  Σ　é", " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(97)) + " q r s", "x" * 5000]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "clash", "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[8], rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({queries.SQL[name]}) q").fetchall()
    assert sorted(tuple(r) for r in df.select(cols).collect()) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.SQL.keys() - {"op4_topk", "op11_neighbours"}))
def test_sql_awkward(spark, docs, name, tmp_path):
    con = duckdb.connect()
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    want = con.execute(f"select distinct {', '.join(cols)} from ({queries.SQL[name]}) q").fetchall()
    got = [tuple(r) for r in df.select(cols).collect()]
    assert len(got) == len(TEXTS) + 2
    assert set(got) == set(want)


def test_empty(spark, empty):
    path, pattern = bpe.tokenizer()
    import public_tokenizers

    model = toxicity.index([], {}, np.zeros(0), np.ones(2))
    frames = [bpe.encode_decode(empty, path, pattern), token_counts.token_counts(empty, public_tokenizers.path("word_bpe_49k.json"), 10), exact_dedup.exact_dedup(empty), minhash.near_dedup(empty), substring_dedup.substring_dedup(empty, 35), mixing.Mix(empty).taken(), mixing.mixed_documents(empty), toxicity.score(empty, model), language.identify(empty, language.fit(empty, lambda x: x >= 0))]
    assert [f.count() for f in frames] == [0] * len(frames)
    pages = empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert warc.read_records(warc.locate(warc.archive(pages))).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), 5, 50).count() == 0


def test_bpe(spark, docs):
    import tiktoken

    path, pattern = bpe.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = texts(docs)
    for r in bpe.encode_decode(docs, path, pattern, ids=True, text=True).collect():
        ids = own.encode_ordinary(want[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_text == want[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_bpe_random_characters():
    import random

    import tiktoken

    path, pattern = bpe.tokenizer()
    codec, rng = bpe.Encoder(path, pattern), random.Random(1)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.machine.ranks, special_tokens={})
    spans = [(0x20, 0x7F), (0x80, 0x250), (0x250, 0xD800), (0xE000, 0xFFFE), (0x10000, 0x20000), (0x30000, 0x33000)]
    for _ in range(4000):
        text = "".join(rng.choice(["'s", " ", "e", "7", *[chr(rng.randrange(*rng.choice(spans)))] * 6]) for _ in range(rng.randrange(1, 40)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == own.encode_ordinary(text)
    codec.STEP = 50  # long texts are cut
    text = " ".join("".join(rng.choice("ab é漢1!\n") for _ in range(rng.randrange(0, 9))) for _ in range(3000))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_transducer_settles():
    path, pattern = bpe.tokenizer()
    codec = bpe.Encoder(path, pattern, most_pieces=3)
    codec.machine.most = 50  # states are dropped again and again
    import random

    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.machine.ranks, special_tokens={})
    rng = random.Random(4)
    for n in (1, 5, 600, 3000):
        text = "".join(rng.choices("abcdehtinorsé ", k=n))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == own.encode_ordinary(text)
    machine = bpe.Utf8Machine()
    for data in ("aé漢😀b".encode(), b"\xff\xe2\x82x\xf0\x9f", bytes(range(256))):
        assert "".join(machine.feed(data[k : k + 1]) for k in range(len(data))) + machine.finish() == data.decode("utf-8", "replace")


def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, want = Tokenizer.from_file(path), texts(docs)
    for r in token_counts.token_counts(docs, path, 50).collect():
        n = len(own.encode(want[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(want[r.doc_id].encode()), n > 50)


def test_token_counts_random_characters():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(5)
    own, counter = Tokenizer.from_file(path), token_counts.counter(path)
    spans = [(0x20, 0x7F), (0x80, 0x250), (0x250, 0xD800), (0xE000, 0xFFFE), (0x10000, 0x20000)]
    made = ["".join(chr(rng.integers(*spans[k])) for k in rng.integers(0, 5, n)) for n in rng.integers(1, 60, 4000)]
    made += ["\u200d\U00018ee6", "o\U00010efd\u0301", "a" * 5000, "abcxyzqu" * 2000, "!?.-" * 700, "ééà" * 900, "中文字" * 700]
    assert [counter.count(t) for t in made] == [len(e.ids) for e in own.encode_batch(made, add_special_tokens=False)]


def test_warc(spark, tmp_path):
    rows = [(k, f"http://x/{k}\n y", ["a", "", None, "ä" * 9, "b"][k % 5]) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    first = {}
    for k, _, t in rows:
        first.setdefault(t or "", k)
    packages = warc.archive(pages, folder=f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_records(warc.locate(packages, stretch=100), payloads=True).collect()}
    for k, _, t in rows:
        data, r = (t or "").encode(), got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[t or ""] == k else ("revisit", first[t or ""]))
        assert r.payload is None or bytes(r.payload) == data
    with zipfile.ZipFile(packages.first().uri.removeprefix("file://")) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
    few = warc.read_records(warc.locate(warc.archive(pages, least=2))).where("record_type = 'revisit'").collect()
    assert {r.payload_bytes for r in few} == {18}


def test_zip64(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(tmp_path / "z", "w") as z:
        z.writestr("a", b"x" * 100)
        z.writestr("b", b"y" * 50)
    data = (tmp_path / "z").read_bytes()
    assert b"PK\x06\x06" in data
    found = warc.directory(lambda o, n: data[o : o + n], len(data))
    assert {k: data[o : o + n] for k, (_, o, n) in found.items()} == {"a": b"x" * 100, "b": b"y" * 50}


def test_mixing(spark, docs):
    for df in (spark.read.parquet(f"{DIR}/documents.parquet"), docs):
        mix = mixing.Mix(df, block=16, shard=8)
        rows = mix.taken().collect()
        assert sorted(r.id for r in rows) == sorted(r.doc_id for r in df.collect()) and all(r["size"] * 2 >= r.taken for r in rows)
        names = sorted({r.source for r in df.collect()}, key=lambda s: (s is None, s))
        sizes = Counter()
        for r in df.collect():
            sizes[r.source] += len((r.text or "").encode().split())
        weights, left, want, share = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set(names), {}, 1.5 * sum(sizes.values())
        while True:  # targets that stop, and the rest shared again
            level = share / sum(weights[s] for s in left) if left else 0
            over = {s for s in left if level * weights[s] > 2 * sizes[s]}
            want |= {s: level * weights[s] for s in left}
            if not over:
                break
            want |= {s: 2.0 * sizes[s] for s in over}
            share -= sum(2 * sizes[s] for s in over)
            left -= over
        source = {r.doc_id: r.source for r in df.collect()}
        taken = Counter()
        for r in rows:
            taken[source[r.id]] += r.taken
            assert abs(r.target - want[source[r.id]]) < 1e-6 and r.source_size == sizes[source[r.id]]
        assert all(abs(taken[s] - want[s]) <= 1 for s in names)
        assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.Mix(df, block=16, shard=8).taken().collect()))
        words = mixing.mixed_documents(df, block=16, shard=8).select(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("n")).agg(F.sum("n")).first()[0]
        if df is not docs:
            assert words == sum(taken.values())


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select("id", F.expr(mixing.permuted("id", f"{n}L", "5")).alias("p")).withColumn("b", F.expr(mixing.permuted("p", f"{n}L", "5", back=True))).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.b == r.id for r in rows)


def test_topk(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    rows = [(k, [float(x) for x in centres[k % 5] + 0.05 * rng.normal(size=8)]) for k in range(300)] + [(301, None), (350, [1.0, None]), (400, [float("nan")]), (450, [0.5, 0.25]), (7, [0.5] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 5, 50, block_rows=64, query_rows=3).collect()
    good = [(i, np.floor(256 * np.array(v + [0.0] * (8 - len(v))))) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    for q in {i for i, _ in good if i % 50 == 0}:
        x = next(v for i, v in good if i == q)
        want = sorted((-int(x @ v), i) for i, v in good if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    points = np.array([v for _, v in good])
    tree = topk.CoverTree(points, leaf=8)

    def below(k):
        node = tree.nodes[k]
        return np.concatenate([below(c) for c in node.children]) if node.children else node.rows

    assert any(n.children for n in tree.nodes) and sorted(below(tree.root)) == list(range(len(points)))
    assert all(((points[below(k)] - n.centre) ** 2).sum(1).max() <= n.radius**2 + 1e-6 for k, n in enumerate(tree.nodes) if len(below(k)))
    search = topk.Search(tree, np.array([i for i, _ in good]), 5)
    search.run(points[::10], np.array([i for i, _ in good])[::10])
    assert search.computed < search.whole / 2  # groups that lie close together are pruned


def test_topk_trees_walked_together():
    """Groups of queries share what is pruned: fewer pairs of nodes than a descent from the root for every query node."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    data = np.floor(256 * (np.repeat(centres, 100, 0) + 0.02 * rng.normal(size=(4000, 16))))
    asked = np.floor(256 * (np.repeat(centres[:8], 160, 0) + 0.02 * rng.normal(size=(1280, 16))))
    ids = np.arange(4000) // 2  # every identifier twice
    asked_ids = np.arange(1280) * 3
    search = topk.Search(topk.CoverTree(data, leaf=16), ids, 5)
    best, who = search.run(asked, asked_ids)
    scores = asked @ data.T
    scores[asked_ids[:, None] == ids[None, :]] = -np.inf
    for r in range(len(asked)):
        top = np.lexsort((ids, -scores[r]))[:5]
        assert best[r].tolist() == scores[r][top].tolist() and who[r].tolist() == ids[top].tolist()
    together, nodes = search.pairs, search.tree.nodes
    search.pairs = 0
    search.best[:], search.floor[:] = -np.inf, -np.inf
    for q, node in enumerate(nodes):
        if not node.children:
            search._walk(q, np.array([search.data.root]))
    assert len(nodes) > 20 and together < search.pairs and search.computed < 0.2 * search.whole


def test_topk_random_vectors(spark):
    """Nothing lies close together but one group; queries with several vectors; several cells and blocks."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 24))
    v[100:200] = v[100] + 0.01 * rng.normal(size=(100, 24))
    rows = [(k, [float(x) for x in v[k] / 6]) for k in range(400)] + [(50, [0.25] * 24)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 5, 50, block_rows=32, query_rows=3).collect()
    good = [(i, np.floor(256 * np.array(x))) for i, x in rows]
    want = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_tree_merge(spark):
    rows = [(hashlib.sha256(b"%d" % (k % 40 if k % 3 else 0)).digest(), k, 1, 1, 1) for k in range(300)]
    merged = exact_dedup.tree_merge(spark.createDataFrame(rows, "digest binary, id bigint, n bigint, size bigint, crc bigint").repartition(7), "min", 2, 3).collect()
    want = {}
    for d, k, *_ in rows:
        want.setdefault(d, []).append(k)
    assert {bytes(r.digest): (r.id, r.n) for r in merged} == {d: (min(v), len(v)) for d, v in want.items()}
    with pytest.raises(Exception, match="equal digests of different texts"):
        exact_dedup.tree_merge(spark.createDataFrame([(b"d" * 32, 1, 1, 1, 1), (b"d" * 32, 2, 1, 2, 1)], "digest binary, id bigint, n bigint, size bigint, crc bigint")).collect()


def test_components(spark):
    got = components(spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 150)], "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {k: 1 for k in range(1, 41)} | {100: 100, 200: 100, 150: 100}


def thue_morse(n):
    """Two different words that polynomial hashes modulo 2**64 take for equal."""
    a = bytes(97 + bin(k).count("1") % 2 for k in range(n)).decode()
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    a, b = thue_morse(1024)
    rest = " ".join(f"w{k}" for k in range(34))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id bigint, text string")
    assert [r.n_removed for r in substring_dedup.substring_dedup(df, 35).collect()] == [0, 0]
    df = spark.createDataFrame([(1, f"{a} b c d e"), (2, f"{b} b c d e")], "doc_id bigint, text string")
    assert sorted(r.component_id for r in minhash.near_dedup(df).collect()) == [1, 2]


def test_rows_of_one_identifier(spark):
    """Other texts under one identifier keep their own results."""
    rows = [(1, P40), (1, "other words"), (2, "x " + P40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df, 35).collect()) == [(1, 2, 0), (1, 40, 40), (2, 41, 40)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_dedup(df).collect()) == [(1, 1, 1), (1, 36, 1), (2, 37, 1)]


def test_minhash_unit_pairs():
    values = np.arange(64, dtype=np.uint8)
    sigs = [values.copy() for _ in range(4)]
    sigs[1][:8] += 100  # of eight bands the first differs
    sigs[2][:32] += 100  # half of the values differ
    near = minhash.Near(75, 100, 64)
    near.least = 45
    held = [(0, k, k if k < 3 else 0, 100 if k < 3 else 70, s.view(np.int64)) for k, s in enumerate(sigs)]
    assert near.pairs(0, held) == [] and near.pairs(1, held) == [(0, 1)]  # the fourth is of the first one's component and too short for others
    near.least = 20
    assert [near.pairs(band, held) for band in (0, 1, 4)] == [[(1, 2)], [(0, 1)], [(0, 2)]]
    assert near.pairs(1, [(k % 2, *h[1:]) for k, h in enumerate(held)]) == [(0, 1)]


@pytest.mark.parametrize("block", [2048, 3])
def test_minhash_mixed_buckets(spark, block, monkeypatch):
    """A long tail of near and half-near texts in the same buckets, whole and in blocks, against brute force."""
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(60)]
    made = []
    for k in range(70):
        words = list(base)
        for p in rng.integers(0, 60, k % 7):
            words[p] = f"x{rng.integers(0, 9)}"
        made.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    if block != 2048:
        whole = minhash.close_links
        monkeypatch.setattr(minhash, "close_links", lambda *a: whole(*a, block=block))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, made)]
    up = list(range(70))
    for i in range(70):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[k]) - both):
                a, b = sorted((up[i], up[k]))
                up = [a if x == b else x for x in up]
    assert len(set(up)) > 5
    assert {r.doc_id: r.component_id for r in minhash.near_dedup(df).collect()} == dict(enumerate(up))


def test_toxicity_neighbours():
    rng = np.random.default_rng(1)
    idf = rng.uniform(1, 4, 30)
    examples = [(k, int(k % 3 == 0), {int(t): int(rng.integers(1, 4)) for t in rng.choice(30, rng.integers(1, 6), replace=False)}) for k in range(200)]
    model = toxicity.index(examples, {}, idf, np.ones(2), size=8)

    def dense(counts):
        out = np.zeros(31)
        t, w = toxicity.weigh(counts, idf)
        out[t] = w
        return out

    by_id = {i: dense(c) for i, _, c in examples}
    for _, _, counts in examples[:40]:
        at, near = toxicity.nearest(model, counts, 7)
        cosines = sorted((-float(dense(counts) @ by_id[i]) for i in by_id))[:7]
        assert np.allclose(near, [-c for c in cosines]) and np.allclose([by_id[i] @ dense(counts) for i in model.ids[at]], near)


def test_toxicity(spark, docs):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = toxicity.op7_toxicity(spark, d).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    model = toxicity.model_of(spark, d)
    assert toxicity.score(docs, model).count() == len(TEXTS) + 2


def test_toxicity_searches_every_text(spark):
    d = "/root/testdata/sf0.01"
    model = toxicity.model_of(spark, d)
    rows = [(k, t) for k, t in enumerate(["the and of", "unheard", "...", "", None])]
    found = {r.doc_id: r.evidence for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert all(len(found[k]) == 3 for k in (0, 1, 2)) and not found[3] and not found[4]
    assert {"the", "and", "of"} <= set(model.terms)
    examples = [(k, k % 2, {t: 1 + k % 3 for t in range(k % 7, 40, 1 + k % 5)}) for k in range(90)]
    idf = 1 + np.arange(40) / 40
    small = toxicity.index(examples, {}, idf, np.ones(2))
    dense = np.zeros((90, 41))
    for k, _, counts in examples:
        t, w = toxicity.weigh(counts, idf)
        dense[k, t] = w
    queries = [toxicity.weigh(c, idf) for _, _, c in examples]
    for common, block, kinds in ((0.0, 32, 64), (0.4, 4, 6), (1.0, 32, 2), (0.1, 3, 20)):
        search = toxicity.Search(small, common, block, kinds)
        search.first = 1 + -(-9 // block)
        for k, (at, near) in enumerate(search.nearest(queries, 9)):
            assert at.tolist() == np.lexsort((np.arange(90), -np.round(dense.astype(np.float32).astype(float) @ dense[k], 12)))[:9].tolist() and np.allclose(near, dense[at] @ dense[k])
    assert search.computed < search.asked  # blocks are passed over


def test_language(spark, docs):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = language.op8_language(spark, d).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97
    model = language.fit(spark.read.parquet(f"{d}/documents.parquet"), lambda x: x >= 0)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2)) and all(0 <= r.score <= 1 for r in got.values())
    both = language.Labeller(model).label("der und die von ich das der und " * 5 + "the and with this is the and of " * 5)
    assert [x for x, _ in both[2]] == ["de", "en"]


def test_language_path():
    """The constant path is only taken where the recursion gives it too."""
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b", "c"], {}, np.zeros((1, 3)), {})
    own = language.Labeller(model, penalty=3.0)
    for _ in range(200):
        s = -rng.uniform(0, 4, (rng.integers(1, 7), 3))
        value = lambda p, s=s: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        every = np.array(np.meshgrid(*[range(3)] * len(s))).reshape(len(s), -1).T
        assert abs(value(own.path(s)) - max(value(p) for p in every.tolist())) < 1e-9


def test_substring_rows_and_text(spark, docs):
    rows = substring_dedup.substring_dedup(docs, 35, with_text=True).collect()
    want = texts(docs)
    twice = {8}
    seen = Counter()
    split = {k: t.encode().split() for k, t in want.items()}
    for k, w in split.items():
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] += 2 if k in twice else 1
    for r in rows:
        w = split[r.doc_id]
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert r.kept is None or r.kept == kept.decode()


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, d).collect()
    names = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= names and all(len(r.ids) == r.n_tokens for r in rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = corpus_pipeline.distinct(spark, docs, d)
    low = lambda t: (t or "").encode().lower()
    first = {}
    for r in sorted(docs.collect()):
        first.setdefault(low(r.text), r.doc_id)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(first.values())
    clean = corpus_pipeline.clean(spark, docs, d)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.model_of(spark, d)).collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, s in scores.items() if s < toxicity.THRESHOLD}
    apart = corpus_pipeline.unlike(spark, docs, d)
    assert {r.doc_id for r in apart.collect()} == {r.doc_id for r in minhash.near_dedup(docs).where("kept").collect()}


def test_hot_texts_stay_where_they_are(spark):
    """Half of all rows have one text and a quarter none: the results still come whole, and their rows are not dealt."""
    words = "one two three four five six seven eight nine ten".split()
    rows = [(k, " ".join(words) if k % 2 else None if k % 4 else " ".join(words[i % 10] + str(k) for i in range(8))) for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_dedup(df).collect()}
    assert got == {k: (1, 6) if k % 2 else (k, 0) if k % 4 else (k, 4) for k in range(20_000)}
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        exact = exact_dedup.exact_dedup(df)
        most = exact.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact.collect()} == {k: (1, 10_000) if k % 2 else (2, 5_000) if k % 4 else (k, 1) for k in range(20_000)}
    assert most < 7_500  # a join by digest would put 10,000 rows into one task
