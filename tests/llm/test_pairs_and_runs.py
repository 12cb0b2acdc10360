"""Neighbours, periodic runs and alignment against brute force, on awkward rows, repeated ones and an empty table."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from treeline.llm import alignment, neighbours, periodic

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977}é" for k in range(30_000))
TEXTS = [None, "", "   \n", "one", "a b c", "a b a b a b a b", "x " * 9, "a " * 5, LONG, "p q r s " * 40 + "end", "one two  two two two two two two\tone", "ß 漢字 <|endoftext|> 'll don't 123 4", "\x1c\x1d odd  Σ　é", "a▁b", "x" * 5000, "tab\tnl\n\n  sp   x "]
SCHEMA = "doc_id bigint, text string, codes string, times string, row string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", "clash", "clash", "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], rows[9], rows[11], (None, "a a a a a a a", *["clash"] * 4)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# neighbours


def cosines(rows, k, every):
    out, own = [], {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            key = np.trim_zeros(np.array(v, np.float32) + np.float32(0), "b").tobytes()
            if i not in own or key < own[i][0]:
                own[i] = (key, x)
    for q in sorted(i for i in own if i % every == 0):
        scored = []
        for i, (_, x) in own.items():
            if i != q:
                n = max(len(x), len(own[q][1]))
                a, b = np.pad(own[q][1], (0, n - len(own[q][1]))), np.pad(x, (0, n - len(x)))
                scored.append((-min(1.0, max(-1.0, (a * b).cumsum()[-1] / np.sqrt((a * a).cumsum()[-1] * (b * b).cumsum()[-1]))), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def search(spark, rows, k=5, every=7, **sizes):
    df = spark.createDataFrame([(i, v, 9, 9) for i, v in rows], "vec_id bigint, embedding array<float>, id int, v int").repartition(3)
    return sorted(tuple(r) for r in neighbours.nearest(df, k, every, **sizes).collect())


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rng.normal(size=(400, 12)))]
    rows += [(k, [3.0 * x for x in rows[7][1]]) for k in range(400, 420)]  # ties up to rounding
    rows += [(k, rows[14][1]) for k in range(420, 560)]  # a third are one vector
    rows += [(k, [x * (1 + 1e-6 * k) for x in rows[21][1]]) for k in range(560, 600)]  # closer than rounding to 8 bits tells
    rows += [(k, rows[3][1][:5]) for k in range(600, 604)]  # shorter
    rows += [(700, None), (701, []), (702, [0.0] * 12), (703, [1.0, None]), (704, [float("nan")] * 12), (705, [float("inf"), 1.0]), (None, [1.0] * 12), (707, [-0.0, 1.0]), (708, [0.0, 1.0, 0.0])]
    rows += [(7, rows[7][1]), (21, rows[0][1]), (14, rows[14][1])]  # rows repeated, and an identifier with two vectors
    want = cosines(rows, 5, 7)
    assert search(spark, rows) == want
    assert search(spark, rows, block_rows=16, query_rows=20, group_rows=100) == want
    assert search(spark, rows[:3]) == cosines(rows[:3], 5, 7)
    assert search(spark, rows[:1]) == [] == search(spark, [])
    assert search(spark, rows[1:6]) == []


def test_neighbours_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    got = sorted(tuple(r) for r in neighbours.op11_neighbours(spark, DIR).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(con.execute(neighbours.SQL["op11_neighbours"]).fetchall())


def test_bounds_hold():
    rng = np.random.default_rng(2)
    whole = rng.normal(size=(300, 24)) * rng.uniform(1e-3, 1e3, (300, 1))
    a = neighbours.Block(np.arange(300)[:, None], whole)
    unit = whole / np.linalg.norm(whole, axis=1)[:, None]
    product = a.tile.astype(np.float64) @ a.tile.T.astype(np.float64) * np.outer(a.step, a.step)
    assert (np.abs(unit @ unit.T - product) <= neighbours.Tiles(5)._error(a, a, slice(None)) + 1e-12).all()
    tiles = neighbours.Tiles(5)
    tiles.add(neighbours.Block(np.arange(50)[:, None], whole[:50]))
    tiles.meet(a)
    assert tiles.kept < tiles.pairs / 4  # the bounds tell most pairs apart


# periodic runs


def runs(words):
    if len(words) == 30_000:  # the long text repeats its 977 words
        return [(0, 30_000, 977)]
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words):
    drop = {k for s, n, q in runs(words) for k in range(s + q, s + n)}
    return b" ".join(w for k, w in enumerate(words) if k not in drop)


def periodic_row(words):
    own = runs(words)
    best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(own), *head, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest(), hashlib.sha256(collapsed(words)).hexdigest())


def test_runs_random():
    rng, texts = random.Random(5), []
    for _ in range(600):
        n, kinds = rng.randrange(0, 70), rng.choice([1, 2, 3, 8])
        words = [str(rng.randrange(kinds)) for _ in range(n)]
        for _ in range(rng.randrange(0, 4) if n else 0):
            a, p = rng.randrange(n), rng.randrange(1, 9)
            for i in range(a, min(n, a + rng.randrange(1, 40))):
                words[i] = words[a + (i - a) % p] if a + (i - a) % p < n else words[i]
        texts.append(words)
    a, b = ["a"], ["a", "b"]
    while len(b) < 1500:
        a, b = b, b + a
    texts += [b, (["a"] * 6 + ["b"]) * 9, ["a"] * 500]
    for lo in range(0, len(texts), 41):
        some = texts[lo : lo + 41]
        for words, found in zip(some, periodic.find_runs([" ".join(w).encode() for w in some], [None] * len(some)), strict=True):
            assert found.rows == runs(words)
            assert found.kept == collapsed([w.encode() for w in words])


def test_tree():
    rng = random.Random(6)
    for _ in range(200):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        tree = periodic.SuffixTree(np.array([*text, -1]))
        n = len(text)
        want = sorted((i, d) for d in range(1, n // 2 + 1) for i in range(n - 2 * d + 1) if text[i : i + d] == text[i + d : i + 2 * d] and (i + 2 * d == n or text[i + 2 * d] != text[i + d]))
        assert list(zip(*(x.tolist() for x in tree.repeats(n)), strict=True)) == want
        low, last, depth, *_ = tree.nodes(n)
        for lo, hi, d in zip(low.tolist(), last.tolist(), depth.tolist(), strict=True):
            assert len({tuple(tree.text[i : i + d]) for i in tree.suffix[lo : hi + 1]}) == 1 and hi > lo


def test_periodic(spark, docs, empty):
    got = [tuple(r) for r in periodic.periodic_runs(docs, runs=True, text=True).collect()]
    assert len(got) == len(TEXTS) + 3  # the row without an identifier is out
    for i, *rest, own, text in got:
        words = (TEXTS[i] or "").encode().split()
        assert tuple(rest) == periodic_row(words) and [tuple(r) for r in own] == runs(words) and bytes(text) == collapsed(words)
    assert periodic.periodic_runs(empty).count() == 0


def test_periodic_planted(spark, docs):
    got = periodic.op12_periodic_runs(spark, DIR).collect()
    want = {r.doc_id: (r.text or "").encode().split() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(got) == len(want)
    seen = 0
    for i, *rest in got:
        words = want[i]
        if change := periodic.planted(i, len(words)):
            a, p = change
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, len(words))]
        if len(words) < 1500:
            assert tuple(rest) == periodic_row(words)
            seen += bool(rest[0])
    assert seen > 5


# alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.tokenizers()


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, lambda t: b.encode(t)


def links_of(text, pair, libraries):
    """Groups as text, and pairs of overlapping tokens."""
    sides, whole = [f(text) for f in libraries], (" " + text).encode()
    if not text or any(b"".join(t.data[i] for i in ids) != whole for t, ids in zip(pair, sides, strict=True)):
        return "", [], 0, 0
    spans = []
    for t, ids in zip(pair, sides, strict=True):
        ends = np.cumsum([len(t.data[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends, ids)))
    groups, starts = [], [0, 0]
    for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
        one = []
        for k in (0, 1):
            some = [str(i) for _, e, i in spans[k][starts[k] :] if e <= cut]
            starts[k] += len(some)
            one.append(",".join(some))
        groups.append("|".join(one))
    pairs = [(x, y) for lo, hi, x in spans[0] for a, b, y in spans[1] if lo < b and a < hi] if len(spans[0]) < 3000 else None
    return ";".join(groups), pairs, len(spans[0]), len(spans[1])


def test_words_random(pair, libraries):
    """The tokens of words are those of whole texts, whatever the characters."""
    rng, aligner = random.Random(3), alignment.Aligner(*pair, most_words=500)
    spans = [(0x20, 0x7F), (0x80, 0x250), (0x250, 0x530), (0x600, 0xD800), (0xE000, 0xFFFE), (0x10000, 0x20000), (9, 14), (0x1C, 0x21), (0x2000, 0x2030)]
    texts = ["", " ", "  ", "▁", "a  b\n c", " \t x", "é ", "\0"]
    for _ in range(1500):
        kinds = rng.sample(spans, rng.randrange(1, 4))
        texts.append("".join(rng.choice([" ", " ", "'s", "e", "7", *[chr(rng.randrange(*rng.choice(kinds))) for _ in range(6)]]) for _ in range(rng.randrange(1, 40))))
    for lo in range(0, len(texts), 100):
        some = texts[lo : lo + 100]
        out = aligner.align(some)
        for k, t in enumerate(some):
            groups, pairs, n_a, n_b = links_of(t, pair, libraries)
            assert (out.n_a[k], out.n_b[k], out.n_links[k], out.n_groups[k]) == (n_a, n_b, len(pairs), groups.count(";") + bool(groups)), t
            assert out.digests[k] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("most_pairs", [4_000_000, 0])
def test_alignment(spark, docs, pair, libraries, most_pairs):
    ids = tuple(len(t.data) for t in pair)
    got = alignment.align(docs, alignment.tokenizers, ("test",), ids, most_pairs=most_pairs).collect()
    texts = [*TEXTS, TEXTS[5], TEXTS[9], TEXTS[11], "a a a a a a a"]
    assert len(got) == len(texts)
    own = {t: links_of(t or "", pair, libraries) for t in texts if t is None or len(t) < 10_000}
    long = alignment.Aligner(*pair).align([LONG])
    counts: dict = {}
    for t in texts:
        found = set(own[t][1]) if t in own else set(zip(*np.divmod(long.distinct, ids[1]).__iter__(), strict=True))
        for p in found:
            counts[tuple(map(int, p))] = counts.get(tuple(map(int, p)), 0) + 1
    top: dict = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    for r in got:
        t = TEXTS[r.doc_id] if r.doc_id is not None else "a a a a a a a"
        if t in own:
            groups, pairs, n_a, n_b = own[t]
            assert (r.n_a, r.n_b, r.n_links, r.n_groups) == (n_a, n_b, len(pairs), groups.count(";") + bool(groups))
            assert r.count_sum == sum(counts[p] for p in pairs) and r.n_best == sum(counts[p] == top[p[0]] for p in pairs)
            assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_alignment_empty(spark, empty):
    assert alignment.align(empty, alignment.tokenizers, ("test",), (50257, 32000)).count() == 0
