"""Each stage of the pipeline against a plain version, on awkward rows, an empty table, and columns of clashing names."""

import math
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeline.llm import bpe, mixing, toxicity, warc

DIR = "/root/testdata/sf0.001"
BASE = " ".join(f"shared{k}" for k in range(60))
LONG = " ".join(f"word{k % 977}é" for k in range(20_000))
TEXTS = [None, "", "   \n", "one", "One", "ONE ", "a b c", BASE, BASE + " end", f"start {BASE}", BASE.replace("shared7", "other"), LONG, LONG + " end", "ß 漢字 <|endoftext|> 'll 123", "x" * 5000, "tab\tnl\n\n  sp   x "]
#: Names that the operators use themselves, and a column whose values have no order.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, doc string, key string, mark string, score double, kept boolean, sid int, start int, size int, extra map<string, string>"


@pytest.fixture(scope="module")
def docs(spark):
    own = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)]
    real = [(1000 + r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").limit(90).collect()]
    clash = ("c", "c", "c", "c", 0.5, True, 1, 1, 1, {"a": "b"})
    rows = [(*r, *clash) for r in [*own, *real]]
    return spark.createDataFrame([*rows, rows[8], (None, "no identifier", "en", "s1", 1, *clash)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), DIR)
    assert out.count() == 0 and (name == "encoding" or out.columns == [c.split()[0] for c in SCHEMA.replace("map<string, string>", "m").split(", ")])


def score(m, text, k=15):
    """The score by the cosines with all examples, as sums over dictionaries."""
    if not text.split():
        return m.empty
    counts = Counter(m.terms[t] for w in text.lower().split() for t in toxicity.terms_of(w) if t in m.terms)
    own = {t: (1 + math.log(n)) * m.idf[t] for t, n in counts.items()} | {len(m.idf): 1.0}
    size = math.sqrt(sum(x * x for x in own.values()))
    near = []
    for e in range(len(m.ids)):
        span = slice(m.at[e], m.at[e + 1])
        near.append((-round(sum(own.get(t, 0.0) * float(v) for t, v in zip(m.own[span].tolist(), m.values[span], strict=True)) / size, 12), e))
    votes = [(m.weights[m.labels[e]] / (1.05 + s), m.labels[e]) for s, e in sorted(near)[:k]]
    return (sum(v * y for v, y in votes) + m.base) / (sum(v for v, _ in votes) + 1.0)


def test_clean(spark, docs, texts):
    model = toxicity.model_of(spark, DIR)
    scores = {k: score(model, t) for k, t in texts.items()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect() if r.doc_id is not None}
    assert max(abs(got[k] - scores[k]) for k in scores) < 1e-6
    out = corpus_pipeline.clean(spark, docs, DIR)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id is not None and scores[r.doc_id] < toxicity.THRESHOLD)


def test_distinct(spark, docs, texts):
    low, first = lambda t: t.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), {}
    for k in sorted(texts):
        first.setdefault(low(texts[k]), k)
    out = corpus_pipeline.distinct(spark, docs, DIR)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(first.values())
    assert all(r.extra == {"a": "b"} and r.text == (None if r.doc_id == 0 else texts[r.doc_id]) for r in out.collect())


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_unlike(spark, docs, texts):
    sets, of = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if c == high else c for k, c in of.items()}
    out = corpus_pipeline.unlike(spark, docs, DIR)
    kept = {k for k in texts if of[k] == k}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept and len(kept) < len(texts)


def test_mixed(spark, docs, texts):
    out = corpus_pipeline.mixed(spark, docs, DIR)
    rows = out.collect()
    assert out.columns == docs.columns
    taken = Counter()
    for r in rows:
        words, own = r.text.encode().split(), Counter(texts[r.doc_id].encode().split())
        assert words and not Counter(words) - own and r.extra == {"a": "b"}
        taken[r.doc_id] += len(words)
    want = {r.id: r for r in mixing.Mix(docs.where("doc_id is not null")).taken().collect()}
    for k, t in texts.items():
        assert taken[k] <= 2 * len(t.encode().split())
        if k != 8:  # two equal rows of one identifier
            assert taken[k] == want[k].taken
    by_source: dict = {}
    for r in want.values():
        by_source.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(abs(sum(some) - target) for (_, target), some in by_source.items()) <= 0.02 * sum(t for _, t in by_source) + 2 * want[8].size
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.mixed(spark, docs.repartition(5), DIR).collect()))  # reruns agree


def test_encoded(spark, docs, texts):
    import base64

    import tiktoken

    path, pattern = bpe.tokenizer()
    with open(path, "rb") as f:
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rows = corpus_pipeline.encoded(spark, docs, DIR).collect()
    assert len(rows) == docs.count() - 1  # without the row that has no identifier
    assert all(list(r.ids) == own.encode_ordinary(texts[r.doc_id]) for r in rows)


def test_pages_without_an_identifier(spark):
    pages = spark.createDataFrame([(1, "u", "same", "c"), (2, None, "same", "c"), (None, "u", "same", "c"), (3, "u", None, "c"), (3, "u", None, "c"), (4, "u\nv", "", "c")], "page_id bigint, url string, html string, payload string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(warc.locate(warc.archive(pages))).collect())
    assert got == [(1, 4, "response", None), (2, 4, "revisit", 1), (3, 0, "response", None), (3, 0, "response", None), (4, 0, "revisit", 3)]
    assert warc.read_records(warc.locate(warc.archive(pages.where(F.col("page_id").isNull())))).count() == 0


def test_smallest_of_all_columns(spark):
    rows = spark.createDataFrame([(1, "b", {"x": "1"}), (1, "a", {"x": "2"})], "k int, t string, m map<string, string>")
    from treeline.llm._common import smallest

    one = rows.select(F.struct("*").alias("doc"), "k").groupBy("k").agg(smallest(rows, "doc").alias("doc")).first().doc
    assert (one.t, one.m) == ("a", {"x": "2"})
    assert np.array_equal([r.t for r in rows.drop("m").select(F.struct("*").alias("doc")).agg(smallest(rows.drop("m"), "doc").alias("d")).select("d.t").collect()], ["a"])
