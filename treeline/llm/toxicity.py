"""Toxicity from the nearest labelled examples by exact cosine of weighted terms, over a block-max inverted index.

Fitting sees a bounded sample of labelled rows (`most_examples`, those with the smallest hashes of their identifiers, at
most so many of each label; texts of one label that share the smallest hash of their three-word shingles, as copies do,
are one example, and labels are weighed by their shares of all labelled rows). Terms are words and the first 4, 5 and 6
letters of words; all terms of the examples are kept. A term weighs its IDF times FLOOR plus what its labels tell: the
log odds of toxic to clean examples less two standard errors, times the square of its purity (at most 1, which is
`purity` times as frequent in toxic examples, even with one more clean one). Examples and texts are unit vectors over
these and one constant term, which lets the amount of evidence count; words that no example has weigh nothing.

Examples are put in blocks of similar ones. Rare terms have postings, which are summed for all examples. Common terms, which
make up most of the work, have for each block the largest weight there and the examples' weights; a text's weights with
these largest ones and the block's largest sum of rare terms bound all cosines of the block. The blocks of the highest
bounds are computed first, and then those that can still hold one of the k nearest, as matrix products over some texts at
once. That is single precision; what is within its error of the kth is computed anew in double precision. The votes of the k nearest, weighted by nearness and smoothed by the base
rate, give the score; they are the evidence. Every text with words is searched; only texts without any have the smoothed
rate of such examples, and no evidence.

Nulls count as empty texts. A row repeated is scored each time. Labels
that are null are no examples; an identifier labelled twice counts as toxic if one label says so. Without any example
every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._common import give_back, materialise, no_cycles, one_thread, stretches, strings, table, trimmed, windows, word_hashes

_TRIM = ".,;:!?\"'()[]{}*%#|<>&/-_…«»“”¿¡"
_PREFIXES = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, which carry a closing mark to tell them from words."""
    core = word.strip(_TRIM)
    return [core, *(core[:n] + "*" for n in _PREFIXES if len(core) >= n)] if core else []


class Model(NamedTuple):
    terms: dict[str, int]
    #: What each term weighs.
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: What an example of label 0 or 1 counts for: the share of all labelled rows over that of the sample.
    weights: np.ndarray
    #: Example k has the terms own[at[k]:at[k + 1]] with the weights beside them.
    at: np.ndarray
    own: np.ndarray
    values: np.ndarray
    #: How many texts are searched at once.
    size: int
    empty: float
    base: float


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a unit vector; the last term is the constant one."""
    w = np.append((1 + np.log(counts)) * idf[terms], 1.0)
    return np.append(terms, len(idf)).astype(np.int64), w / math.sqrt(w @ w)


def weigh(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = sorted(counts)
    return unit(np.array(terms, np.int64), np.array([counts[t] for t in terms], np.float64), idf)


def index(examples: list[tuple[int, int, dict[int, int]]], terms: dict[str, int], idf: np.ndarray, weights: np.ndarray, size: int = 256) -> Model:
    """examples: identifier, label, counts of terms."""
    return indexed([(i, y, np.array(sorted(c), np.int64), np.array([c[t] for t in sorted(c)], np.float64)) for i, y, c in examples], terms, idf, weights, size)


def indexed(examples: list[tuple[int, int, np.ndarray, np.ndarray]], terms: dict[str, int], idf: np.ndarray, weights: np.ndarray, size: int = 256) -> Model:
    """examples: identifier, label, terms in order, their counts."""
    rate = lambda some, more, base: (sum(e[1] * weights[e[1]] for e in some) + base) / (sum(weights[e[1]] for e in some) + more)
    base = rate(examples, 1, 0.5) if examples else 0.0
    empty = rate([e for e in examples if not len(e[2])], 1, base) if examples else 0.0
    full = sorted((e for e in examples if len(e[2])), key=lambda e: e[0])
    vectors = [unit(t, c, idf) for _, _, t, c in full]
    at = np.cumsum([0, *(len(t) for t, _ in vectors)])
    own, values = (np.concatenate([v[k] for v in vectors]) if vectors else np.zeros(0) for k in (0, 1))
    return Model(terms, idf, np.array([e[0] for e in full], np.int64), np.array([e[1] for e in full], np.int64), weights, at, own.astype(np.int32), values.astype(np.float32), size, empty, base)


def _spans(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places low .. low + size - 1 of all spans, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(lows - np.cumsum(sizes) + sizes, sizes)


def alike(rows: np.ndarray, kinds: int, rounds: int = 3) -> np.ndarray:
    """Which of some kinds each row is of: a few rounds of nearest means."""
    means = rows[np.random.default_rng(0).choice(len(rows), min(kinds, len(rows)), replace=False)]
    for _ in range(rounds):
        of = (rows @ means.T - 0.5 * (means**2).sum(1)).argmax(1)
        means = np.stack([rows[of == k].mean(0) if (of == k).any() else means[k] for k in range(len(means))])
    return of


class Search:
    """The examples by term. A term that more than `common` of them have has a row of weights, in blocks of similar examples
    with the largest weight of each block; the others have postings."""

    ERROR = 2e-5  # more than single precision is off by, on unit vectors

    def __init__(self, m: Model, common: float = 0.05, block: int = 32, kinds: int = 64):
        self.m, n, size = m, len(m.ids), len(m.idf) + 1
        often = np.flatnonzero(np.bincount(m.own, minlength=size) > common * n)
        self.place = np.full(size, -1, np.int32)
        self.place[often] = np.arange(len(often))
        rows, place = np.repeat(np.arange(n, dtype=np.int32), np.diff(m.at)), self.place[m.own]
        dense = np.zeros((n, len(often)), np.float32)
        for lo in range(0, len(place), 1 << 18):  # in parts, as all indexes at once would take more than the matrix
            some = np.flatnonzero(place[lo : lo + (1 << 18)] >= 0) + lo
            dense[rows[some], place[some]] = m.values[some]
        self.back = np.argsort(alike(dense, kinds), kind="stable")  # the example at each place of the index
        at = np.empty(n, np.int32)
        at[self.back] = np.arange(n, dtype=np.int32)
        self.edges = np.minimum(np.arange(-(-n // block) + 1) * block, n)
        self.blocks = [np.ascontiguousarray(dense[self.back[lo:hi]].T) for lo, hi in itertools.pairwise(self.edges)]
        del dense
        self.top = np.stack([b.max(1) for b in self.blocks], 1)
        self.first = 1 + -(-64 // block)  # blocks that are computed whatever they are bound by
        order = np.flatnonzero(place < 0).astype(np.int32)
        del place
        order = order[np.argsort(m.own[order], kind="stable").astype(np.int32)]
        self.low = np.searchsorted(m.own[order], np.arange(size + 1))
        self.rows, self.values = at[rows[order]], m.values[order]
        self.query = np.zeros(size)
        self.computed = self.asked = 0

    def _add(self, scores: np.ndarray, often: np.ndarray, rare: np.ndarray, wanted: np.ndarray) -> None:
        """Sets the cosines of the wanted blocks, a row for each text."""
        for b in np.flatnonzero(wanted.any(0)).tolist():
            some, span = np.flatnonzero(wanted[:, b])[:, None], slice(self.edges[b], self.edges[b + 1])
            to = (some, np.arange(span.start, span.stop)[None, :])
            scores[to] = often[some[:, 0]] @ self.blocks[b] + rare[to]
        self.computed += int(wanted.sum())

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of texts (terms and weights of a unit vector) the places and cosines of the k nearest examples, ties to
        the smaller place."""
        m, n = self.m, len(self.m.ids)
        often, rare = np.zeros((len(texts), len(self.top)), np.float32), np.zeros((len(texts), n), np.float32)
        for i, (terms, w) in enumerate(texts):
            p = self.place[terms]
            often[i, p[p >= 0]] = w[p >= 0]
            terms, w = terms[p < 0], w[p < 0].astype(np.float32)
            sizes = self.low[terms + 1] - self.low[terms]
            at = _spans(self.low[terms], sizes)
            rare[i] = np.bincount(self.rows[at], self.values[at] * np.repeat(w, sizes), n)
        bounds = often @ self.top + np.maximum.reduceat(rare, self.edges[:-1], 1)
        self.asked += bounds.size
        scores = np.full((len(texts), n), -np.inf, np.float32)
        first, wanted = min(len(self.blocks), self.first), np.zeros(bounds.shape, bool)
        np.put_along_axis(wanted, np.argpartition(-bounds, first - 1, 1)[:, :first], True, 1)
        self._add(scores, often, rare, wanted)
        least = (np.partition(scores, n - k, 1)[:, n - k] if k < n else np.full(len(texts), -np.inf)) - self.ERROR
        self._add(scores, often, rare, (bounds >= least[:, None]) & ~wanted)
        for (terms, w), row, low in zip(texts, scores, least.tolist(), strict=True):
            some = np.flatnonzero(row >= low)
            found = row[some]
            if len(found) > k:
                some = some[found >= np.partition(found, len(found) - k)[len(found) - k] - self.ERROR]
            near = self.back[some]
            self.query[terms] = w
            sizes = m.at[near + 1] - m.at[near]
            at = _spans(m.at[near], sizes)
            exact = np.round(np.bincount(np.repeat(np.arange(len(near)), sizes), self.query[m.own[at]] * m.values[at], len(near)), 12)
            self.query[terms] = 0.0
            best = np.lexsort((near, -exact))[:k]
            yield near[best], exact[best]


def nearest(m: Model, counts: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k nearest examples, ties to the smaller place."""
    return next(Search(m).nearest([weigh(counts, m.idf)], k))


class _Words(dict):
    """A number for each word met so far; word k has the known terms flat[starts[k]:starts[k + 1]]. Terms are split by kind, so
    that a new word's are found in small tables."""

    def __init__(self, terms: dict[str, int]):
        kinds: dict[int, dict[str, int]] = {n: {} for n in (0, *_PREFIXES)}
        for t, k in terms.items():
            if t[-1] == "*":
                kinds[len(t) - 1][t[:-1]] = k
            else:
                kinds[0][t] = k
        self.whole, self.four, self.five, self.six = (kinds[n].get for n in (0, *_PREFIXES))
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.starts = array.array("i"), array.array("q", [0])

    def __missing__(self, word: str) -> int:
        core, own = word.strip(_TRIM), self.flat
        n = len(core)
        # an example with a longer beginning or the whole word has the shorter ones too
        known = n > 0
        if n >= 4:
            known = (t := self.four(core[:4])) is not None
            if known:
                own.append(t)
                if n >= 5:
                    known = (t := self.five(core[:5])) is not None
                    if known:
                        own.append(t)
                        if n >= 6:
                            known = (t := self.six(core[:6])) is not None
                            if known:
                                own.append(t)
        if known and (t := self.whole(core)) is not None:
            own.append(t)
        self[word] = k = len(self)
        self.starts.append(len(own))
        return k

    def terms(self, words: list[str]) -> np.ndarray:
        """The known terms of all words, as often as the words come."""
        k = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        starts = np.frombuffer(self.starts, np.int64)
        lows = starts[k]
        at = _spans(lows, starts[k + 1] - lows)
        return np.frombuffer(self.flat, np.int32)[at] if len(at) else np.zeros(0, np.int32)


class Scorer:
    def __init__(self, model: Model, k: int, most: int = 200_000):
        self.model, self.k, self.most = model, k, most
        self.search = Search(model) if len(model.ids) else None
        self.words = _Words(model.terms)
        self.known: dict[bytes, tuple[float, list[int]]] = {}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text in order, and how often it has each."""
        if len(self.words) > self.most:
            self.words.clear()
        terms = self.words.terms(text.lower().split())
        terms.sort()
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        return terms[first], np.diff(first, append=len(terms))

    def score(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """The score of each text and the identifiers of its nearest examples."""
        out: list[tuple[float, list[int]]] = []
        for lo in range(0, len(texts), self.model.size):
            some = texts[lo : lo + self.model.size]
            keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() if self.search and t.split(None, 1) else None for t in some]
            if len(self.known) >= 20_000:
                self.known.clear()
            new = {key: t for key, t in zip(keys, some, strict=True) if key and key not in self.known}
            if new:
                self.known.update(zip(new, self.votes([unit(*self.counts(t), self.model.idf) for t in new.values()]), strict=True))
            out += [self.known[key] if key else (self.model.empty, []) for key in keys]
        return out

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[int]]]:
        m = self.model
        for at, near in self.search.nearest(texts, self.k):
            votes = m.weights[m.labels[at]] / (1.05 - near)
            yield float((votes @ m.labels[at] + m.base) / (votes.sum() + 1.0)), m.ids[at][:3].tolist()


#: The share of its IDF that a term has whatever its labels tell.
FLOOR = 0.01


def told(a: np.ndarray, b: np.ndarray, toxic: int, clean: int, purity: float) -> np.ndarray:
    """What it tells that a of the toxic and b of the clean examples have a term: 0 or more."""
    odds = np.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1)))
    pure = np.minimum((a / toxic) / (purity * (b + 1) / clean), 1.0)
    return np.maximum(odds - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), 0.0) * pure**2


def sketched(rows: DataFrame) -> DataFrame:
    """rows: id, text, y. Adds sketch, the smallest hash of a text's three-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = []
            for _, texts in stretches(batch.column(1)):
                h, at = word_hashes([t.lower() for t in texts])
                sketches += [int(windows(h[a:b], min(3, b - a)).min() >> np.uint64(1)) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketches, pa.int64())], names=["id", "text", "y", "sketch"])

    return rows.select("id", "text", "y").mapInArrow(trimmed(run), "id bigint, text string, y int, sketch bigint")


def fit(df: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_examples: int = 3000, purity: float = 20.0, seed: int = 5) -> Model:
    """Learns from rows of labels whose identifier passes `learn`, at most most_examples of each label."""
    rows = labels.where(learn(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    rows = rows.withColumn("at", F.xxhash64(F.lit(seed), id_col))
    whole = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = []
    for y, n in sorted(whole.items()):
        # half as many again as wanted lie below the limit, twenty standard deviations more than needed
        limit = min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, 1.5 * most_examples / n)))
        some.append(rows.where((F.col("y") == y) & (F.col("at") <= limit)).orderBy("at", id_col).limit(most_examples))
    rows = functools.reduce(DataFrame.unionByName, some, rows.limit(0)).select(F.col(id_col).cast("bigint").alias("id"), "y")
    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id")  # at most 2 * most_examples rows
    own = materialise(sketched(own).groupBy("sketch", "y").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id")).repartition(df.sparkSession.sparkContext.defaultParallelism, "id"), "examples")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, y = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own_terms = {t for w in set((text or "").lower().split()) for t in terms_of(w)}
                names += own_terms
                y += [label] * len(own_terms)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(y, pa.int32())], names=["term", "y"])

    sums = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = max(sums.get(1, 0), 1), max(sums.get(0, 0), 1)
    df_terms = own.select("text", "y").mapInArrow(trimmed(found), "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    weights = np.array([whole.get(y, 0) / max(sums.get(y, 0), 1) for y in (0, 1)])
    weights = weights / (weights.max() or 1.0)
    found_terms = df_terms.orderBy("term").toArrow()
    terms = {t.as_py(): k for k, t in enumerate(found_terms["term"])}
    a, b = (found_terms[x].to_numpy().astype(np.float64) for x in "ab")
    del found_terms
    idf = (np.log((1 + toxic + clean) / (1 + a + b)) + 1) * (FLOOR + told(a, b, toxic, clean, purity))
    scorer = Scorer(Model(terms, idf, *[np.zeros(0, np.int64)] * 6, 1, 0.0, 0.0), 1)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [scorer.counts(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([x[k].astype(np.int32) for x in counts], pa.list_(pa.int32())) for k in (0, 1))], names=["id", "y", "t", "c"])

    examples = own.select("id", "text", "y").mapInArrow(trimmed(vectors), "id bigint, y int, t array<int>, c array<int>").toArrow()
    columns = [examples["id"].to_pylist(), examples["y"].to_pylist(), *([x.values.to_numpy() for x in examples[k]] for k in "tc")]
    return indexed(list(zip(*columns, strict=True)), terms, idf, weights)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", k: int = 15) -> DataFrame:
    """id_col, score and evidence (identifiers of the nearest examples) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most twice most_examples vectors
    del model
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        scorer = Scorer(shared.value, k)
        for batch in batches:
            for lo, some in stretches(batch.column(1), read=strings):
                with no_cycles():
                    out = scorer.score(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)).cast(pa.int64()), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], names=[id_col, "score", "evidence"])

    return df.select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` bigint, score double, evidence array<bigint>")


THRESHOLD = 0.3


def held_out(x: Column) -> Column:
    return F.crc32(x.cast("string").cast("binary")) % 4 == 2


def model_of(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> Model:
    return fit(table(spark, sf_dir, "documents") if documents is None else documents, table(spark, sf_dir, "labels"), lambda x: ~held_out(x))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = score(documents, model_of(spark, sf_dir, documents))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.array_join("evidence", ",").alias("evidence"))
