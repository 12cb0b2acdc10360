"""Language of texts, by spans: scripts narrow the candidates, word scores and a Viterbi path label the words.

Fitting sees a bounded sample of texts with a known language, at most `most_texts` of each, those with the smallest hashes
of their identifiers. A word's score for a language is the log probability of its letter trigrams there, per word, cut
off below; candidates are the languages that use the word's script. A path through the languages pays `penalty` for each
switch; the best one labels spans of mixed text. The language with the most letters in its spans is that of the text, and
the score its share of all letters.

Where one language leads so that no stretch favours another by more than half the penalty, the path is constant; other
texts are solved by the full recursion. Null texts and texts without a letter are `und` with score 0. Letters of a script
that no language was seen in leave all languages as candidates; a language with under 1 % of its words in a script is no
candidate for it. Rows repeated give a row each. Ties go to the language first in order. Without any
example every text is `und`.
"""

from __future__ import annotations

import functools
import itertools
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._common import materialise, stretches, strings, table, trimmed

#: Where the blocks of scripts begin in Unicode, in order; what lies between is common.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_FROM = [a for a, _ in SCRIPTS]


def script(word: str) -> str:
    """The script of a word's first letter."""
    c = next((c for c in word if c.isalpha()), None)
    return SCRIPTS[max(0, bisect_right(_FROM, ord(c)) - 1)][1] if c else "none"


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def letters(token: str) -> str:
    """A token's letters in lower case, without the marks around and between."""
    return token.lower() if token.isalpha() else "".join(c for c in token.lower() if c.isalpha())


class Model(NamedTuple):
    langs: list[str]
    #: The row of each trigram in scores; row 0 is that of all others.
    grams: dict[str, int]
    scores: np.ndarray
    scripts: dict[str, frozenset[int]]


class _Grams(dict):
    def __missing__(self, gram: str) -> int:
        return 0


class Labeller:
    """Spans of one text. Word scores are rows of a table, remembered by token; those of a text's new words are computed
    together."""

    def __init__(self, model: Model, penalty: float = 8.0, cut: float = 6.0, most: int = 200_000):
        self.model, self.penalty, self.cut, self.most = model, penalty, cut, most
        n = len(model.langs)
        self.grams = _Grams(model.grams)
        every = np.ones(n, bool)
        self.allowed = {s: np.isin(np.arange(n), list(some)) if some else every for s, some in model.scripts.items()}
        self.every = every
        self._forget()

    def _forget(self) -> None:
        n = len(self.model.langs)
        self.rows: dict[str, int] = {"": 0}
        self.words: dict[str, int] = {"": 0}
        self.scores = np.zeros((1024, n), np.float64)
        self.sizes = np.zeros(1024, np.int64)

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words by language, the best one 0 and none below -cut."""
        grams = list(map(trigrams, words))
        rows = np.fromiter(map(self.grams.__getitem__, itertools.chain.from_iterable(grams)), np.int64)
        starts = np.cumsum([0, *map(len, grams[:-1])])
        total = np.add.reduceat(self.model.scores[rows], starts, 0)
        allowed = np.stack([self.allowed.get(script(w), self.every) for w in words])
        total[~allowed] = -np.inf
        return np.maximum(total - total.max(1, keepdims=True), -self.cut)

    def _add(self, tokens: list[str]) -> None:
        tokens = list(dict.fromkeys(tokens))
        words = list(map(letters, tokens))
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if new:
            at = len(self.words)
            while at + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            if self.model.langs:
                self.scores[at : at + len(new)] = self.score(new)
            self.sizes[at : at + len(new)] = list(map(len, new))
            self.words.update(zip(new, range(at, at + len(new)), strict=True))
        self.rows.update(zip(tokens, map(self.words.__getitem__, words), strict=True))

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best labels for rows of scores."""
        total = s.sum(0)
        lead = int(total.argmax())
        sums = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s - s[:, lead : lead + 1], 0)])
        if (sums - np.minimum.accumulate(sums, 0)).max() <= self.penalty / 2:
            return np.full(len(s), lead, np.int64)
        n, back, v = s.shape[1], [], s[0].tolist()
        for row in s[1:].tolist():
            top = max(v)
            switch, frm = top - self.penalty, v.index(top)
            back.append([k if v[k] >= switch else frm for k in range(n)])
            v = [row[k] + (v[k] if v[k] >= switch else switch) for k in range(n)]
        out = [v.index(max(v))]
        for b in reversed(back):
            out.append(b[out[-1]])
        return np.array(out[::-1])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the words that have letters, and their numbers of letters."""
        if len(self.rows) > self.most:
            self._forget()
        tokens = text.split()
        get = self.rows.get
        at = list(map(get, tokens))
        if None in at:
            self._add([t for t, r in zip(tokens, at, strict=True) if r is None])
            at = list(map(get, tokens))
        rows = np.array(at, np.int64)
        rows = rows[rows > 0]
        if not len(rows) or not self.model.langs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.path(self.scores[rows]), self.sizes[rows]

    def label(self, text: str) -> tuple[str, float, list[tuple[str, int]]]:
        """The language, its share of letters, and spans as (language, words)."""
        path, sizes = self.spans(text)
        if not len(path):
            return "und", 0.0, []
        share = np.bincount(path, sizes, len(self.model.langs))
        lead = int(share.argmax())
        cuts = np.flatnonzero(np.diff(path)) + 1
        spans = [(self.model.langs[path[a]], int(b - a)) for a, b in zip([0, *cuts], [*cuts, len(path)], strict=True)]
        return self.model.langs[lead], float(share[lead] / share.sum()), spans


def fit(df: DataFrame, learn: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_texts: int = 1500, seed: int = 3) -> Model:
    """Learns from rows whose identifier passes `learn` and whose language is known, at most most_texts of each."""
    rows = df.where(learn(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("at", F.xxhash64(F.lit(seed), "id"))
    some = []
    for x, n in sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()):
        # half as many again as wanted lie below the limit, far more standard deviations than needed
        limit = min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, 1.5 * most_texts / n)))
        some.append(rows.where((F.col("lang") == x) & (F.col("at") <= limit)).orderBy("at", "id").limit(most_texts))
    rows = F.broadcast(functools.reduce(DataFrame.unionByName, some, rows.limit(0)).select("id", "lang").dropDuplicates(["id"]))  # at most most_texts of each language
    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(rows, "id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, langs, times = [], [], []
            sums: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for token in (text or "").split():
                    word = letters(token)
                    if word:
                        sums[lang, "=" + script(word)] = sums.get((lang, "=" + script(word)), 0) + 1
                        for g in trigrams(word):
                            sums[lang, g] = sums.get((lang, g), 0) + 1
            for (lang, g), n in sums.items():
                names.append(g)
                langs.append(lang)
                times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(langs, pa.string()), pa.array(times, pa.int64())], names=["gram", "lang", "n"])

    sums = materialise(own.select("text", "lang").mapInArrow(trimmed(found), "gram string, lang string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    langs = [r.lang for r in sums.select("lang").distinct().orderBy("lang").collect()]
    at = {x: k for k, x in enumerate(langs)}
    scripts: dict[str, list[float]] = {}
    for r in sums.where("gram like '=%'").collect():  # a row for each language and script
        scripts.setdefault(r.gram[1:], [0.0] * len(langs))[at[r.lang]] = r.n
    whole = [sum(v[k] for v in scripts.values()) or 1 for k in range(len(langs))]
    totals = {r.lang: (r.n, r.k) for r in sums.where("gram not like '=%'").groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    floor = [math.log(0.1 / (totals.get(x, (0, 0))[0] + 0.1 * (totals.get(x, (0, 0))[1] + 1))) for x in langs]
    found_grams = sums.where("gram not like '=%'").toArrow()  # of the texts of a bounded sample
    names, of, times = (found_grams[c].to_pylist() for c in ("gram", "lang", "n"))
    grams = {g: k for k, g in enumerate(sorted(set(names)), 1)}
    scores = np.tile(np.array(floor), (len(grams) + 1, 1))
    for g, x, n in zip(names, of, times, strict=True):
        scores[grams[g], at[x]] = math.log((n + 0.1) / (totals[x][0] + 0.1 * (totals[x][1] + 1)))
    return Model(langs, grams, scores, {s: frozenset(k for k in range(len(langs)) if v[k] / whole[k] >= 0.01) for s, v in scripts.items()})


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0) -> DataFrame:
    """id_col, lang_pred, score and spans (language and number of words) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # trigrams of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        for batch in batches:
            for lo, some in stretches(batch.column(1), read=strings):
                out = list(map(labeller.label, some))
                spans = pa.array([[{"lang": a, "words": n} for a, n in x[2]] for x in out], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)).cast(pa.int64()), pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), spans], names=[id_col, "lang_pred", "score", "spans"])

    return df.select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` bigint, lang_pred string, score double, spans array<struct<lang: string, words: bigint>>")


def held_out(x: Column) -> Column:
    return F.crc32(x.cast("string").cast("binary")) % 3 == 1


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = identify(documents, fit(documents, lambda x: ~held_out(x)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
