"""Runs of words that repeat with a period, from the branching tandem repeats of a suffix tree.

A run is a stretch of words with smallest period q, at least max(6, 4 * q) words long, that no neighbouring word extends
keeping the period. Every run of three words inside a run comes at least three times in it. So of a stretch of text only
the parts whose runs of three words come three times there can hold runs; that is asked again of the parts, until nothing
more goes. It keeps every run whole, whatever the text.

The parts of all documents of a stretch of an Arrow batch become one string of numbers with a different mark after each.
Prefix doubling orders its suffixes, and the common prefixes of neighbours give the suffix tree: a node is a span of the
order and a depth. As in Stoye and Gusfield's method, at a node of depth d the leaves but those of its largest child are
asked whether the suffix d words before or after is below the node too; there are O(n log n) such questions. Those after
which the period breaks are the branching tandem repeats, one for each run and period; each is rotated to the left as far as
the period goes (by the names that doubling gave to equal stretches), and repeats that reach the same ends are one run, of
the smallest of their periods.

Nulls count as empty texts, which have no words and no run. Rows without an identifier are no documents and are left out;
rows repeated give a row each. An empty table gives an empty result. Columns besides the id and the text are ignored.
Memory is bounded by a stretch of texts or the longest text: 4 bytes for each word of the parts and doubling.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._common import mix, stretches, table, trimmed, word_hashes


def _spans(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places low .. low + size - 1 of all spans, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(lows - np.cumsum(sizes) + sizes, sizes)


def _three(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where three words of one part begin, and the hashes of these words and the part."""
    at = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    return at, mix(mix(mix(h[at] + of[at].astype(np.uint64)) + h[at + 1]) + h[at + 2])


def parts(h: np.ndarray, at: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """First words and sizes of the parts that may hold runs. h: the words' hashes, at: where the documents begin, and the
    end. Equal hashes of different words would only keep more."""
    low, size = at[:-1], np.diff(at)
    for k in range(rounds):
        where, of = _spans(low, size), np.repeat(np.arange(len(low)), size)
        first, keys = _three(h[where], of)
        if k == 0:  # shared counters can only be too high
            few = 1 << max(10, int(len(keys)).bit_length() + 2)
            slots = (keys & np.uint64(few - 1)).astype(np.int64)
            often = np.bincount(slots, minlength=few)[slots] >= 3
        else:
            _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
            often = counts[back] >= 3
        if k > 1 and often.all():
            break
        first = first[often]
        begins = np.flatnonzero(np.diff(first, prepend=-2) != 1) if len(first) else np.zeros(0, np.int64)
        # firsts that follow each other across two parts are told apart by their parts
        begins = np.union1d(begins, np.flatnonzero(np.diff(of[first], prepend=-1))) if len(first) else begins
        size = np.diff(begins, append=len(first)) + 2
        low = where[first[begins]]
        low, size = low[size >= 6], size[size >= 6]
    return low, size


class SuffixTree:
    """The suffix tree of a string of numbers in which no suffix begins another (as a last number of its own ensures).
    names[k][i] is equal for equal stretches of 2 ** k numbers from i."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = text
        name = np.unique(text, return_inverse=True)[1]
        self.names = [name.astype(np.int32)]
        while n and int(name.max()) < n - 1:
            step = 1 << (len(self.names) - 1)
            key = name.astype(np.int64) * (n + 1)
            key[: n - step] += name[step:] + 1
            name = np.unique(key, return_inverse=True)[1]
            self.names.append(name.astype(np.int32))
        self.place = self.names[-1]
        self.suffix = np.empty(n, np.int64)
        self.suffix[self.place] = np.arange(n)
        self.common = self._common()

    def _common(self) -> np.ndarray:
        """How many numbers each suffix in order shares with the one before."""
        a, b, out = self.suffix[1:].copy(), self.suffix[:-1].copy(), np.zeros(max(len(self.suffix) - 1, 0), np.int64)
        n = len(self.text)
        for k in range(len(self.names) - 2, -1, -1):
            name = self.names[k]
            same = np.flatnonzero((a < n) & (b < n))
            same = same[name[a[same]] == name[b[same]]]
            for x in (a, b, out):
                x[same] += 1 << k
        return out

    def nodes(self, most: int) -> tuple[np.ndarray, ...]:
        """Of the inner nodes of depth 1 to `most`: first and last place of their leaves, depth, and first and last place of
        the leaves of their largest child."""
        out: list[tuple[int, int, int, int, int]] = []
        stack = [[0, 0, 0, -1]]  # depth, first leaf, largest child
        for place, depth in enumerate([*self.common.tolist(), 0], 1):
            low, last = place - 1, place - 1
            child = (low, last)
            while stack[-1][0] > depth:
                d, low, big, end = stack.pop()
                if end - big < child[1] - child[0]:
                    big, end = child
                if d <= most:
                    out.append((low, last, d, big, end))
                child = (low, last)
            top = stack[-1]
            if top[0] < depth:
                stack.append([depth, child[0], *child])
            elif top[3] - top[2] < child[1] - child[0]:
                top[2:] = child
        columns = np.array(out, np.int64).reshape(-1, 5).T
        return tuple(columns)

    def repeats(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and periods, up to `most`, of all branching tandem repeats."""
        low, last, depth, big, end = self.nodes(most)
        starts, periods = [], []
        for first, size in ((low, big - low), (end + 1, last - end)):
            node = np.repeat(np.arange(len(low)), size)
            leaf, d = self.suffix[_spans(first, size)], depth[node]
            for at, other in ((leaf, leaf + d), (leaf - d, leaf - d)):
                ok = np.flatnonzero((other >= 0) & (other < len(self.text)))
                place = self.place[other[ok]]
                ok = ok[(place >= low[node[ok]]) & (place <= last[node[ok]])]
                at_, d_ = at[ok], d[ok]
                breaks = self.text[at_ + d_] != self.text[at_ + 2 * d_]
                starts.append(at_[breaks])
                periods.append(d_[breaks])
        both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], 1), axis=0) if starts else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of so many numbers from a and from b are equal."""
        out, level = np.zeros(len(a), bool), np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            if k < len(self.names) - 1:  # no longer ones are equal
                some, name = np.flatnonzero(level == k), self.names[k]
                x, y, rest = a[some], b[some], size[some] - (1 << k)
                out[some] = (name[x] == name[y]) & (name[x + rest] == name[y + rest])
        return out

    def runs(self, times: int = 4, least: int = 6, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First, end and smallest period of all runs of at least `least` numbers and `times` periods, by their end.
        longest: no run is longer."""
        i, d = self.repeats((len(self.text) if longest is None else longest) // times)
        end = i + 2 * d
        ok = end - times * d >= 0
        i, d, end = i[ok], d[ok], end[ok]
        ok = self.same(end - times * d, end - (times - 1) * d, (times - 1) * d) if len(d) else ok[ok]
        i, d, end = i[ok], d[ok], end[ok]
        first = end - times * d
        for k in range(len(self.names) - 2, -1, -1):  # rotated to the left
            to, name = first - (1 << k), self.names[k]
            some = np.flatnonzero(to >= 0)
            some = some[name[to[some]] == name[to[some] + d[some]]]
            first[some] = to[some]
        order = np.lexsort((d, first, end))
        first, end, d = first[order], end[order], d[order]
        new = np.ones(len(d), bool)
        new[1:] = (np.diff(first) != 0) | (np.diff(end) != 0)
        new &= end - first >= least
        return first[new], end[new], d[new]


def runs_of(words: list[list], keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word, length and period of all runs, by document, first word and period. words: of each document;
    keys: a number for each word of all documents, equal for equal ones; at: where documents begin in keys, and the end."""
    low, size = parts(keys, at)
    if not len(low):
        return (np.zeros(0, np.int64),) * 4
    doc = np.searchsorted(at, low, "right") - 1
    number: dict = {}
    text = np.empty(int(size.sum()) + len(size), np.int64)
    begins = np.cumsum(size + 1) - size - 1
    for k, (d, lo, n, to) in enumerate(zip(doc.tolist(), (low - at[doc]).tolist(), size.tolist(), begins.tolist(), strict=True)):
        text[to : to + n] = [number.setdefault(w, len(number)) for w in words[d][lo : lo + n]]
        text[to + n] = -1 - k
    first, end, period = SuffixTree(text).runs(longest=int(size.max()))
    part = np.searchsorted(begins, first, "right") - 1
    out = doc[part], first - begins[part] + low[part] - at[doc[part]], end - first, period
    order = np.lexsort((out[3], out[1], out[0]))
    return tuple(x[order] for x in out)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: What a document's words are taken for: None, or (first, period): from `first` on they repeat with that period.
Rewrite = Callable[[int, int], tuple[int, int] | None]


class Found:
    """One text's runs: how many, the one of the greatest exponent, digests of all and of the words that are kept."""

    def __init__(self, words: list[bytes], first: np.ndarray, length: np.ndarray, period: np.ndarray):
        rows = list(zip(first.tolist(), length.tolist(), period.tolist(), strict=True))
        self.rows = rows
        self.best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        if rows:
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, first + period, 1)
            np.add.at(change, first + length, -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        self.kept = b" ".join(words)


_OUT = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def find_runs(texts: list[bytes], rewrites: list[tuple[int, int] | None]) -> list[Found]:
    split = [t.split() for t in texts]
    keys, at = word_hashes(texts)
    for k, change in enumerate(rewrites):
        if change and split[k]:
            first, period = change
            source = np.arange(len(split[k]))
            source[first:] = first + (source[first:] - first) % period
            keys[at[k] : at[k + 1]] = keys[at[k] : at[k + 1]][source]
            split[k] = [split[k][j] for j in source.tolist()]
    doc, first, length, period = runs_of(split, keys, at)
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [Found(w, first[lo:hi], length[lo:hi], period[lo:hi]) for w, lo, hi in zip(split, edge[:-1], edge[1:], strict=True)]


def periodic_runs(df: DataFrame, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text", runs: bool = False, text: bool = False) -> DataFrame:
    """A row for each document: n_runs, its run of the greatest exponent, digests of its runs and of the text without the
    repeated words; on request runs (start, length, period) and that text. One pass without a shuffle. rewrite(identifier,
    number of words) says which words to take for others."""
    schema = f"`{id_col}` bigint, {_OUT}" + ", runs array<struct<start: bigint, length: bigint, period: bigint>>" * runs + ", collapsed binary" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, texts in stretches(batch.column(1)):
                own = ids.slice(lo, len(texts))
                found = find_runs(texts, [rewrite(i, len(t.split())) if rewrite else None for i, t in zip(own.to_pylist(), texts, strict=True)])
                best = [(*f.best, 1000 * f.best[1] // f.best[2]) if f.best else (None,) * 4 for f in found]
                columns = [own, pa.array([len(f.rows) for f in found], pa.int64()), *(pa.array([b[k] for b in best], pa.int64()) for k in range(4))]
                columns += [pa.array([_digest("".join(f"{s},{n},{q}\n" for s, n, q in f.rows).encode()) for f in found], pa.string()), pa.array([_digest(f.kept) for f in found], pa.string())]
                names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
                if runs:
                    names.append("runs")
                    columns.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f.rows] for f in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))))
                if text:
                    names.append("collapsed")
                    columns.append(pa.array([f.kept for f in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(trimmed(run), schema)


def planted(doc_id: int, n: int) -> tuple[int, int] | None:
    """The contract's rewriting: a tenth of the documents repeat from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted)
