"""Substring dedup by level-wise doubling: words covered by a window that occurs elsewhere are removed.

Windows of a quarter of the wanted length come first, only at anchors: in every stretch as long as the wanted window, the
quarter with the smallest hash. Equal stretches have equal anchors, so no repeat is missed. Anchors whose hash occurs once
are dropped; the others are extended to twice their length, to the right and to the left, and those that occur once are
dropped again; what is left is extended to the wanted length, at every start that holds such a half. Windows found twice
at this last level decide. Hashes of a level are made of two of the level before. Words have two 64-bit hashes, halves of
128 bits of XXH3; the last level is made from both apart and compares 96 bits (128 within a unit), so two windows among
10**13 that differ are taken for equal with probability below 0.001.

Counting is a partial aggregation by hash, and decisions come back by a join on the hash, in which frequent ones are
broadcast, so that their rows are not dealt to one task. At the last level documents with candidates are packed into units
of some megabytes; a unit gives each of its windows once, so a window in a third of all documents is no more rows than
units, and rows in order of the hash are streamed past each other. The unit gets the places of its repeated windows back.

Words are runs of anything but space and \\x09-\\x0D, unchanged; null has none. Each row is a document: rows repeated with
the same identifier, with equal texts or others, count as occurrences of each other's windows, and each gets its result. Rows without an identifier are no documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._common import discard, lookup, materialise, mix, release, stretches, table, trimmed, windows, word_hashes

_C = [np.uint64(c) for c in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def pair_up(h: np.ndarray, step: int, kind: int = 0) -> np.ndarray:
    """Hashes of windows that begin and end as h[i] and h[i + step] say."""
    if len(h) <= step:
        return np.zeros(0, np.uint64)
    return np.maximum(mix(mix(h[: len(h) - step] * _C[kind]) ^ (h[step:] * _C[kind + 1])), np.uint64(1))


class Levels:
    def __init__(self, length: int):
        if length < 4:
            raise ValueError("windows have four words at least")
        self.length, self.half, self.quarter = length, -(-length // 2), -(-length // 4)

    def quarters(self, h: np.ndarray, seed: int = 0) -> np.ndarray:
        return windows(h, self.quarter, seed)

    def halves(self, quarters: np.ndarray, kind: int = 0) -> np.ndarray:
        return pair_up(quarters, self.half - self.quarter, kind)

    def wholes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each whole window; h: both hashes of each word."""
        return tuple(pair_up(self.halves(self.quarters(h[k // 2], k), k), self.length - self.half, k) for k in (0, 2))

    def anchors(self, quarters: np.ndarray, n: int) -> np.ndarray:
        """Where anchors of a document of n words begin."""
        reach = self.length - self.quarter + 1
        if n < self.length:
            return np.zeros(0, np.int64)
        least = np.lib.stride_tricks.sliding_window_view(quarters[: n - self.quarter + 1], reach).argmin(1)
        return np.unique(least + np.arange(len(least)))

    def starts(self, places: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
        """Starts of windows that hold the half at an anchor, for a document of n words."""
        change = np.zeros(n + 2, np.int64)
        low = np.where(right, places - (self.length - self.half), places - (self.length - self.quarter))
        high = np.where(right, places, places - (self.half - self.quarter))
        np.add.at(change, np.clip(low, 0, n), 1)
        np.add.at(change, np.clip(high + 1, 0, n), -1)
        return np.flatnonzero(np.cumsum(change)[: max(0, n - self.length + 1)] > 0)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *[p.view(np.int64) for p in parts]])))


def _scan(df: DataFrame, id_col: str, text_col: str, levels: Levels) -> DataFrame:
    """For each text: id, n, sha of its words joined by one space, and its anchors: place, hashes of the quarter there and
    of the halves to the right and to the left (0: beyond the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in stretches(batch.column(1)):
                h, at = word_hashes(texts)
                q = levels.quarters(h)
                half = levels.halves(q)
                back = levels.half - levels.quarter
                parts: list[list[np.ndarray]] = [[], [], [], []]
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = b - a
                    p = levels.anchors(q[a:], n)
                    right, left = p + levels.half <= n, p >= back
                    parts[0].append(p)
                    parts[1].append(q[a + p])
                    for k, ok, shift in ((2, right, 0), (3, left, -back)):
                        x = np.zeros(len(p), np.uint64)
                        x[ok] = half[a + p[ok] + shift]
                        parts[k].append(x)
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)).cast(pa.int64()), pa.array(np.diff(at)), pa.array(sha), *map(_lists, parts)], names=["id", "n", "sha", "place", "q", "r", "l"])

    return df.select(id_col, text_col).mapInArrow(trimmed(run), "id bigint, n bigint, sha string, place array<bigint>, q array<bigint>, r array<bigint>, l array<bigint>")


def _twice(rows: DataFrame, key: str) -> DataFrame:
    """Those of rows whose key another row has too."""
    times = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "times")
    return lookup(rows, times, [key], "times").drop("times")


def _units(texts: DataFrame, most: int = 1 << 21) -> DataFrame:
    """Packs texts (id, text, places, rights) into rows of about `most` bytes, each with a number of its own. Written at
    once, so the numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            while lo < batch.num_rows:
                hi, size = lo + 1, sizes[lo]
                while hi < batch.num_rows and size + sizes[hi] <= most:
                    size, hi = size + sizes[hi], hi + 1
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), *(pa.array([some.column(k).to_pylist()], pa.list_(some.column(k).type)) for k in range(4))], names=["unit", "ids", "texts", "places", "rights"])
                lo = hi

    return texts.select("id", "text", "places", "rights").mapInArrow(trimmed(run), "unit bigint, ids array<bigint>, texts array<string>, places array<array<bigint>>, rights array<array<boolean>>")


def _candidates(levels: Levels, texts: list[bytes], places: list, rights: list):
    """Of a unit: offsets of its documents, starts of candidate windows, their distinct hashes, and for each start the place
    of its hash among these."""
    h, at = word_hashes(texts, both=True)
    w, w2 = levels.wholes(h)
    starts = [a + levels.starts(np.array(p, np.int64), np.array(r, bool), b - a) for a, b, p, r in zip(at[:-1].tolist(), at[1:].tolist(), places, rights, strict=True)]
    starts = np.concatenate([np.zeros(0, np.int64), *starts])
    w, w2 = w[starts], w2[starts]
    order = np.lexsort((w2, w))
    new = np.concatenate([[True], (w[order][1:] != w[order][:-1]) | (w2[order][1:] != w2[order][:-1])])[: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    first = order[new]
    return at, starts, w[first].view(np.int64), w2[first].astype(np.uint32).view(np.int32), np.bincount(place, minlength=len(first)) > 1, place


def _asked(units: DataFrame, levels: Levels) -> DataFrame:
    """unit, k, h, h2, again: the distinct candidate windows of each unit, and whether one occurs twice there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, h, h2, again, _ = _candidates(levels, [(t or "").encode() for t in row["texts"]], row["places"], row["rights"])
                for lo in range(0, len(h), 1 << 16):
                    n = len(h[lo : lo + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["unit"])), pa.array(np.arange(lo, lo + n, dtype=np.int32)), pa.array(h[lo : lo + n]), pa.array(h2[lo : lo + n]), pa.array(again[lo : lo + n])], names=["unit", "k", "h", "h2", "again"])

    return units.select("unit", "texts", "places", "rights").mapInArrow(trimmed(run), "unit bigint, k int, h bigint, h2 int, again boolean")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of h and h2. unit and k of those that have an equal neighbour or occur again; holds a batch."""
    held = None
    like = False  # whether the held row is like the one before it

    def out(cols: dict, hit: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols["unit"][hit]), pa.array(cols["k"][hit])], names=["unit", "k"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "k", "h", "h2", "again")}
        if held is not None:
            cols = {c: np.concatenate([held[c], v]) for c, v in cols.items()}
        same = (cols["h"][1:] == cols["h"][:-1]) & (cols["h2"][1:] == cols["h2"][:-1])
        hit = cols["again"] | np.concatenate([[like], same]) | np.concatenate([same, [False]])
        held, like = {c: v[-1:] for c, v in cols.items()}, bool(same[-1]) if len(same) else like
        hit[-1] = False
        yield out(cols, hit)
    if held is not None:
        yield out(held, held["again"] | like)


def _remove(units: DataFrame, levels: Levels, with_text: bool) -> DataFrame:
    """units with found (places of repeated windows): id, sha (of all words), n_removed, kept_sha256 and on request the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = [(t or "").encode() for t in row["texts"]]
                at, starts, h, _, _, place = _candidates(levels, texts, row["places"], row["rights"])
                hit = np.zeros(len(h), bool)
                hit[row["found"]] = True
                starts = starts[hit[place]]
                change = np.zeros(at[-1] + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + levels.length, -1)
                keep = np.cumsum(change)[: at[-1]] == 0
                removed, was, sha, kept_text = [], [], [], []
                for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    words = t.split()
                    kept = b" ".join([words[i] for i in np.flatnonzero(keep[a:b]).tolist()])
                    was.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    removed.append(b - a - int(keep[a:b].sum()))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(was, pa.string()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], names=["id", "sha", "n_removed", "kept_sha256", "kept"])

    return units.select("unit", "ids", "texts", "places", "rights", "found").mapInArrow(trimmed(run), "id bigint, sha string, n_removed bigint, kept_sha256 string, kept string")


def substring_dedup(df: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each row of df: id_col, n_words, n_removed, kept_sha256; with_text: kept, the text that is left where
    words were removed (else null)."""
    levels, spark, df = Levels(length), df.sparkSession, df.where(F.col(id_col).isNotNull())
    anchors = materialise(_scan(df, id_col, text_col, levels), "anchors")
    scan = materialise(anchors.select("id", "n", "sha"), "texts")
    # level 1: quarters at anchors
    rows = anchors.select("id", F.explode(F.arrays_zip("place", "q", "r", "l")).alias("x")).select("id", "x.*")
    rows = _twice(rows, "q").select("id", "place", F.explode(F.array(F.struct(F.lit(True).alias("right"), F.col("r").alias("h")), F.struct(F.lit(False).alias("right"), F.col("l").alias("h")))).alias("x"))
    rows = materialise(rows.select("id", "place", "x.*").where("h <> 0"), "halves")
    discard(anchors)
    release(spark)
    # level 2: halves
    live = _twice(rows, "h").groupBy("id").agg(F.collect_set(F.struct("place", "right")).alias("x")).select("id", F.col("x.place").alias("places"), F.col("x.right").alias("rights"))
    units = materialise(_units(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(live, "id")), "units")
    discard(rows)
    release(spark)
    # level 3: whole windows
    found = _asked(units, levels).repartition("h").sortWithinPartitions("h", "h2").mapInArrow(_repeated, "unit bigint, k int")
    found = materialise(found.groupBy("unit").agg(F.collect_list("k").alias("found")), "found")
    release(spark)
    out = materialise(_remove(units.join(found, "unit"), levels, with_text).dropDuplicates(["id", "sha"]), "removed")
    discard(units)
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return scan.select("id", "n", "sha").join(out, ["id", "sha"], "left").select(*cols, *(["kept"] if with_text else []))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), 35)


SQL = {
    "op10_substring_dedup": """
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
p as (select r, i, sha256(array_to_string(ws[i:i + 34], ' ')) as h
  from (select r, ws, unnest(generate_series(1, len(ws) - 34)) as i from w where len(ws) >= 35)),
twice as (select r, i from p where h in (select h from p group by h having count(*) > 1)),
gone as (select distinct r, j from (select r, unnest(generate_series(i, i + 34)) as j from twice)),
words as (select r, unnest(generate_series(1, len(ws))) as j, unnest(ws) as word from w),
kept as (select words.r, count(*) as n, string_agg(word, ' ' order by j) as t from words anti join gone using (r, j) group by 1)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join kept using (r)"""
}
