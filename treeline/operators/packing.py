"""Next-fit packing of ordered rows, one key's rows spread over all tasks.

Rows are put in order over all partitions and written as a checkpoint. In a partition the start of the next batch is found
for every row by binary search in prefix sums. A key whose rows lie in several partitions is a chain of segments: for each
place at which a batch carried into a segment may break, the segment tells what is open at its end, by pointer doubling.
These summaries are composed in order, and then every partition follows its batches from what was open at its begin."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.sources.commits import shared_folder

# Most hashes and bytes of a fetch.
FETCH_HASHES, FETCH_BYTES = 128, 32 << 20

_SUMMARY = "ws bigint, part int, at bigint, before bigint, hashes bigint, bytes bigint, breaks bigint, open_hashes bigint, open_bytes bigint, all_hashes bigint, all_bytes bigint"


class Places:
    """A partition's rows in order, with caps: prefix sums, the ends of the keys' segments, the starts of next batches."""

    def __init__(self, frames: Iterator[pd.DataFrame], most_hashes: int, most_bytes: int):
        whole = list(frames)
        self.ws, size, new, part = (np.concatenate([np.zeros(0, np.int64), *(f[c].to_numpy(np.int64) for f in whole)]) for c in ("ws", "size", "new", "part"))
        self.caps, self.part = (most_hashes, most_bytes), int(part[0]) if len(part) else 0
        self.hashes, self.bytes = (np.concatenate([[0], np.cumsum(x)]) for x in (new, size))
        self.heads = np.flatnonzero(np.concatenate([[True], self.ws[1:] != self.ws[:-1]])[: len(self.ws)])
        self.tails = np.append(self.heads[1:], len(self.ws))

    def breaks(self, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | int = 0, size: np.ndarray | int = 0) -> np.ndarray:
        """The first row from start on that a batch, in which so much is open, does not take; end if there is none."""
        first = np.searchsorted(self.hashes, self.hashes[start] - hashes, "right")  # so many rows make it hold hashes
        over_hashes = np.searchsorted(self.hashes, self.hashes[start] - hashes + self.caps[0], "right") - 1
        over_bytes = np.searchsorted(self.bytes, self.bytes[start] - size + self.caps[1], "right") - 1
        return np.minimum(np.maximum(np.maximum(first, np.minimum(over_hashes, over_bytes)), start), end)

    def summary(self, head: int, tail: int) -> pd.DataFrame:
        """A row for each place of a segment where a batch open at its begin may break first. They are bounded by the caps:
        each place but two adds a hash or a byte to what a batch takes."""
        rows = np.arange(head, tail)
        after = np.append(self.breaks(rows, np.full(len(rows), tail)) - head, len(rows))
        last, count = np.append(np.where(after[:-1] < len(rows), after[:-1], rows - head), len(rows)), np.append((after[:-1] < len(rows)).astype(np.int64), 0)
        while True:
            further = last[last]
            if (further == last).all():
                break
            last, count = further, count + count[last]
        new, size = np.diff(self.hashes[head : tail + 1]), np.diff(self.bytes[head : tail + 1])
        ends = min(int(after[0]) + 1, len(rows))
        at = np.flatnonzero((new[:ends] > 0) | (size[:ends] > 0) | np.concatenate([[True], new[: ends - 1] > 0]))
        open_from = last[at] + head
        return pd.DataFrame({
            "ws": self.ws[head], "part": self.part, "at": at, "before": self.hashes[head + at] - self.hashes[head],
            "hashes": self.hashes[head + at + 1] - self.hashes[head], "bytes": self.bytes[head + at + 1] - self.bytes[head], "breaks": count[at],
            "open_hashes": self.hashes[tail] - self.hashes[open_from], "open_bytes": self.bytes[tail] - self.bytes[open_from],
            "all_hashes": self.hashes[tail] - self.hashes[head], "all_bytes": self.bytes[tail] - self.bytes[head],
        })

    def batches(self, entries: dict[tuple[int, int], tuple[int, int, int, bool]]) -> Iterator[pd.DataFrame]:
        """ws, batch, hashes, bytes of the batches that end here. entries: by partition and key what is open at the begin
        of a segment (number, hashes, bytes) and whether it is the key's last; other segments are whole keys."""
        known = [entries.get((self.part, w), (0, 0, 0, True)) for w in self.ws[self.heads].tolist()]
        number, hashes, size = (np.array([k[c] for k in known], np.int64) for c in range(3))
        whole = np.array([k[3] for k in known], bool)
        carried = self.breaks(self.heads, self.tails, hashes, size)
        following = self.breaks(np.arange(len(self.ws)), np.repeat(self.tails, self.tails - self.heads))
        starts, owner = [], []
        for k, (at, end) in enumerate(zip(carried.tolist(), self.tails.tolist(), strict=True)):
            while at < end:
                starts.append(at)
                owner.append(k)
                at = following.item(at)
        start, owner = np.array(starts, np.int64), np.array(owner, np.int64)
        yield self._closed(np.arange(len(known)), number, self.heads, carried, whole, hashes, size)
        yield self._closed(owner, number[owner] + 1 + np.arange(len(owner)) - np.searchsorted(owner, owner), start, following[start], whole, 0, 0)

    def _closed(self, owner: np.ndarray, number: np.ndarray, start: np.ndarray, stop: np.ndarray, whole: np.ndarray, hashes: np.ndarray | int, size: np.ndarray | int) -> pd.DataFrame:
        hashes, size = hashes + self.hashes[stop] - self.hashes[start], size + self.bytes[stop] - self.bytes[start]
        rows = pd.DataFrame({"ws": self.ws[start], "batch": number, "hashes": hashes, "bytes": size})
        return rows[(stop < self.tails[owner]) | (whole[owner] & (hashes > 0))]


def _composed(most_hashes: int, most_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Summaries by key, partition and place. Gives what is open at the begin of each segment."""
        ws = part = None
        opened, closed, broken = (0, 0, 0), (0, 0, 0), False
        for frame in frames:
            out = []
            for w, p, _, before, hashes, size, breaks, open_hashes, open_bytes, all_hashes, all_bytes in frame.itertuples(index=False):
                if (w, p) != (ws, part):
                    if ws is not None:
                        out.append((ws, part, *opened, w != ws))
                    opened = closed if w == ws else (0, 0, 0)
                    ws, part, broken = w, p, False
                    closed = opened[0], opened[1] + all_hashes, opened[2] + all_bytes
                if not broken and opened[1] + before > 0 and (opened[1] + hashes > most_hashes or opened[2] + size > most_bytes):
                    broken, closed = True, (opened[0] + 1 + breaks, open_hashes, open_bytes)
            yield pd.DataFrame(out, columns=["ws", "part", "batch", "hashes", "bytes", "last"])
        if ws is not None:
            yield pd.DataFrame([(ws, part, *opened, True)], columns=["ws", "part", "batch", "hashes", "bytes", "last"])

    return run


def next_fit(files: DataFrame, most_hashes: int = FETCH_HASHES, most_bytes: int = FETCH_BYTES, partitions: int | None = None) -> DataFrame:
    """files: ws, ord, size, new (hashes not planned before), none negative. ws, batch, hashes, bytes of each batch, in order.

    A batch closes before a file that would pass a cap; a file without new hashes still adds its size; batches without
    hashes are not given, nor numbered. An absent size or count is 0; rows without a workspace are left out; other columns
    are not looked at; an empty table gives an empty result. The order of rows that are equal in ws and ord is open.

    A partition of rows is held at once (four numbers a row), so `partitions` is what bounds memory. To the driver come two
    rows a partition. The checkpoint stays in spark.checkpoint.dir until that is cleaned."""
    spark = files.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.dirname(shared_folder(spark, "packing")))
    number = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = files.where("ws is not null").select(F.col("ws").cast("bigint").alias("ws"), "ord", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("size", "new")])
    placed = plain.repartitionByRange(number, "ws", "ord").sortWithinPartitions("ws", "ord").select("ws", "size", "new", F.spark_partition_id().alias("part")).checkpoint()

    def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(frames, most_hashes, most_bytes)
        for k in sorted({0, len(places.heads) - 1} if len(places.heads) else ()):  # others lie in this partition alone
            yield places.summary(int(places.heads[k]), int(places.tails[k]))

    parts = placed.mapInPandas(summaries, _SUMMARY)
    parts = parts.repartition("ws").sortWithinPartitions("ws", "part", "at").mapInPandas(_composed(most_hashes, most_bytes), "ws bigint, part int, batch bigint, hashes bigint, bytes bigint, last boolean")
    entries = spark.sparkContext.broadcast({(r.part, r.ws): (r.batch, r.hashes, r.bytes, r.last) for r in parts.collect()})  # at most two rows a partition

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from Places(frames, most_hashes, most_bytes).batches(entries.value)

    return placed.mapInPandas(run, "ws bigint, batch bigint, hashes bigint, bytes bigint")

