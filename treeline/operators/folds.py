"""Folds in order: plans of capped batches, and capped debouncing.

Both depend on all rows before. Batches are packed with a key's rows spread over all tasks (see packing). Debouncing folds a
key in one pass over its rows in order: the rows of a partition are sorted by key and streamed, so memory is bounded by one
batch and one key's state, not by a key's rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.packing import FETCH_BYTES, FETCH_HASHES, next_fit

# Most entries and bytes of a put.
PUT_ENTRIES, PUT_BYTES = 256, 32 << 20


def _in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def fetch_plan(chunks: DataFrame, sizes: DataFrame, most_hashes: int = FETCH_HASHES, most_bytes: int = FETCH_BYTES) -> DataFrame:
    """chunks: ws, file, pos, hash; sizes: ws, file, size (files without chunks too). Each hash goes with its first file."""
    from treeline.operators.pool import first_reference

    new = first_reference(chunks).groupBy("ws", "file").agg(F.count(F.lit(1)).alias("new"))
    files = sizes.join(new, ["ws", "file"], "left").select("ws", F.col("file").alias("ord"), F.col("size").cast("bigint").alias("size"), F.coalesce("new", F.lit(0)).cast("bigint").alias("new"))
    return next_fit(files, most_hashes, most_bytes)


def put_plan(entries: DataFrame, most_entries: int = PUT_ENTRIES, most_bytes: int = PUT_BYTES) -> DataFrame:
    """entries: ws, ord, length. Batches of uploads; an oversized entry goes alone."""
    return next_fit(entries.select("ws", "ord", F.col("length").alias("size"), F.lit(1).cast("bigint").alias("new")), most_entries, most_bytes)


def debounce(events: DataFrame, quiet: float, cap: float) -> DataFrame:
    """events: ws, id, at, wanted, and kick if there are any. Windows: ws, opened, last, n, capped, runs. A window ends when
    nothing comes for `quiet`, or with the first event `cap` or more after it opened; it runs a cycle if some event in it was
    wanted. A kick that comes while no window is open is a window of its own at once; inside one it is a wanted event."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["ws", "opened", "last", "n", "capped", "runs"]
        cur: list | None = None
        for frame in frames:
            out = []
            for ws, at, wanted, kick in zip(frame["ws"], frame["at"], frame["wanted"], frame["kick"], strict=True):
                if cur and (cur[0] != ws or at - cur[2] >= quiet):
                    out.append(cur)
                    cur = None
                if cur is None and kick:
                    out.append([ws, at, at, 1, False, True])
                    continue
                wanted = wanted or kick
                cur = [ws, at, at, 1, False, bool(wanted)] if cur is None else [ws, cur[1], at, cur[3] + 1, False, cur[5] or bool(wanted)]
                if cur[2] - cur[1] >= cap:
                    cur[4] = True
                    out.append(cur)
                    cur = None
            yield pd.DataFrame(out, columns=cols)
        if cur:
            yield pd.DataFrame([cur], columns=cols)

    rows = events.select("ws", "id", "at", "wanted", (F.col("kick") if "kick" in events.columns else F.lit(False)).alias("kick"))
    return _in_order(rows, ["ws"], ["at", "id"]).mapInPandas(fold, "ws bigint, opened bigint, last bigint, n bigint, capped boolean, runs boolean")
