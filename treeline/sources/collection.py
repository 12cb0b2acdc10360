"""Garbage collection over stored rows: heads and snapshots as they are kept, bare documents or envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import envelopes, pool
from treeline.sources.store import parse_documents


def stored_chunks(rows: DataFrame) -> DataFrame:
    """rows: ws, id, stored. ws, id, hashes: the chunks that a row names, each once; null if it is neither an envelope nor a
    whole document. A document without files and an envelope without hashes name none."""
    rows = parse_documents(envelopes.parse_stored(rows), "stored")
    own = F.flatten(F.transform(F.map_values("doc.files"), lambda e: e["chunks"]))
    return rows.select("ws", "id", F.array_distinct(F.when(~F.col("plain"), F.col("envelope.hashes")).when(F.col("parseable"), own)).alias("hashes"))


def collect(refs: DataFrame, rows: DataFrame, blobs: DataFrame, now: int, grace: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The change of references, the blobs to delete under the references after it, and the workspaces that were passed over.

    Texts are read and parsed once, and what they name is written to folder, which must be new, with packed digests. A
    workspace with a row that cannot be read keeps all its references; one without any row is not listed and keeps them too.
    Repeats are dropped by the last grouping only."""
    named = F.transform("hashes", pool.packed).alias("hashes")
    stored_chunks(rows).select("ws", named).write.parquet(folder)
    parsed = refs.sparkSession.read.parquet(folder)
    listed = parsed.groupBy("ws").agg(F.bool_and(F.col("hashes").isNotNull()).alias("good"))
    skipped, good = listed.where("not good").select("ws"), listed.where("good").select("ws")
    delta = pool.delta_packed(refs, parsed.select("ws", F.explode("hashes").alias("hash")), listed)
    kept = parsed.join(skipped, "ws", "left_anti").select(F.explode("hashes").alias("hash"))
    after = refs.select("ws", pool.packed(F.col("hash")).alias("hash")).join(good, "ws", "left_anti").select("hash").unionByName(kept)
    return delta, pool.sweep_packed(blobs, after, now, grace), skipped
