"""Exact dedup as a tree-merge of sorted digest runs.

Every input partition makes one run: its digests in order, each with the identifier to keep, the number of rows and what
verifies it. With fan_in ** rounds partitions, a round sends each row to the partition that differs from its own in one
base-fan_in digit, which it takes from the digest; so fan_in runs meet in every partition, are merged in order, and equal
digests become one row again. After the last round all rows of a digest have met, no partition has read more than its
share, and a digest held by a third of all rows has never been more than one row of a run. The results go back to the rows by
a join that broadcasts the few digests of very many rows, whose rows stay where they are.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Rows with equal digests must agree on
length and on a second checksum, or the merge fails. Rows repeated with the same identifier count each and get the same
result; rows without an identifier are no documents. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._common import lookup, materialise, stretches, table, trimmed

_RUN = "digest binary, id bigint, n bigint, size bigint, crc bigint"
_ARROW = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())])


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest, size and crc of every normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, some in stretches(batch.column(1)):
                texts = [t.lower() for t in some]  # bytes.lower() changes A-Z only
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(texts)), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())],
                    names=["id", "digest", "size", "crc"],
                )

    return df.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(trimmed(run), "id bigint, digest binary, size bigint, crc bigint")


def merger(keep: str):
    """Merges rows that come in order of their digest: equal neighbours become one. Holds one batch and one row."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]).cast(_ARROW)
            if held is not None:
                t = pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            t = t.combine_chunks()
            key = t.column("digest").combine_chunks() if t.num_rows else None
            new = np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]) if t.num_rows > 1 else np.array([True])
            at = np.flatnonzero(new)
            cols = {c: t.column(c).to_numpy() for c in ("id", "n", "size", "crc")}
            for c in ("size", "crc"):
                if (np.minimum.reduceat(cols[c], at) != np.maximum.reduceat(cols[c], at)).any():
                    raise ValueError("equal digests of different texts")
            out = pa.Table.from_arrays(
                [key.take(pa.array(at)), pa.array((np.maximum if keep == "max" else np.minimum).reduceat(cols["id"], at)), pa.array(np.add.reduceat(cols["n"], at)), pa.array(cols["size"][at]), pa.array(cols["crc"][at])], schema=_ARROW
            )
            held = out.slice(out.num_rows - 1)
            yield from out.slice(0, out.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return merge


def tree_merge(rows: DataFrame, keep: str = "min", fan_in: int = 4, rounds: int = 2) -> DataFrame:
    """rows: digest, id, n, size, crc, a row for each text. Gives one row for each digest."""
    parts, merge = fan_in**rounds, merger(keep)
    runs = rows.select("digest", "id", "n", "size", "crc").sortWithinPartitions("digest").mapInArrow(merge, _RUN)
    runs = runs.withColumn("at", F.pmod(F.spark_partition_id(), F.lit(parts)))
    digit = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint"), F.lit(parts))
    for r in range(rounds):
        step = fan_in**r
        own = F.floor(F.col("at") / step) % fan_in
        to = F.col("at") + (F.floor(digit / step) % fan_in - own) * step
        runs = runs.withColumn("to", to.cast("int")).repartitionById(parts, F.col("to")).drop("at", "to")
        runs = runs.sortWithinPartitions("digest").mapInArrow(merge, _RUN).withColumn("at", F.spark_partition_id())
    return runs.drop("at")


def rounds_for(spark: SparkSession, rows: int, fan_in: int, run_rows: int = 500_000) -> int:
    """As many rounds as give every core a partition and no partition more than run_rows rows."""
    rounds, need = 1, max(spark.sparkContext.defaultParallelism, rows // run_rows)
    while fan_in**rounds < need:
        rounds += 1
    return rounds


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 4) -> DataFrame:
    """A row for each row of df: id_col, keep_id, group_size, kept, text_sha256. keep: min or max identifier stays."""
    spark = df.sparkSession
    own = materialise(digests(df, id_col, text_col), "digests")
    merged = tree_merge(own.withColumn("n", F.lit(1).cast("bigint")), keep, fan_in, rounds_for(spark, own.count(), fan_in))
    merged = materialise(merged.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size")), "merged")
    return lookup(own, merged, ["digest"], "group_size").select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = {
    "op9_exact_dedup": f"""
with t as (select doc_id, sha256(translate(coalesce(text, ''), '{_UP}', '{_LOW}')) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)"""
}
