"""Retention of logs: newest so many, and newest of each age bucket. Times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Heads kept, and the ages (seconds) at which checkpoints thin out to hours, to days, and end.
HEAD_KEEP = 50
HOUR, DAY, WEEK = 3600, 86400, 604800


def current_head(heads: DataFrame) -> DataFrame:
    """The head of the largest seq of each workspace."""
    rest = [c for c in heads.columns if c != "ws"]
    return heads.groupBy("ws").agg(F.max_by(F.struct(*rest), "seq").alias("head")).select("ws", "head.*")


def retained_heads(heads: DataFrame, keep: int = HEAD_KEEP) -> DataFrame:
    """The newest `keep` heads of each workspace; Spark limits each partition's rows before the shuffle."""
    newest = Window.partitionBy("ws").orderBy(F.desc("seq"))
    return heads.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= keep).drop("place")


def tier(age: Column) -> Column:
    return F.when(age < HOUR, 0).when(age >= WEEK, 3).when(age < DAY, 1).otherwise(2)


def checkpoint_fates(checkpoints: DataFrame, now: int) -> DataFrame:
    """Adds age, tier (0 all stay, 1 by hour of age, 2 by day of age, 3 all go), bucket and pruned."""
    rows = checkpoints.withColumn("age", F.lit(now).cast("bigint") - F.col("created_at")).withColumn("tier", tier(F.col("age")))
    rows = rows.withColumn("bucket", F.expr(f"case tier when 1 then age div {HOUR} when 2 then age div {DAY} else 0 end"))
    newest = rows.where("tier in (1, 2)").groupBy("ws", "tier", "bucket").agg(F.max(F.struct("created_at", "id")).alias("newest"))
    rows = rows.join(newest, ["ws", "tier", "bucket"], "left")
    gone = (F.col("tier") == 3) | (F.col("tier").isin(1, 2) & (F.struct("created_at", "id") != F.col("newest")))
    return rows.withColumn("pruned", F.coalesce(gone, F.lit(False))).drop("newest")


def next_id(snapshots: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The next snapshot identifier of every workspace: the largest plus one, or one."""
    last = snapshots.groupBy("ws").agg(F.max("id").alias("last"))
    return workspaces.select("ws").distinct().join(last, "ws", "left").select("ws", (F.coalesce("last", F.lit(0)) + 1).alias("next_id"))


def listing(snapshots: DataFrame) -> DataFrame:
    """Metadata only, newest first."""
    return snapshots.select("ws", "id", "kind", "device", "created_at").orderBy("ws", F.desc("id"))


def generations_by_age(keys: DataFrame) -> DataFrame:
    """The newest generation of each workspace's keys."""
    return keys.groupBy("ws").agg(F.max("generation").alias("generation"))


def first_decrypting(tries: DataFrame) -> DataFrame:
    """tries: ws, hash, generation, data (null where the key failed). The newest generation that succeeds."""
    return tries.where("data is not null").groupBy("ws", "hash").agg(F.max_by("data", "generation").alias("data"), F.max("generation").alias("generation"))
