"""Digest trees of manifests: equality of whole trees, and what differs, without reading what does not.

A path belongs to a shard by the first digits of its digest. A shard's digest is that of the sums of its rows' digests, word
by word, and their number; so rows may come in any order, and tasks add up what they have before anything is dealt. A
node's digest is that of its at most 16 children. Built-in functions only; no list of a workspace's files is ever made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.diffing import ENTRY, KEY, diff

#: Digits that name a shard: 16 ** 3 of them.
LEVELS = 3


def shard_of(path: Column, levels: int = LEVELS) -> Column:
    return F.substring(F.sha2(path, 256), 1, levels)


def _words(digest: Column) -> list[Column]:
    """A digest as eight numbers below 2 ** 32, whose sums over fewer than 2 ** 31 rows are exact."""
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"w{k}") for k in range(8)]


def leaves(manifest: DataFrame, levels: int = LEVELS) -> DataFrame:
    """ws, node (a shard), digest, n: of each shard that has rows."""
    line = F.sha2(F.to_json(F.struct("path", *ENTRY)), 256)
    rows = manifest.select("ws", shard_of(F.col("path"), levels).alias("node"), line.alias("line")).select("ws", "node", *_words(F.col("line")))
    sums = rows.groupBy("ws", "node").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(8)], F.count(F.lit(1)).alias("n"))
    return sums.select("ws", "node", F.sha2(F.concat_ws(":", "n", *[f"w{k}" for k in range(8)]), 256).alias("digest"), "n")


def above(nodes: DataFrame) -> DataFrame:
    """The nodes of the next level up."""
    children = F.array_sort(F.collect_list(F.struct("child", "digest")))
    nodes = nodes.withColumn("child", F.col("node")).groupBy("ws", F.expr("substr(node, 1, length(node) - 1)").alias("node"))
    return nodes.agg(F.sha2(F.to_json(children), 256).alias("digest"), F.sum("n").alias("n"))


def tree(manifest: DataFrame, levels: int = LEVELS) -> DataFrame:
    """ws, node, digest, n of all nodes; the root's name is empty."""
    level = leaves(manifest, levels)
    out = level
    for _ in range(levels):
        level = above(level)
        out = out.unionByName(level)
    return out


def roots(manifest: DataFrame, levels: int = LEVELS) -> DataFrame:
    """ws, digest of each workspace's files; only equality means something."""
    return leaves(manifest, levels).groupBy("ws").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node", "digest")))), 256).alias("digest"))  # at most 16 ** levels nodes


def unequal(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """ws: workspaces whose files differ; one that only one side has differs."""
    both = roots(a, levels).withColumn("side", F.lit(1)).unionByName(roots(b, levels).withColumn("side", F.lit(2)))
    return both.groupBy("ws").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y or n < 2").select("ws")


def descend(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """a, b: trees. ws, node: the shards that differ, found from the root down: of a node that is equal, nothing below is
    looked at."""
    cols = ["ws", "node", "digest"]
    both = a.select(*cols).withColumn("side", F.lit(1)).unionByName(b.select(*cols).withColumn("side", F.lit(2)))
    differing = both.groupBy("ws", "node").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y or n < 2").select("ws", "node")
    open_ = differing.where("node = ''").select("ws", F.col("node").alias("up"))
    for level in range(1, levels + 1):
        below = differing.where(F.length("node") == level).withColumn("up", F.expr("substr(node, 1, length(node) - 1)"))
        open_ = below.join(open_, ["ws", "up"], "left_semi").select("ws", F.col("node").alias("up"))
    return open_.withColumnRenamed("up", "node")


class Sharded:
    """A manifest as Parquet in a folder for each shard, with its tree beside it."""

    def __init__(self, path: str, levels: int = LEVELS):
        self.path, self.levels = path, levels

    def write(self, manifest: DataFrame) -> Sharded:
        rows = manifest.select(*KEY, *ENTRY).withColumn("shard", F.concat(F.lit("s"), shard_of(F.col("path"), self.levels)))
        rows.repartition("shard").sortWithinPartitions("shard", *KEY).write.partitionBy("shard").parquet(f"{self.path}/files")
        tree(self.read(manifest), self.levels).write.parquet(f"{self.path}/tree")
        return self

    def read(self, like: DataFrame, shards: list[str] | None = None) -> DataFrame:
        """The rows, of these shards only if given: other folders are not opened."""
        schema = ", ".join(f"`{c}` {like.schema[c].dataType.simpleString()}" for c in (*KEY, *ENTRY))
        rows = like.sparkSession.read.schema(f"{schema}, shard string").parquet(f"{self.path}/files")
        if shards is not None:
            rows = rows.where(F.col("shard").isin([f"s{s}" for s in shards]))
        return rows.drop("shard")

    def tree(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.read.parquet(f"{self.path}/tree")


def sharded_diff(old: Sharded, new: Sharded, like: DataFrame) -> tuple[DataFrame, list[str]]:
    """The difference of two stored manifests (see diff), and the shards that were read for it: those with a node that
    differs in some workspace. like: any manifest of their types."""
    shards = [r.node for r in descend(old.tree(like), new.tree(like), old.levels).select("node").distinct().collect()]  # at most 16 ** levels
    return diff(old.read(like, shards), new.read(like, shards)), sorted(shards)
