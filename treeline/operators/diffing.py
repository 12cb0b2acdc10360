"""Differences and consistency of manifests: one row a path, keyed by ws and path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import predicates as P

ENTRY = ("size", "mode", "mtime_secs", "mtime_nanos", "chunks")
KEY = ("ws", "path")


def entries(manifest: DataFrame) -> DataFrame:
    """ws, path, entry (a struct; absence is null, never an empty array)."""
    return manifest.select(*KEY, F.struct(*ENTRY).alias("entry"))


def align(**sides: DataFrame) -> DataFrame:
    """Manifests side by side with one shuffle: union, then one aggregation by path. A column for each side."""
    tagged = None
    for name, side in sides.items():
        rows = entries(side).withColumn("side", F.lit(name))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy(*KEY).agg(*[F.max(F.when(F.col("side") == name, F.col("entry"))).alias(name) for name in sides])


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """ws, path, change: added, changed (mode or time alone count) or deleted."""
    rows = align(o=old, n=new)
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return rows.select(*KEY, change.alias("change")).where("change is not null")


def file_dir_conflicts(paths: DataFrame, key: str = "ws") -> DataFrame:
    """Paths that are a proper directory prefix of another in the same manifest: ancestors exploded, then an equi-join."""
    above = paths.select(key, F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    return paths.select(key, "path").join(above, [key, "path"], "left_semi").distinct()


def casefold_collisions(paths: DataFrame, key: str = "ws") -> DataFrame:
    return paths.groupBy(key, F.lower("path").alias("folded")).agg(F.countDistinct("path").alias("n"), F.min("path").alias("first")).where("n > 1")


def violations(manifest: DataFrame) -> DataFrame:
    """ws, path, violation of each row that would make the manifest unacceptable."""
    bad_hash = F.exists("chunks", lambda c: ~P.is_chunk_hash(c))
    own = manifest.withColumn("violation", F.when(~P.path_valid(F.col("path")), "path").when(bad_hash, "hash"))
    clash = file_dir_conflicts(manifest).withColumn("violation", F.lit("file_dir"))
    return own.where("violation is not null").select(*KEY, "violation").unionByName(clash.select(*KEY, "violation"))


def reuse(scan: DataFrame, old: DataFrame, present: DataFrame, scanned_at: int, guard: int = 2) -> DataFrame:
    """Scanned files whose chunks the old manifest still tells: same size and time, settled before the scan by `guard`
    seconds, and all chunks present. scan: ws, path, size, mtime_secs, mtime_nanos."""
    missing = old.select(*KEY, F.explode("chunks").alias("hash")).join(present.select("hash"), "hash", "left_anti").select(*KEY).distinct()
    usable = old.join(missing, list(KEY), "left_anti").select(*KEY, F.col("size").alias("o_size"), F.col("mtime_secs").alias("o_secs"), F.col("mtime_nanos").alias("o_nanos"), "chunks")
    hit = (F.col("size") == F.col("o_size")) & (F.col("mtime_secs") == F.col("o_secs")) & (F.col("mtime_nanos") == F.col("o_nanos")) & (F.col("mtime_secs") + guard <= scanned_at)
    return scan.select(*KEY, "size", "mtime_secs", "mtime_nanos").join(usable, list(KEY), "left").select(*KEY, "size", F.coalesce(hit, F.lit(False)).alias("reused"), F.when(hit, F.col("chunks")).alias("chunks"))


def retained_under(old: DataFrame, unreadable: DataFrame, scanned: DataFrame, present: DataFrame) -> DataFrame:
    """Old entries at or under an unreadable path that the scan did not give and whose chunks are all present (hash):
    ancestors-or-self, then equi-joins."""
    missing = old.select(*KEY, F.explode("chunks").alias("hash")).join(present.select("hash").distinct(), "hash", "left_anti").select(*KEY).distinct()
    at = old.select(*KEY, F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))).alias("above"))
    hit = at.join(unreadable.select("ws", F.col("path").alias("above")).distinct(), ["ws", "above"], "left_semi").select(*KEY).distinct()
    return hit.join(scanned.select(*KEY), list(KEY), "left_anti").join(missing, list(KEY), "left_anti")
