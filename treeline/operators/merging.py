"""Deterministic three-way merge of manifests: the newer side wins and the loser is kept as a conflict copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators import predicates as P
from treeline.operators.diffing import ENTRY, KEY, align, diff


def _time(side: str) -> Column:
    return F.struct(F.col(f"{side}.mtime_secs"), F.col(f"{side}.mtime_nanos"))


def decision() -> Column:
    """What happens to a path with columns base, local, remote; null is absence. The first rule that holds counts."""
    b, l, r = F.col("base"), F.col("local"), F.col("remote")  # noqa: E741
    newer = _time("remote") >= _time("local")  # ties go to remote
    same = F.col("local.chunks").eqNullSafe(F.col("remote.chunks")) & (F.col("local.mode") == F.col("remote.mode")) & (F.col("local.size") == F.col("remote.size"))
    return (
        F.when(l.eqNullSafe(r), "keep")
        .when(l.eqNullSafe(b), "remote")
        .when(r.eqNullSafe(b), "local")
        .when(l.isNull(), "edit_beats_delete_remote")
        .when(r.isNull(), "edit_beats_delete_local")
        .when(same & newer, "same_content_remote")
        .when(same, "same_content_local")
        .when(newer, "conflict_local_loses")
        .otherwise("conflict_remote_loses")
    )


def decide(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """ws, path, base, local, remote, decision, winner. One shuffle, of two sides where base is local itself."""
    rows = align(local=local, remote=remote).select(*KEY, F.col("local").alias("base"), "local", "remote") if base is local else align(base=base, local=local, remote=remote)
    rows = rows.withColumn("decision", decision())
    from_remote = F.col("decision").isin("remote", "edit_beats_delete_remote", "same_content_remote", "conflict_local_loses")
    return rows.withColumn("winner", F.when(from_remote, F.col("remote")).otherwise(F.col("local")))


def device_label(device: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(device, r"[/\\\p{Cc}]", "_"), r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("device"))


def copy_name(path: Column, label: Column, stamp: Column, ordinal: Column) -> Column:
    """dir/stem (conflict from label stamp)[ n].ext, split at the last dot that is not the name's first character."""
    name = P.basename(path)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    n = F.when(ordinal > 1, F.concat(F.lit(" "), ordinal.cast("string"))).otherwise("")
    return F.concat(folder, stem, F.lit(" (conflict from "), label, F.lit(" "), stamp, F.lit(")"), n, ext)


def conflicts(decided: DataFrame, device: str, stamp: str) -> DataFrame:
    """ws, path, copy, loser, local_only, entry. Copies take the first free ordinal: not a path of either side, nor a
    directory of one. Two conflicts whose copies would have one name (which takes a path that looks like a copy) are not
    told apart."""
    lost = decided.where(F.col("decision").startswith("conflict_"))
    local = F.col("decision") == "conflict_local_loses"
    lost = lost.select("ws", "path", F.when(local, "local").otherwise("remote").alias("loser"), F.when(local, F.col("local")).otherwise(F.col("remote")).alias("entry"))
    label = F.when(F.col("loser") == "local", device_label(F.lit(device))).otherwise("remote")
    at = lambda n: copy_name(F.col("path"), label, F.lit(stamp), n)
    named = lost.withColumn("first", at(F.lit(1)))
    # only names that look like copies can stand in the way: those few are matched by the name without its ordinal
    like = F.col("path").contains(" (conflict from ")
    taken = decided.where(like & (F.col("local").isNotNull() | F.col("remote").isNotNull())).select("ws", "path")
    taken = taken.unionByName(taken.select("ws", F.explode(P.ancestors(F.col("path"))).alias("path")).where(like)).distinct()
    plain = F.regexp_replace("path", r" \d+(\.[^./]*)?$", "$1")
    used = taken.select("ws", "path").withColumn("plain", F.explode(F.array_distinct(F.array("path", plain))))
    used = used.groupBy("ws", F.col("plain").alias("first")).agg(F.collect_set("path").alias("used"))
    named = named.join(used, ["ws", "first"], "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    tries = F.transform(F.sequence(F.lit(1), F.size("used") + 1), lambda n: at(n))
    free = F.filter(tries, lambda c: ~F.array_contains(F.col("used"), c))
    named = named.withColumn("copy", F.element_at(free, 1))
    git = P.is_git_path(F.col("path"))
    return named.select("ws", "path", F.when(git, F.concat(F.lit(f"{P.STATE_DIR}/conflicts/"), F.col("copy"))).otherwise(F.col("copy")).alias("copy"), "loser", git.alias("local_only"), "entry")


def merged_rows(decided: DataFrame, lost: DataFrame) -> DataFrame:
    """The merged manifest: winners and the copies that are shared."""
    winners = decided.where("winner is not null").select("ws", "path", F.col("winner").alias("entry"))
    copies = lost.where("not local_only").select("ws", F.col("copy").alias("path"), "entry")
    return winners.unionByName(copies).select("ws", "path", *[F.col(f"entry.{c}").alias(c) for c in ENTRY])


def headers(local: DataFrame, merged: DataFrame) -> DataFrame:
    """local: ws, scanned_at_secs, the headers of the local manifests. Those of the merged ones: identifier and time of the
    scan come from the local side, with the number of files and their bytes; workspaces left without files have none of both."""
    sums = merged.groupBy("ws").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return local.join(sums, "ws", "left").select("ws", "scanned_at_secs", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files", "bytes")])


def apply_list(local: DataFrame, merged: DataFrame, lost: DataFrame) -> DataFrame:
    """What changes on the local tree: copies of local losers are there already."""
    there = lost.where("loser = 'local' and not local_only").select("ws", F.col("copy").alias("path"), F.lit("added").alias("change"))
    return diff(local, merged).join(there, ["ws", "path", "change"], "left_anti")


def applied(decided: DataFrame, lost: DataFrame) -> DataFrame:
    """apply_list from the decisions themselves, without aligning manifests again: a copy has a name that neither side has,
    so it is always added, and those of local losers are there already."""
    change = F.when(F.col("local").isNull(), "added").when(F.col("winner").isNull(), "deleted").otherwise("changed")
    rows = decided.where(~F.col("local").eqNullSafe(F.col("winner"))).select("ws", "path", change.alias("change"))
    return rows.unionByName(lost.where("loser = 'remote' and not local_only").select("ws", F.col("copy").alias("path"), F.lit("added").alias("change")))


def unsettled(decided: DataFrame) -> DataFrame:
    """One row: new_conflicts and changes, what a merge with the published side (remote) would change in it. As in applied,
    a copy that is shared is always added, so both are told by the decisions alone."""
    conflict = F.col("decision").startswith("conflict_")
    differs = F.count_if(~F.col("remote").eqNullSafe(F.col("winner")))
    copies = F.count_if(conflict & ~P.is_git_path(F.col("path")))
    return decided.agg(F.count_if(conflict).alias("new_conflicts"), (differs + copies).alias("changes"))


def apply_phases(changes: DataFrame) -> DataFrame:
    """Phases of applying: deletes and writes of the tree, then deletes and writes under .git."""
    git, gone = P.is_git_path(F.col("path")), F.col("change") == "deleted"
    return changes.withColumn("phase", F.when(~git & gone, 1).when(~git, 2).when(gone, 3).otherwise(4))
