"""Cycles of synchronisation as plans for all workspaces at once: push, pull, the checks before a commit, what is applied in
which order, snapshots and clones. Manifests are rows of ws, path and an entry; see diffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import digests, merging, retention
from treeline.operators import predicates as P
from treeline.operators.diffing import KEY, diff, violations


def push(asked: DataFrame, heads: DataFrame, local: DataFrame, committed: DataFrame, published: DataFrame) -> DataFrame:
    """asked: ws, forced, base (the head that the device knows; 0 for none). heads: ws, seq. committed: what the device
    published last; published: the present head. Adds action: idle if nothing asks for a commit; commit on the known head;
    own where the next head has just these files, so that only the answer was lost; else conflict."""
    changed = digests.unequal(committed, local).withColumn("changed", F.lit(True))
    other = digests.unequal(published, local).withColumn("other", F.lit(True))
    rows = asked.join(heads, "ws", "left").join(changed, "ws", "left").join(other, "ws", "left").withColumn("seq", F.coalesce("seq", F.lit(0)))
    due = F.col("forced") | (F.col("seq") == 0) | F.coalesce("changed", F.lit(False))
    action = F.when(~due, "idle").when(F.col("seq") == F.col("base"), "commit").when((F.col("seq") == F.col("base") + 1) & F.col("other").isNull(), "own").otherwise("conflict")
    return rows.select(*asked.columns, "seq", action.alias("action"))


def masked(manifest: DataFrame) -> DataFrame:
    """Modes as they are applied: permission bits only."""
    return manifest.withColumn("mode", P.plain_mode(F.col("mode")))


def needs(changes: DataFrame, manifest: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """ws, hash: chunks of added and changed files, and of remote losers that are kept on this device only."""
    rows = changes.where("change <> 'deleted'").select(*KEY).join(manifest.select(*KEY, "chunks"), list(KEY))
    rows = rows.select("ws", F.explode("chunks").alias("hash"))
    if lost is not None:
        rows = rows.unionByName(lost.where("loser = 'remote' and local_only").select("ws", F.explode("entry.chunks").alias("hash")))
    return rows.distinct()


def pull(asked: DataFrame, local: DataFrame, remote: DataFrame, have: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: ws, known_seq, known_hash, seq, hash (of the head). have: ws, hash of chunks that are here; store: hash of those
    that can be fetched. Two tables: asked with status (idle where the head is known; invalid; missing where a chunk can't be
    fetched; else apply), changes and fetch (how many files and chunks); and the changes (ws, path, change, phase) to apply."""
    due = asked.where(~(F.col("known_seq").eqNullSafe(F.col("seq")) & F.col("known_hash").eqNullSafe(F.col("hash"))))
    bad = violations(remote.join(due.select("ws"), "ws", "left_semi")).groupBy("ws").agg(F.count(F.lit(1)).alias("bad"))
    remote = masked(remote).join(due.select("ws"), "ws", "left_semi")
    changes = diff(local.join(due.select("ws"), "ws", "left_semi"), remote)
    wanted = needs(changes, remote).join(have, ["ws", "hash"], "left_anti")
    # whether a chunk is in the store, by one aggregation over hashes, however many workspaces want it
    wanted = wanted.join(store.select("hash").distinct().withColumn("there", F.lit(True)), "hash", "left")
    fetch = wanted.groupBy("ws").agg(F.count(F.lit(1)).alias("fetch"), F.count_if(F.col("there").isNull()).alias("gone"))
    n = changes.groupBy("ws").agg(F.count(F.lit(1)).alias("changes"))
    rows = asked.join(due.select("ws").withColumn("due", F.lit(True)), "ws", "left").join(bad, "ws", "left").join(n, "ws", "left").join(fetch, "ws", "left")
    status = F.when(F.col("due").isNull(), "idle").when(F.col("bad") > 0, "invalid").when(F.col("gone") > 0, "missing").otherwise("apply")
    zero = lambda c: F.when(status == "apply", F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    rows = rows.select(*asked.columns, status.alias("status"), zero("changes"), zero("fetch"))
    return rows, merging.apply_phases(changes.join(rows.where("status = 'apply'").select("ws"), "ws", "left_semi"))


def commits(requests: DataFrame, roles: DataFrame, workspaces: DataFrame, manifests: DataFrame, closed: DataFrame, store: DataFrame, heads: DataFrame) -> DataFrame:
    """The boundary at which heads are written. requests: id, ws, user_name, device, sealed, base; manifests: id, ws, path and
    the entry of what they submit; workspaces: ws, e2e; closed: ws that keep .env files out; store: ws, hash that may be
    named. Adds verdict, the first that holds: not_found, forbidden, device, e2e_mismatch, invalid, dotenv, missing_chunks,
    conflict, ok; and seq, the number of the head that is written. Of requests for one base only the one with the smallest id is ok."""
    own = manifests.select(F.col("id").alias("ws"), "path", "chunks")
    bad = violations(own).select(F.col("ws").alias("id")).distinct().withColumn("bad", F.lit(True))
    env = manifests.where(P.is_dotenv(F.col("path"))).join(closed.select("ws").distinct(), "ws", "left_semi").select("id").distinct().withColumn("env", F.lit(True))
    named = manifests.select("id", "ws", F.explode("chunks").alias("hash")).distinct()
    gone = named.join(store.select("ws", "hash").distinct(), ["ws", "hash"], "left_anti").select("id").distinct().withColumn("gone", F.lit(True))
    rows = requests.join(roles, ["ws", "user_name"], "left").join(workspaces.select("ws", "e2e"), "ws", "left").join(heads.select("ws", "seq"), "ws", "left")
    for side in (bad, env, gone):
        rows = rows.join(side, "id", "left")
    verdict = (
        F.when(F.col("role").isNull(), "not_found")
        .when(F.col("role") < 2, "forbidden")
        .when(~device_ok(F.col("device")), "device")
        .when(F.col("sealed") != F.coalesce("e2e", F.lit(False)), "e2e_mismatch")
        .when(F.col("bad"), "invalid")
        .when(F.col("env") & ~F.col("sealed"), "dotenv")
        .when(F.col("gone"), "missing_chunks")
        .when(F.col("base") != F.coalesce("seq", F.lit(0)), "conflict")
        .otherwise("ok")
    )
    rows = rows.select(*requests.columns, verdict.alias("verdict"))
    first = rows.where("verdict = 'ok'").groupBy("ws").agg(F.min("id").alias("first"))
    verdict = F.when((F.col("verdict") == "ok") & (F.col("id") != F.col("first")), "conflict").otherwise(F.col("verdict"))
    rows = rows.join(first, "ws", "left").select(*requests.columns, verdict.alias("verdict"))
    return rows.withColumn("seq", F.when(F.col("verdict") == "ok", F.col("base") + 1))


def device_ok(device: Column) -> Column:
    """A name of 1 to 64 characters without control characters."""
    return F.coalesce(device.rlike(r"\A[^\p{Cc}]{1,64}\z"), F.lit(False))


def failure_class(status: Column, head_conflict: Column) -> Column:
    """What a client does about an answer: retry (the head moved: pull, merge, push again), fatal, read_only, transient (wait
    and try again, other 4xx too); null for success."""
    fails = F.when(status == 403, "read_only").when(status.isin(400, 401, 404), "fatal").otherwise("transient")
    return F.when(head_conflict, "retry").when(status.between(200, 299), None).otherwise(fails)


def register(asked: DataFrame, workspaces: DataFrame, teams: DataFrame, members: DataFrame) -> DataFrame:
    """Registration that may be repeated: a workspace is created once, and attached to a team only if it is not yet.

    asked: ord (no two alike), ws, name, user_name, team_name (null: none), e2e. workspaces: ws, name, owner, team, e2e.
    Adds team and outcome, the first that holds: unknown_team, again (a request before is for the same workspace), flavour
    (end-to-end asked of a workspace without it), existed, attached (it is already), not_owner, not_writer, name_taken (of
    the team's workspaces or by a request before), attach or create. Of these not_owner, not_writer and name_taken of a
    workspace that exists are warnings: the workspace goes on without the team."""
    rows = asked.join(teams.select("team", F.col("name").alias("team_name")), "team_name", "left")
    own = workspaces.select("ws", F.lit(True).alias("there"), "owner", F.col("team").alias("has"), F.col("e2e").alias("sealed"), F.col("name").alias("own_name"))
    rows = rows.join(own, "ws", "left").join(asked.groupBy("ws").agg(F.min("ord").alias("first")), "ws")
    rows = rows.join(members.where("role >= 2").select("team", "user_name", F.lit(True).alias("writer")).distinct(), ["team", "user_name"], "left")
    there, named = F.col("there").isNotNull(), F.col("team_name").isNotNull()
    outcome = (
        F.when(named & F.col("team").isNull(), "unknown_team")
        .when(F.col("ord") > F.col("first"), "again")
        .when(there & F.col("e2e") & ~F.coalesce("sealed", F.lit(False)), "flavour")
        .when(there & ~named, "existed")
        .when(there & (F.col("team") == F.col("has")), "attached")
        .when(there & (F.col("owner") != F.col("user_name")), "not_owner")
        .when(named & F.col("writer").isNull(), "not_writer")
        .when(there, "attach")
        .otherwise("create")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("name", F.coalesce("own_name", "name"))
    # a name is whose workspace has it in the team, else the first request's; one row for each name, whoever asks
    wants = rows.where("outcome in ('attach', 'create') and team is not null").select("team", "name", F.struct(F.lit(1).alias("late"), F.col("ord").cast("bigint").alias("ord")).alias("at"))
    holds = workspaces.where("team is not null").select("team", "name", F.struct(F.lit(0).alias("late"), F.lit(0).cast("bigint").alias("ord")).alias("at"))
    holder = wants.unionByName(holds).groupBy("team", "name").agg(F.min("at").alias("at"))
    rows = rows.join(holder, ["team", "name"], "left")
    lost = F.col("outcome").isin("attach", "create") & F.col("team").isNotNull() & ((F.col("at.late") == 0) | (F.col("at.ord") != F.col("ord")))
    return rows.select(*[c for c in asked.columns if c != "name"], "name", "team", F.when(lost, "name_taken").otherwise(F.col("outcome")).alias("outcome"))


def writes(requests: DataFrame, manifests: DataFrame, heads: DataFrame, refs: DataFrame, keep: int = retention.HEAD_KEEP) -> tuple[DataFrame, DataFrame]:
    """What one transaction of accepted requests (verdict ok) leaves: heads (ws, seq, id) after retention, and references with
    the new heads' chunks, each once."""
    ok = requests.where("verdict = 'ok'").select("ws", "seq", "id")
    after = retention.retained_heads(heads.select("ws", "seq", "id").unionByName(ok), keep)
    new = manifests.join(ok.select("id"), "id", "left_semi").select("ws", F.explode("chunks").alias("hash"))
    return after, refs.select("ws", "hash").unionByName(new).distinct()


def steps(changes: DataFrame, lost: DataFrame) -> DataFrame:
    """ws, step, path, target: what a device does in this order. Step 0 copies local losers to their conflict names, before
    anything is written over them; then the phases of applying."""
    saved = lost.where("loser = 'local'").select("ws", F.lit(0).alias("step"), "path", F.col("copy").alias("target"))
    return saved.unionByName(merging.apply_phases(changes).select("ws", F.col("phase").alias("step"), "path", F.when(F.col("change") != "deleted", F.col("path")).alias("target")))


def mirror_tree(source: DataFrame, target: DataFrame, referenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A cycle from one tree to another: the changes (ws, path, change, phase) that make target like source, and of
    referenced (ws, hash) what nothing needs afterwards, only of workspaces where something changed."""
    source = masked(source)
    changes = merging.apply_phases(diff(target, source))
    moved = changes.select("ws").distinct()
    needed = source.select("ws", F.explode("chunks").alias("hash")).distinct()
    return changes, referenced.join(moved, "ws", "left_semi").join(needed, ["ws", "hash"], "left_anti")


def snapshot(requests: DataFrame, errors: DataFrame, snapshots: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """requests: ws, kind, device. A snapshot is strict: one that has scan errors (ws) is refused before anything is written.
    Two tables: requests with id (the next of the workspace, null if refused), and the identifiers (ws, id) of checkpoints
    that go because a checkpoint was added."""
    clean = requests.join(errors.select("ws").distinct(), "ws", "left_anti")
    ids = retention.next_id(snapshots, requests)
    rows = requests.join(clean.join(ids, "ws").select("ws", F.col("next_id").alias("id")), "ws", "left")
    added = rows.where("id is not null and kind = 'checkpoint'").select("ws", "id", F.lit(now).cast("bigint").alias("created_at"))
    all_of = snapshots.where("kind = 'checkpoint'").select("ws", "id", "created_at").join(added.select("ws"), "ws", "left_semi").unionByName(added)
    return rows, retention.checkpoint_fates(all_of, now).where("pruned").select("ws", "id")


def clone(asked: DataFrame, snapshots: DataFrame, manifests: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: new_ws, ws, id. A clone is a new workspace with its own identity, refused where the identity is taken or the
    snapshot is not there. Two tables: lineage (new_ws, from_ws, from_id) and the first manifest of each."""
    good = asked.join(snapshots.select("ws", "id"), ["ws", "id"], "left_semi").join(taken.select(F.col("ws").alias("new_ws")), "new_ws", "left_anti")
    lineage = good.select("new_ws", F.col("ws").alias("from_ws"), F.col("id").alias("from_id"))
    return lineage, manifests.join(good, ["ws", "id"]).drop("ws", "id").withColumnRenamed("new_ws", "ws")


def uploads(chunks: DataFrame, seen: DataFrame) -> DataFrame:
    """chunks: ws, ord, hash, length. What an uploader sends, in order: each chunk at its first place, not what it has seen."""
    rows = chunks.groupBy("ws", "hash").agg(F.min(F.struct("ord", "length")).alias("at"))
    return rows.join(seen.select("ws", "hash").distinct(), ["ws", "hash"], "left_anti").select("ws", "hash", "at.ord", "at.length")


def upload_outcome(sent: DataFrame, present: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What became of each chunk of an upload, and what each workspace reports and keeps for the next one.

    sent: ws, hash, ord, length, a row for each hash. present: hashes that the store held before. answers: ws, hash, stored
    (false if someone else was faster), failure (null if it went well). First table: ws, hash, ord, length, status: present,
    stored, concurrent, failed or unconfirmed. Answers of a workspace that are not exactly one for each chunk that was not
    present confirm none of them. Second table: ws, uploaded, bytes, kept, kept_bytes (failed and unconfirmed ones, which are
    sent again), and hash and failure of the first that failed, by ord then hash. Answers for nothing sent give no rows."""
    held = present.select("hash").distinct().withColumn("held", F.lit(True))
    told = answers.groupBy("ws", "hash").agg(F.count(F.lit(1)).alias("told"), F.bool_or("stored").alias("stored"), F.min("failure").alias("failure"))
    rows = sent.select("ws", "hash", "ord", "length", F.lit(True).alias("sent")).join(held, "hash", "left").join(told, ["ws", "hash"], "full")
    open_ = F.when(F.col("sent") & F.col("held").isNull(), 1).otherwise(0)
    unclear = rows.where(open_ != F.coalesce("told", F.lit(0))).select("ws").distinct().withColumn("unclear", F.lit(True))
    status = F.when(F.col("held"), "present").when(F.col("unclear"), "unconfirmed").when(F.col("failure").isNotNull(), "failed").when(F.col("stored"), "stored").otherwise("concurrent")
    rows = rows.where("sent").join(unclear, "ws", "left").withColumn("status", status)
    stored, kept = F.col("status") == "stored", F.col("status").isin("failed", "unconfirmed")
    first = F.min(F.when(F.col("status") == "failed", F.struct("ord", "hash", "failure")))
    report = rows.groupBy("ws").agg(
        F.count_if(stored).alias("uploaded"), F.coalesce(F.sum(F.when(stored, F.col("length"))), F.lit(0)).alias("bytes"),
        F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, F.col("length"))), F.lit(0)).alias("kept_bytes"), first.alias("first"),
    )
    return rows.select("ws", "hash", "ord", "length", "status"), report.select("ws", "uploaded", "bytes", "kept", "kept_bytes", F.col("first.hash").alias("failed_hash"), F.col("first.failure").alias("failure"))


def generated_tree(spark: SparkSession, files: int, seed: int = 7, folders: int = 100) -> DataFrame:
    """A deterministic tree for measurements: path, size and one chunk's hash for each file, from digests of its number."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    rows = spark.range(files).select("id", digest.alias("hash"), number.alias("n"))
    return rows.select(F.concat(F.lit("d"), (F.col("n") % folders).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), (F.col("n") % 100_000).alias("size"), "hash")
