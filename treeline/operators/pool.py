"""The shared chunk pool: presence, visibility, references and mark-and-sweep.

refs: ws, hash. files: ws, file, size, pos, hash (a row for each chunk in order). pool: hash, length, mtime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import predicates as P


def packed(digest: Column) -> Column:
    """A digest's 32 bytes for its 64 digits, as it is dealt by exchanges; any other text is kept whole, after 33 zero bytes."""
    return F.when(P.is_chunk_hash(digest), F.unhex(digest)).otherwise(F.concat(F.lit(bytes(33)), F.encode(digest, "UTF-8")))


def unpacked(data: Column) -> Column:
    return F.when(F.octet_length(data) == 32, F.lower(F.hex(data))).otherwise(F.decode(F.substring(data, 34, 2**31 - 1), "UTF-8"))


def _short(rows: DataFrame) -> DataFrame:
    """hash as it is dealt: a digest's text packed, another name (the number of what has the digest) as it is."""
    return rows.withColumn("hash", packed(F.col("hash"))) if rows.schema["hash"].dataType.typeName() == "string" else rows


def _finely(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys over four times the usual number of tasks: a grouping by nearly distinct keys holds a task's rows."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_reference(files: DataFrame) -> DataFrame:
    """Each hash of a workspace with the first place that needs it, in file order, then chunk order."""
    rows = _finely(files.select("ws", packed(F.col("hash")).alias("hash"), "file", "pos"), "ws", "hash")
    return rows.groupBy("ws", "hash").agg(F.min(F.struct("file", "pos")).alias("at")).select("ws", unpacked(F.col("hash")).alias("hash"), "at.file", "at.pos")


def dedup_stats(files: DataFrame, pool: DataFrame) -> DataFrame:
    """By workspace: references, distinct chunks, and of these the chunks and bytes to write."""
    each = files.groupBy("ws", "hash").agg(F.count(F.lit(1)).alias("refs")).join(pool.select("hash", "length"), "hash", "left")
    return each.groupBy("ws").agg(F.sum("refs").alias("refs"), F.count(F.lit(1)).alias("chunks"), F.count("length").alias("present"), F.coalesce(F.sum("length"), F.lit(0)).alias("present_bytes"))


def visible(workspaces: DataFrame, members: DataFrame, refs: DataFrame) -> DataFrame:
    """user_name, hash: chunks that a user's own or team's workspaces refer to."""
    own = workspaces.select(F.col("owner").alias("user_name"), "ws")
    shared = workspaces.where("team is not null").join(members.select("team", "user_name"), "team").select("user_name", "ws")
    return own.unionByName(shared).distinct().join(refs, "ws").select("user_name", "hash").distinct()


def visible_of(asked: DataFrame, workspaces: DataFrame, members: DataFrame, refs: DataFrame) -> DataFrame:
    """The rows of visible that are asked for (user_name, hash), each once. Hashes are looked up by owner, and by each team of
    who asks; what a team sees is not made for each of its members. refs are read once: what nobody who asks can see is left
    out, and repeats are dropped, with owners and teams in one table."""
    text, pairs = asked.schema["hash"].dataType.typeName() == "string", _short(asked.select("user_name", "hash")).distinct()
    users = asked.where("user_name is not null").select("user_name").distinct()
    theirs = members.where("team is not null").select("team", "user_name").distinct().join(users, "user_name", "left_semi")
    no_user, no_team = (F.lit(None).cast(x.schema[c].dataType) for x, c in ((asked, "user_name"), (members, "team")))
    own = workspaces.join(users.withColumnRenamed("user_name", "owner"), "owner", "left_semi").select("ws", F.col("owner").alias("user"), no_team.alias("team"))
    shared = workspaces.join(theirs.select("team").distinct(), "team", "left_semi").select("ws", no_user.alias("user"), "team")
    spaces = own.unionByName(shared).groupBy("ws").agg(F.collect_set(F.struct("user", "team")).alias("sees"))
    seen = _short(refs.select("ws", "hash")).join(spaces, "ws").select(F.explode("sees").alias("s"), "hash").select("s.user", "s.team", "hash").distinct()
    # who asks stands for themselves and for each of their teams
    who = users.select("user_name", F.col("user_name").alias("user"), no_team.alias("team"))
    who = who.unionByName(theirs.select("user_name", no_user.alias("user"), "team"))
    found = pairs.join(who, "user_name").join(seen.withColumnsRenamed({"user": "u", "team": "t", "hash": "h"}), F.col("user").eqNullSafe(F.col("u")) & F.col("team").eqNullSafe(F.col("t")) & (F.col("hash") == F.col("h")), "left_semi")
    return found.select("user_name", "hash").distinct().select("user_name", (unpacked(F.col("hash")) if text else F.col("hash")).alias("hash"))


def visible_counts(workspaces: DataFrame, members: DataFrame, refs: DataFrame) -> DataFrame:
    """user_name, n, first_hash: how many rows visible has for each user, and the smallest hash. Users of the same teams see
    the same through these, which is counted once for all of them; a user's own workspaces add what the teams have not."""
    refs, first = refs.select("ws", packed(F.col("hash")).alias("hash")), F.min(unpacked(F.col("hash"))).alias("first_hash")
    teams = members.where("team is not null").groupBy("user_name").agg(F.array_sort(F.collect_set("team")).alias("teams"))
    spaces = workspaces.where("team is not null").select("team", "ws").distinct()
    places = teams.select("teams").distinct().withColumn("team", F.explode("teams")).join(spaces, "team").select("ws", "teams").distinct()
    shared = refs.join(places, "ws").select("teams", "hash").distinct()
    own = refs.join(workspaces.select("ws", F.col("owner").alias("user_name")).distinct(), "ws").select("user_name", "hash").distinct()
    # shared hashes have no user, own ones the teams of theirs: one grouping says which own ones the teams have
    own = own.join(teams.withColumnRenamed("user_name", "member"), F.col("user_name").eqNullSafe(F.col("member")), "left").select("teams", "hash", F.struct("user_name").alias("owner"))
    groups = shared.select("teams", "hash", F.lit(None).cast(own.schema["owner"].dataType).alias("owner")).unionByName(own).groupBy("teams", "hash")
    groups = groups.agg(F.max(F.col("owner").isNull()).alias("has"), F.collect_set("owner").alias("owners"))
    total = groups.where("has").groupBy("teams").agg(F.count(F.lit(1)).alias("n"), first)
    more = groups.where("not has").select(F.explode("owners").alias("owner"), "hash").select("owner.user_name", "hash")
    rows = teams.join(total, "teams").select("user_name", "n", "first_hash").unionByName(more.groupBy("user_name").agg(F.count(F.lit(1)).alias("n"), first))
    return rows.groupBy("user_name").agg(F.sum("n").alias("n"), F.min("first_hash").alias("first_hash"))


def calls(asked: DataFrame, most: int = 50_000, cell: int = 10_000) -> DataFrame:
    """asked: user_name, ord, ... Adds call: each user's list in order, split after every `most` rows. Places are counted
    by cells of a user's range of ord, and inside a cell only where a call ends in it, so that a long list is not one task's
    and few rows are dealt."""
    ends = asked.groupBy("user_name").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.ceil(F.count(F.lit(1)) / cell).alias("cells"))
    ends = ends.withColumnRenamed("user_name", "user")
    rows = asked.join(F.broadcast(ends), F.col("user_name").eqNullSafe(F.col("user")))
    rows = rows.withColumn("cell", F.floor((F.col("ord") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.col("cells")))
    before = Window.partitionBy("user").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("user", F.col("cell").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select(F.col("user").alias("whose"), "at", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sums = sums.select("whose", "at", "base", F.floor(F.col("base") / most).alias("call"), (F.floor(F.col("base") / most) < F.floor((F.col("base") + F.col("n") - 1) / most)).alias("split"))
    rows = rows.join(F.broadcast(sums), F.col("user").eqNullSafe(F.col("whose")) & (F.col("cell") == F.col("at")))
    place = F.row_number().over(Window.partitionBy("user", "cell").orderBy("ord")) - 1
    split = rows.where("split").withColumn("call", F.floor((F.col("base") + place) / most))
    return rows.where("not split").unionByName(split).select(*asked.columns, "call")


def missing(asked: DataFrame, pool: DataFrame, seen: DataFrame, admin: bool = False, most: int = 50_000) -> DataFrame:
    """asked: user_name, ord, hash, call (see calls). What is not both in the pool and visible, duplicates and order kept.
    Calls of over `most` hashes fail; they are counted beside the rows, which are not dealt for it."""
    worst = asked.groupBy("user_name", "call").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    rows = asked.join(F.broadcast(worst)).where(F.when(F.col("n") > most, F.raise_error(F.lit("too many hashes")).cast("boolean")).otherwise(True))
    stored = pool.select("hash").distinct()
    if admin:
        return rows.join(stored, "hash", "left_anti").select("user_name", "ord", "hash")
    return rows.join(seen.join(stored, "hash", "left_semi"), ["user_name", "hash"], "left_anti").select("user_name", "ord", "hash")


def missing_report(files: DataFrame, pool: DataFrame) -> DataFrame:
    """By workspace: how many distinct chunks are missing, and the first in file order, then chunk order."""
    gone = first_reference(files).join(pool.select("hash"), "hash", "left_anti")
    return gone.groupBy("ws").agg(F.count(F.lit(1)).alias("n_missing"), F.min(F.struct("file", "pos", "hash")).alias("at")).select("ws", "n_missing", F.col("at.file").alias("first_file"), F.col("at.hash").alias("first_hash"))


def put(chunks: DataFrame, pool: DataFrame) -> DataFrame:
    """chunks: hash, data. What to append: bytes that are their name's, once, and not in the pool."""
    good = chunks.where(F.sha2("data", 256) == F.col("hash")).dropDuplicates(["hash"])
    return good.join(pool.select("hash"), "hash", "left_anti")


def get(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """asked: hash. Adds data and torn: what is stored under the name but is not it."""
    found = asked.join(pool.select("hash", "data"), "hash", "left")
    ok = F.sha2("data", 256) == F.col("hash")
    return found.select("hash", F.when(ok, F.col("data")).alias("data"), F.coalesce(~ok, F.lit(False)).alias("torn"))


def heal(asked: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: hash. What can be read (hash, data), and the pool without what was asked for and is torn, so that the next put
    of its bytes is taken. Only what is asked for is verified."""
    got = get(asked.select("hash").distinct(), pool)
    return got.where("data is not null").select("hash", "data"), pool.join(got.where("torn").select("hash").distinct(), "hash", "left_anti")


def assemble(files: DataFrame, pool: DataFrame) -> DataFrame:
    """Each file from its chunks in order; complete is false where one is missing."""
    rows = files.join(pool.select("hash", "data"), "hash", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", "data")))
    rows = rows.groupBy("ws", "file").agg(parts.alias("parts"), F.bool_and(F.col("data").isNotNull()).alias("complete"))
    return rows.select("ws", "file", "complete", F.when(F.col("complete"), F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.data))")).alias("data"))


def locality(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many entries differ between two multisets of hashes."""
    both = before.select("hash", F.lit(1).alias("n")).unionByName(after.select("hash", F.lit(-1).alias("n")))
    both = _finely(both.select(packed(F.col("hash")).alias("hash"), "n"), "hash")
    return both.groupBy("hash").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("changed"))


def live(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows: ws, file, parseable (retained heads and snapshots). ws, hash of workspaces whose rows all parse."""
    return _live(rows, chunks).select("ws", "hash").distinct().select("ws", unpacked(F.col("hash")).alias("hash"))


def _live(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same with packed hashes, repeats left in."""
    good = rows.groupBy("ws").agg(F.bool_and("parseable").alias("ok")).where("ok").select("ws")
    own = rows.join(good, "ws", "left_semi").select("ws", "file").distinct()
    return own.join(chunks.select("ws", "file", packed(F.col("hash")).alias("hash")), ["ws", "file"]).select("ws", "hash")


def refs_delta(refs: DataFrame, kept: DataFrame, listed: DataFrame) -> DataFrame:
    """ws, hash, action: delete and add for listed workspaces, whose references become exactly the live ones."""
    return delta_packed(refs, kept.select("ws", packed(F.col("hash")).alias("hash")), listed.select("ws").distinct().withColumn("good", F.lit(True)))


def delta_packed(refs: DataFrame, kept: DataFrame, listed: DataFrame) -> DataFrame:
    """refs_delta of packed live ones, which may repeat. listed: ws, good; of a workspace that is listed and not good nothing
    changes. Whether a workspace is listed is asked only of what differs."""
    own = refs.select("ws", packed(F.col("hash")).alias("hash"), F.lit(1).alias("had"), F.lit(0).alias("has"))
    both = own.unionByName(kept.select("ws", "hash", F.lit(0).alias("had"), F.lit(1).alias("has"))).groupBy("ws", "hash").agg(F.max("had").alias("had"), F.max("has").alias("has"))
    rows = both.where("had <> has").join(listed, "ws", "left").where("good or (good is null and has = 1)")
    return rows.select("ws", unpacked(F.col("hash")).alias("hash"), F.when(F.col("had") == 1, "delete").otherwise("add").alias("action"))


def sweep(blobs: DataFrame, refs: DataFrame, now: int, grace: int) -> DataFrame:
    """blobs: hash (file name), mtime. Names to delete: digests without a reference anywhere that are older than the
    grace. Odd names and times to come stay."""
    return sweep_packed(blobs, refs.select(packed(F.col("hash")).alias("hash")), now, grace)


def sweep_packed(blobs: DataFrame, refs: DataFrame, now: int, grace: int) -> DataFrame:
    """sweep under packed references."""
    old = blobs.where(P.is_chunk_hash(F.col("hash")) & (F.col("mtime") < now - grace)).withColumn("_hash", packed(F.col("hash")))
    return old.join(refs.select(F.col("hash").alias("_hash")).distinct(), "_hash", "left_anti").drop("_hash")


def gc(refs: DataFrame, rows: DataFrame, chunks: DataFrame, blobs: DataFrame, now: int, grace: int) -> tuple[DataFrame, DataFrame]:
    """The change of references, and the blobs to delete under the references after it."""
    listed = rows.groupBy("ws").agg(F.bool_and("parseable").alias("ok")).where("ok").select("ws")
    kept = _live(rows, chunks)
    # listed workspaces refer to exactly what is live, the others to what they did
    after = refs.join(listed, "ws", "left_anti").select(packed(F.col("hash")).alias("hash")).unionByName(kept.select("hash"))
    return delta_packed(refs, kept, listed.withColumn("good", F.lit(True))), sweep_packed(blobs, after, now, grace)


def stale_temporaries(names: DataFrame, now: int, age: int = 60) -> DataFrame:
    """names: name, mtime. Left-over temporary files."""
    return names.where(F.col("name").startswith(".tmp-") & (F.col("mtime") < now - age))


def gc_report(refs: DataFrame, rows: DataFrame, delta: DataFrame, blobs: DataFrame, swept: DataFrame) -> DataFrame:
    """One row with what a collection did: workspaces seen and skipped, references deleted and added, blobs and bytes swept."""
    seen = rows.groupBy("ws").agg(F.bool_and("parseable").alias("ok")).agg(F.count(F.lit(1)).alias("workspaces"), F.count_if(~F.col("ok")).alias("skipped"))
    moved = delta.agg(F.count_if(F.col("action") == "delete").alias("refs_deleted"), F.count_if(F.col("action") == "add").alias("refs_added"))
    gone = swept.agg(F.count(F.lit(1)).alias("blobs_deleted"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_deleted"))
    kept = blobs.agg(F.count(F.lit(1)).alias("blobs")).join(refs.agg(F.count(F.lit(1)).alias("refs")))
    return seen.join(moved).join(gone).join(kept)  # of one row each
