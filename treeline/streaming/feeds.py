"""Feeds of head hints and change events. A hint only says: look again; so batches recompute, and no state must be exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in seconds: quiet gap and cap of a change window, first and most of reconnect waits, a stable connection.
QUIET, CAP, WAIT, MOST_WAIT, STABLE = 0.5, 2.0, 1, 30, 90


def parse_hints(lines: DataFrame, ws: str | None = None) -> DataFrame:
    """value: JSON text. type, workspace and seq of head hints, of one workspace if given; other lines are dropped."""
    rows = lines.select(F.from_json("value", "type string, workspace string, seq bigint").alias("x")).select("x.*")
    rows = rows.where(F.col("type").isin("head_now", "head_changed") & F.col("workspace").isNotNull() & F.col("seq").isNotNull())
    return rows.where(F.col("workspace") == ws) if ws else rows


def fresh_hints(hints: DataFrame) -> DataFrame:
    """Batch form of echo suppression: hints above all that came before in their workspace. hints: ws, id, seq."""
    before = Window.partitionBy("ws").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return hints.withColumn("known", F.coalesce(F.max("seq").over(before), F.lit(0))).where("seq > known").drop("known")


def latest(hints: DataFrame) -> DataFrame:
    """The newest seq of each workspace; on a stream in update mode."""
    return hints.groupBy("workspace").agg(F.max("seq").alias("seq"))


def catch_up(heads: DataFrame, hints: DataFrame) -> DataFrame:
    """What a new listener gets: the present head of each workspace, then the changes above it. heads, hints: ws, seq."""
    now = heads.groupBy("ws").agg(F.max("seq").alias("seq"))
    later = hints.select("ws", "seq").join(now.withColumnRenamed("seq", "now"), "ws").where("seq > now").select("ws", "seq").distinct()
    return now.withColumn("type", F.lit("head_now")).unionByName(later.withColumn("type", F.lit("head_changed")))


def allowed(hints: DataFrame, roles: DataFrame) -> DataFrame:
    """Hints for those who have a role now: user_name, ws, seq."""
    return hints.join(roles.select("ws", "user_name"), "ws")


def follow(hints: DataFrame, cycle: Callable[[str, int], None], checkpoint: str, known: dict[str, int] | None = None, **trigger):
    """Runs cycle(workspace, seq) for the newest hint of each workspace that a micro-batch brings, unless that seq is known;
    hints that come during a cycle are one follow-up. known may be read and is kept up to date."""
    known = {} if known is None else known

    def batch(rows: DataFrame, _: int) -> None:
        for r in latest(rows).toLocalIterator():
            if r.seq > known.get(r.workspace, 0):
                cycle(r.workspace, r.seq)
                known[r.workspace] = r.seq

    return hints.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def waits(outcomes: list[float]) -> list[int]:
    """Seconds waited after connections that lasted so long: doubling to MOST_WAIT, from the start after a stable one."""
    out, wait = [], WAIT
    for lasted in outcomes:
        if lasted >= STABLE:
            wait = WAIT
        out.append(wait)
        wait = min(2 * wait, MOST_WAIT)
    return out


def keepalive(silences: list[float], limit: float = 45.0) -> list[str]:
    """What a listener does in each interval of silence: nothing, ping, or give up when a ping had no answer."""
    out, asked = [], False
    for s in silences:
        if s < limit:
            out.append("none")
            asked = False
        else:
            out.append("dead" if asked else "ping")
            asked = True
    return out


#: Fixed values, in seconds: how often heads are polled without and with a live feed, and when a failed cycle is tried again.
POLL_DOWN, POLL_LIVE, RETRY = 2, 300, 5


def polls(states: DataFrame) -> DataFrame:
    """states: ws, at, until, live (intervals of a feed's state, in seconds). ws, at: when heads are polled, in each interval
    from its start on."""
    step = F.when(F.col("live"), POLL_LIVE).otherwise(POLL_DOWN)
    return states.where("until > at").select("ws", F.explode(F.sequence(F.col("at"), F.col("until") - 1, step.cast("bigint"))).alias("at"))


def retries(cycles: DataFrame) -> DataFrame:
    """cycles: ws, at, ok, and id if there is one, by which those of one time are in order. Adds retry_at: for failed ones after
    which nothing comes within RETRY seconds, when they are tried again although all is quiet."""
    order = ["at", "id"] if "id" in cycles.columns else ["at"]
    later = F.lead("at").over(Window.partitionBy("ws").orderBy(*order))
    quiet = ~F.col("ok") & (F.coalesce(later, F.lit(2**62)) - F.col("at") > RETRY)
    return cycles.withColumn("retry_at", F.when(quiet, F.col("at") + RETRY))


def periodic(spark, job: Callable[[int], None], checkpoint: str, every: str = "1 hour", **rate):
    """Runs job(number) at an interval, as a stream of a clock; the first run comes after one interval."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).options(**rate).load()

    def batch(_: DataFrame, number: int) -> None:
        if number:
            job(number)

    return clock.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
