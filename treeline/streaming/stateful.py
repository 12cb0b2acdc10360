"""Streams whose state outlives a restart: change windows with kicks, followers that retry and poll, silence, and fan-out.

Windows, followers and silence are processors over one key each, with their state and timers in the state store (RocksDB is
needed); what a micro-batch did is committed with its offsets, so a restart goes on from there. Windows run on the time in
the rows, so that replayed events make the windows they made before; followers and silence run on the clock. Fan-out keeps
its listeners as a table for each micro-batch, made from that of the one before, so a batch run again gives the same."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from treeline.streaming.feeds import CAP, POLL_DOWN, POLL_LIVE, QUIET, RETRY, latest

#: Fixed value, in seconds: silence after which a listener is asked, and is given up after as much again.
SILENCE = 45.0


class _Keyed(StatefulProcessor):
    """One timer a key."""

    def _wake_at(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(int(at))

    def close(self) -> None:
        pass


class Windows(_Keyed):
    """Windows of changes: see debounced."""

    COLUMNS = ("ws", "opened", "last", "n", "capped", "runs")

    def __init__(self, quiet: float, cap: float):
        self.quiet, self.cap = int(quiet * 1000), int(cap * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened bigint, last bigint, n bigint, runs boolean")

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=list(self.COLUMNS))
            for c in ("opened", "last"):
                out[c] = pd.to_datetime(out[c], unit="ms")
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(pd.Timestamp(at).value // 10**6), k, kind) for frame in rows for k, (at, kind) in enumerate(zip(frame["at"], frame["kind"], strict=True)))
        cur, out = (list(self.window.get()) if self.window.exists() else None), []
        for at, _, kind in events:
            if cur and at - cur[1] >= self.quiet:
                out.append((key[0], *cur[:3], False, cur[3]))
                cur = None
            if cur is None and kind == "kick":
                out.append((key[0], at, at, 1, False, True))  # nothing is being written: at once
                continue
            cur = [at, at, 1, kind != "state"] if cur is None else [cur[0], at, cur[2] + 1, cur[3] or kind != "state"]
            if cur[1] - cur[0] >= self.cap:
                out.append((key[0], *cur[:3], True, cur[3]))
                cur = None
        if cur:
            self.window.update(tuple(cur))
        elif self.window.exists():
            self.window.clear()
        self._wake_at(cur[1] + self.quiet if cur else None)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists():
            opened, last, n, runs = self.window.get()
            self.window.clear()
            yield from self._frame([(key[0], opened, last, n, False, runs)])


def debounced(events: DataFrame, quiet: float = QUIET, cap: float = CAP, late: str = "0 seconds") -> DataFrame:
    """events: a stream of ws, at (timestamp), kind: fs (a change), state (one of this library's own files), kick (a wanted
    cycle from elsewhere). Gives windows as folds.debounce does: one ends when nothing comes for `quiet`, or with the first
    event `cap` or more after it opened, and runs a cycle if some event was not of kind state. A kick without an open window
    is a window of its own at once; inside one it waits with the rest. Rows of any workspace move the clock, for instance
    of a clock's own."""
    rows = events.select("ws", "at", "kind").withWatermark("at", late)
    schema = "ws bigint, opened timestamp, last timestamp, n bigint, capped boolean, runs boolean"
    return rows.groupBy("ws").transformWithStateInPandas(Windows(quiet, cap), schema, "Append", "EventTime")


#: Brings a copy up to date at least to a head (0: whichever is newest) and gives the number of the head it has now; None, or
#: an exception, where that failed. Runs inside tasks, and again for a micro-batch that is run again.
Pull = Callable[[str, int], int | None]


#: The key of a clock's rows, which no workspace or listener has.
_TICK = ""


def ticking(rows: DataFrame, key: str) -> DataFrame:
    """rows with those of a clock, a second each, under a key of their own: timers that ran out are looked at although
    nothing comes, right after a restart too."""
    ticks = rows.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(_TICK).alias(key))
    return rows.unionByName(ticks, allowMissingColumns=True)


class Follower(_Keyed):
    """One workspace's copy: see followed."""

    COLUMNS = ("ws", "seq", "why", "ok")

    def __init__(self, pull: Pull, retry: float, down: float, live: float):
        self.pull, self.retry, self.down, self.live = pull, retry, down, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "seq bigint")
        self.due = handle.getValueState("due", "seq bigint")
        self.feed = handle.getValueState("feed", "live boolean")

    def _try(self, ws: str, seq: int, why: str, now: int) -> Iterator[pd.DataFrame]:
        try:
            got = self.pull(ws, seq)
        except Exception:  # whatever failed is tried again
            got = None
        known = self.known.get()[0] if self.known.exists() else 0
        if got is None:
            self.due.update((seq,))
        else:
            self.known.update((max(known, int(got)),))
            if self.due.exists():
                self.due.clear()
        self._sleep(now)
        yield pd.DataFrame([(ws, seq if got is None else int(got), why, got is not None)], columns=list(self.COLUMNS))

    def _sleep(self, now: int) -> None:
        live = self.feed.exists() and self.feed.get()[0]
        wait = self.live if live else self.down
        self._wake_at(now + 1000 * (min(wait, self.retry) if self.due.exists() else wait))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == _TICK:
            return
        newest, now = 0, timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            newest = max(newest, int(frame["seq"].fillna(0).max()))
            states = frame["live"].dropna()
            if len(states):
                self.feed.update((bool(states.iloc[-1]),))
        known = self.known.get()[0] if self.known.exists() else 0
        if newest > known:
            yield from self._try(key[0], newest, "hint", now)
        else:  # an echo of what is here, or news of the feed
            self._sleep(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.exists()
        yield from self._try(key[0], self.due.get()[0] if due else 0, "retry" if due else "poll", timerValues.getCurrentProcessingTimeInMs())


def followed(hints: DataFrame, pull: Pull, retry: float = RETRY, down: float = POLL_DOWN, live: float = POLL_LIVE) -> DataFrame:
    """hints: a stream of ws, seq (of a head; null in other rows), live (whether the feed is up; null where nothing is said).
    Keeps a copy of every workspace that a row has named: all hints of a micro-batch are one pull of the newest, unless the
    copy has it (an echo); a failed pull is tried again after `retry` seconds though nothing comes; and without news for
    `down` or `live` seconds, as the feed is, the head is polled. A row for each pull: ws, seq, why (hint, retry or poll), ok.
    What is known, due and the feed's state is in the state store, so a restart forgets none of it; a clock's rows wake it."""
    processor = Follower(pull, retry, down, live)
    return ticking(hints.select("ws", "seq", "live"), "ws").groupBy("ws").transformWithStateInPandas(processor, "ws string, seq bigint, why string, ok boolean", "Append", "ProcessingTime")


class Quiet(_Keyed):
    """One listener's silence: see watched."""

    def __init__(self, limit: float):
        self.limit = int(limit * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "asked boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] != _TICK:
            self.asked.update((False,))
            self._wake_at(timerValues.getCurrentProcessingTimeInMs() + self.limit)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        dead = bool(self.asked.get()[0])
        if dead:
            self.asked.clear()
        else:
            self.asked.update((True,))
            self._wake_at(timerValues.getCurrentProcessingTimeInMs() + self.limit)
        yield pd.DataFrame([(key[0], "dead" if dead else "ping")], columns=["listener", "action"])


def watched(messages: DataFrame, limit: float = SILENCE) -> DataFrame:
    """messages: a stream of listener. A row (listener, action) for each listener that was silent for `limit` seconds: ping;
    and for as long again without an answer: dead, after which it is forgotten until it speaks."""
    return ticking(messages.select("listener"), "listener").groupBy("listener").transformWithStateInPandas(Quiet(limit), "listener string, action string", "Append", "ProcessingTime")


_LISTENER = "user_name string, ws string, sent bigint"


def fan_out(events: DataFrame, heads: Callable[[SparkSession], DataFrame], roles: Callable[[SparkSession], DataFrame], send: Callable[[DataFrame, int], None], state: str, checkpoint: str, **trigger):
    """events: a stream of kind (subscribe, leave or hint), user_name, ws, seq. Sends rows user_name, ws, type, seq in every
    micro-batch: to new listeners the present head (head_now, 0 where there is none), to the others the newest hint above
    what they have (head_changed), and close to those who have no role any more. heads (ws, seq) and roles (ws, user_name)
    are read anew in every micro-batch; heads are read after the listeners are known, so no commit is both unhinted and
    unreported. Where roles can't be read, nobody is closed and the next batch looks again. send gets the rows and the
    batch's number, and may get a batch again."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        path = f"{state}/{number - 1}"
        before = spark.read.schema(_LISTENER).parquet(path) if number and _exists(spark, path) else spark.createDataFrame([], _LISTENER)
        rows = rows.persist()
        left = rows.where("kind = 'leave'").select("user_name", "ws").distinct()
        asked = rows.where("kind = 'subscribe'").select("user_name", "ws").distinct()
        now = before.join(left, ["user_name", "ws"], "left_anti").join(asked, ["user_name", "ws"], "left_anti").unionByName(asked.withColumn("sent", F.lit(None).cast("bigint")))
        try:
            may = roles(spark).select("ws", "user_name").distinct().withColumn("may", F.lit(True)).persist()
            may.count()
        except Exception:  # not a sign that nobody has a role
            may = now.select("ws", "user_name").distinct().withColumn("may", F.lit(True))
        now = now.join(may, ["ws", "user_name"], "left").join(heads(spark).groupBy("ws").agg(F.max("seq").alias("head")), "ws", "left")
        now = now.join(latest(rows.where("kind = 'hint'").select(F.col("ws").alias("workspace"), "seq")).withColumnsRenamed({"workspace": "ws", "seq": "hint"}), "ws", "left")
        kind = F.when(F.col("may").isNull(), "close").when(F.col("sent").isNull(), "head_now").when(F.col("hint") > F.col("sent"), "head_changed")
        seq = F.when(kind == "head_now", F.greatest(F.coalesce("head", F.lit(0)), F.coalesce("hint", F.lit(0)))).when(kind == "head_changed", F.col("hint"))
        now = now.select("user_name", "ws", "sent", kind.alias("type"), seq.cast("bigint").alias("seq")).persist()
        now.where("coalesce(type, '') <> 'close'").select("user_name", "ws", F.coalesce("seq", "sent").alias("sent")).write.mode("overwrite").parquet(f"{state}/{number}")
        send(now.where("type is not null").select("user_name", "ws", "type", "seq"), number)
        for df in (rows, may, now):
            df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clock(spark: SparkSession, ws: int = -1, rows_per_second: int = 1) -> DataFrame:
    """A stream to unite with events of debounced, so that its windows end though no workspace changes."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(F.lit(ws).cast("bigint").alias("ws"), F.col("timestamp").alias("at"), F.lit("state").alias("kind"))


def seconds(at: datetime.datetime) -> float:
    """A window's time as seconds, to compare with those of folds.debounce."""
    return at.replace(tzinfo=datetime.UTC).timestamp()
