"""Streams with state: windows against their batch form, followers over a restart, silence, and fan-out with changing roles."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from treeline.operators import folds
from treeline.streaming import stateful


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def write(folder, name, rows, at=None):
    folder.mkdir(exist_ok=True)
    temporary = folder.parent / f"{name}.tmp"
    temporary.write_text("".join(json.dumps(r) + "\n" for r in rows))
    if at:  # files come in the order of their times
        os.utime(temporary, (at, at))
    temporary.rename(folder / name)


def until(query, seen, done, most=45):
    end = time.time() + most
    while time.time() < end:
        assert not query.exception(), query.exception()
        if done(list(seen)):
            return
        time.sleep(0.2)
    raise AssertionError(seen)


def collected(df, checkpoint, every="200 milliseconds"):
    """A running query and the rows it gives."""
    rows = []

    def batch(out, _):
        rows.extend(tuple(r) for r in out.collect())

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", str(checkpoint)).trigger(processingTime=every).start(), rows


def test_windows_are_the_batch_form(rocks, tmp_path):
    rng, at, rows = random.Random(2), 1_700_000_000_000, []
    for k in range(150):
        at += rng.choice([20, 40, 90, 150] * 12 + [700, 2600])
        rows.append((rng.randrange(3), k, at, rng.choice(["fs", "fs", "state", "state", "kick"])))
    source = tmp_path / "in"
    for n, lo in enumerate(range(0, len(rows), 30)):
        write(source, f"{n:02}.json", [{"ws": w, "ms": t, "kind": kind} for w, _, t, kind in rows[lo : lo + 30]], 1000 + n)
    for n in (90, 91):  # others move the clock
        write(source, f"{n}.json", [{"ws": -1, "ms": at + 100_000 + n, "kind": "state"}], 1000 + n)
    events = rocks.readStream.schema("ws bigint, ms bigint, kind string").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
    events = events.select("ws", F.timestamp_millis("ms").alias("at"), "kind")
    got = []

    def batch(out, _):
        got.extend((r.ws, round(stateful.seconds(r.opened) * 1000), round(stateful.seconds(r["last"]) * 1000), r.n, r.capped, r.runs) for r in out.collect())

    query = stateful.debounced(events).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch_rows = rocks.createDataFrame([(w, i, t, kind != "state", kind == "kick") for w, i, t, kind in rows], "ws bigint, id bigint, at bigint, wanted boolean, kick boolean")
    want = [tuple(r) for r in folds.debounce(batch_rows, 500, 2000).collect()]
    assert sorted(r for r in got if r[0] >= 0) == sorted(want)
    assert {r[4] for r in want} == {True, False} and any(r[3] == 1 and r[5] for r in want)


def test_kicks_in_batches(spark):
    def windows(*rows):
        df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "ws bigint, id bigint, at bigint, wanted boolean, kick boolean")
        return sorted(tuple(r)[1:] for r in folds.debounce(df, 500, 2000).collect())

    assert windows((0, False, True)) == [(0, 0, 1, False, True)]
    # at once while nothing is open, so the change after it opens a window of its own
    assert windows((0, False, True), (100, True, False)) == [(0, 0, 1, False, True), (100, 100, 1, False, True)]
    # inside a window it waits and makes it run
    assert windows((0, False, False), (100, False, True), (300, False, False)) == [(0, 300, 3, False, True)]
    assert windows((0, False, False), (600, False, True)) == [(0, 0, 1, False, False), (600, 600, 1, False, True)]


def test_followers_retry_though_nothing_comes(rocks, tmp_path):
    source, broken, log = tmp_path / "in", tmp_path / "broken", tmp_path / "log"
    broken.write_text("")
    log.mkdir()
    source.mkdir()
    hints = rocks.readStream.schema("ws string, seq bigint, live boolean").json(str(source))

    def pull(ws, seq):
        if broken.exists():
            raise OSError("away")
        (log / f"{ws}-{seq}-{time.time_ns()}").write_text("")
        return max(seq, 5)

    write(source, "a.json", [{"ws": "w", "seq": 3, "live": True}, {"ws": "w", "seq": 4}])
    df = stateful.followed(hints, pull, retry=0.5, down=60, live=60)
    query, rows = collected(df, tmp_path / "cp")
    until(query, rows, lambda r: len(r) >= 2)
    assert rows[0] == ("w", 4, "hint", False) and set(rows[1:]) == {("w", 4, "retry", False)}  # hints of one batch are one pull
    query.stop()
    # what failed is in the state store: a new query goes on from there, and no hint comes
    broken.unlink()
    query, rows = collected(df, tmp_path / "cp")
    until(query, rows, lambda r: r)
    assert rows == [("w", 5, "retry", True)] and len(list(log.iterdir())) == 1
    write(source, "b.json", [{"ws": "w", "seq": 5}])  # an echo of what the copy has
    write(source, "c.json", [{"ws": "v", "seq": 1}])
    until(query, rows, lambda r: ("v", 5, "hint", True) in r)
    query.stop()
    assert not [r for r in rows[1:] if r[0] == "w"]


def test_followers_poll_as_the_feed_is(rocks, tmp_path):
    source = tmp_path / "in"
    write(source, "a.json", [{"ws": "down", "live": False}, {"ws": "up", "live": True}])
    hints = rocks.readStream.schema("ws string, seq bigint, live boolean").json(str(source))
    query, rows = collected(stateful.followed(hints, lambda ws, seq: 7, down=0.5, live=3600), tmp_path / "cp")
    until(query, rows, lambda r: len(r) >= 2)
    assert set(rows) == {("down", 7, "poll", True)}
    write(source, "b.json", [{"ws": "down", "live": True}, {"ws": "up", "live": False}])
    until(query, rows, lambda r: ("up", 7, "poll", True) in r)
    n = sum(r[0] == "down" for r in rows)
    time.sleep(2)
    query.stop()
    assert sum(r[0] == "down" for r in rows) <= n + 1


def test_silence(rocks, tmp_path):
    source = tmp_path / "in"
    write(source, "a.json", [{"listener": "x"}, {"listener": "y"}])
    messages = rocks.readStream.schema("listener string").json(str(source))
    query, rows = collected(stateful.watched(messages, 1.5), tmp_path / "cp")
    until(query, rows, lambda r: ("x", "ping") in r and ("y", "ping") in r)
    write(source, "b.json", [{"listener": "y"}])  # answers
    until(query, rows, lambda r: ("x", "dead") in r and r.count(("y", "ping")) == 2)
    query.stop()
    assert rows.index(("x", "ping")) < rows.index(("x", "dead")) and rows.count(("x", "ping")) == 1


def test_fan_out(spark, tmp_path):
    source, sent, now = tmp_path / "in", {}, {}
    source.mkdir()
    events = spark.readStream.schema("kind string, user_name string, ws string, seq bigint").json(str(source))

    def roles(s):
        if now["roles"] is None:
            raise OSError("away")
        return s.createDataFrame(now["roles"], "ws string, user_name string")

    def send(df, number):
        sent[number] = sorted(tuple(r) for r in df.collect())

    def step(rows, allowed, head):
        now.update(roles=allowed, heads=head)
        write(source, f"{len(list(source.iterdir()))}.json", rows)
        stateful.fan_out(events, lambda s: s.createDataFrame(now["heads"], "ws string, seq bigint"), roles, send, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(60)
        return sent[max(sent)]

    both, head = [("w", "ann"), ("w", "bob")], [("w", 4), ("w", 3)]
    subscribe = [{"kind": "subscribe", "user_name": u, "ws": "w"} for u in ("ann", "bob", "eve")]
    assert step(subscribe, both, head) == [("ann", "w", "head_now", 4), ("bob", "w", "head_now", 4), ("eve", "w", "close", None)]
    hint = [{"kind": "hint", "ws": "w", "seq": n} for n in (5, 6, 4)]
    assert step(hint, both, head) == [("ann", "w", "head_changed", 6), ("bob", "w", "head_changed", 6)]
    assert step([{"kind": "hint", "ws": "w", "seq": 6}], both, head) == []  # nothing above what they have
    assert step([{"kind": "hint", "ws": "w", "seq": 7}], None, head) == [("ann", "w", "head_changed", 7), ("bob", "w", "head_changed", 7)]  # not to be read is not revoked
    assert step([{"kind": "hint", "ws": "w", "seq": 8}], both[:1], head) == [("ann", "w", "head_changed", 8), ("bob", "w", "close", None)]
    assert step([{"kind": "hint", "ws": "w", "seq": 9}, {"kind": "leave", "user_name": "ann", "ws": "w"}], both, head) == []
    assert step([{"kind": "subscribe", "user_name": "ann", "ws": "v"}], [("v", "ann")], head) == [("ann", "v", "head_now", 0)]
