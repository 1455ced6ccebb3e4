"""The stream of sessions: late lines, bounds, erasure, failed sinks, a new start."""

from __future__ import annotations

import datetime as dt
import time

import pytest

from memlattice.streaming import retain, sessions

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "session_key string, msg_key string, line string, uid string, is_bot boolean, ts timestamp, generation long"


def said(uid, text):
    return f'<msg uid="{uid}" name="{uid}">{text}</msg>'


def talk(session, n, at=0.0, uid="u", answered=True, generation=0, tag="q"):
    """n rounds of a person and the bot, one a minute."""
    out = []
    for i in range(n):
        t = T0 + dt.timedelta(seconds=at + 60 * i)
        out.append((session, f"{tag}{at}{i}", said(uid, f"{tag}{i}"), uid, False, t, generation))
        if answered:
            out.append((session, f"a{tag}{at}{i}", f'<msg self="true">{tag}{i}</msg>', "bot", True, t + dt.timedelta(seconds=1), 0))
    return out


class Feed:
    """Micro-batches, one for each list of rows."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, f"{folder}", schema, 0

    def put(self, *parts):
        for rows in parts:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/{self.n:04d}")
            self.n += 1
        return self

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Feed(spark, tmp_path / "in", SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def ran(batches, tmp_path, name="ck", write=None):
    got = []
    q = retain.sink(batches, write or (lambda df, _: got.extend(df.collect())), f"{tmp_path}/{name}", {"availableNow": True})
    assert q.awaitTermination(120) and q.exception() is None
    return got, q


def told(rows):
    return sorted((r["session_key"], r["reason"], r["rounds"], len(r["lines"])) for r in rows)


def test_rounds_idle_and_late_lines(feed, tmp_path):
    """The second session's lines come 10 minutes, then hours, behind the first one's: none is lost."""
    feed.put(talk("qq:dm:1", 6, 7200), talk("qq:gm:2", 2, 6600), talk("qq:dm:3", 1, 0), talk("qq:dm:1", 1, 12000))
    got, q = ran(sessions.retained(feed.stream(), shards=1, timers=False), tmp_path)
    assert told(got) == [("qq:dm:1", "rounds", 5, 5), ("qq:dm:3", "idle", 1, 1), ("qq:gm:2", "rounds", 1, 1), ("qq:gm:2", "rounds", 1, 1)]
    assert sum(p["numRowsDroppedByWatermark"] for p in (s for x in q.recentProgress for s in x["stateOperators"])) == 0


def test_sessions_above_the_bound_flush_and_leave(feed, tmp_path):
    feed.put(talk("qq:dm:1", 2), talk("qq:dm:1", 1, 500, "u", answered=False), talk("qq:dm:2", 1, 10), talk("qq:dm:1", 5, 600, tag="n"))
    got, _ = ran(sessions.retained(feed.stream(), limit=1, shards=1, timers=False), tmp_path)
    # the first session leaves with its unanswered line, the second when the first comes back, which then starts anew
    assert told(got) == [("qq:dm:1", "evicted", 3, 3), ("qq:dm:1", "rounds", 5, 5), ("qq:dm:2", "evicted", 1, 1)]
    assert [r["history"] for r in got if r["reason"] == "rounds"] == [[]]


def test_sessions_leave_after_a_while(feed, tmp_path):
    feed.put(talk("qq:dm:1", 1, answered=False), talk("qq:dm:2", 1, 5000), talk("qq:dm:1", 1, 5100))
    got, _ = ran(sessions.retained(feed.stream(), keep_s=4000, shards=1, timers=False), tmp_path)
    assert told(got) == [("qq:dm:1", "left", 1, 1)]


def test_a_shard_that_hears_nothing_flushes_by_the_wall(spark, feed, tmp_path):
    feed.put(talk("qq:dm:1", 1))
    got = []
    q = retain.sink(sessions.retained(feed.stream(), idle_s=1, shards=1), lambda df, _: got.extend(df.collect()), f"{tmp_path}/ck", {"processingTime": "1 second"})
    end = time.time() + 60
    while not got and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert told(got) == [("qq:dm:1", "idle", 1, 1)]


def test_group_batch_keeps_other_members_after_erase(spark, feed, tmp_path):
    """An erasure reaches waiting lines, history and cache of every session; lines read before it do not come back, later ones stay."""
    gone = Feed(spark, tmp_path / "gone", "uid string, generation long")
    before = talk("qq:gm:1", 1, 0, "u", tag="old") + talk("qq:gm:1", 1, 70, "v", tag="other") + talk("qq:dm:9", 1, 5, "u", tag="alone")
    after = talk("qq:gm:1", 1, 200, "u", tag="stale") + talk("qq:gm:1", 1, 300, "u", tag="new", generation=1) + talk("qq:gm:1", 1, 400, "v", tag="last") + talk("qq:dm:9", 1, 300, "u", tag="back", generation=1)
    feed.put(before, after)
    gone.put([("nobody", 1)], [("u", 1), ("u", 0), (None, 2)])
    got, _ = ran(sessions.retained(feed.stream(), group=3, private=1, shards=3, erasures=gone.stream(), timers=False), tmp_path)
    by = {r["session_key"]: r for r in got if r["session_key"] != "qq:dm:9" or "back" in str(r["lines"])}
    text = str([by["qq:gm:1"][c] for c in ("lines", "bot_lines", "history")])
    assert said("v", "other0") in by["qq:gm:1"]["lines"] and said("u", "new0") in by["qq:gm:1"]["lines"]
    assert said("u", "old0") not in text and said("u", "stale0") not in text
    assert by["qq:gm:1"]["participants"][0] == "v"  # the batch went over to who is left
    assert said("u", "alone0") not in str(by["qq:dm:9"]["lines"]) + str(by["qq:dm:9"]["history"])


def test_redacted_state():
    s = {"cache": [{"key": "1", "line": said("u", "x"), "uid": "u", "bot": False, "ts": 0.0, "used": True}], "rounds": 2, "lines": [said("u", "x"), said("v", 'says uid="u">')], "bot_lines": ["b"], "history": [said("u", "h"), "k"], "people": ["u", "v"], "first": 1.0, "last": 2.0}
    out = sessions.redacted(s, "u")
    assert (out["lines"], out["bot_lines"], out["history"], out["people"], out["cache"], out["rounds"]) == ([said("v", 'says uid="u">')], ["b"], ["k"], ["v"], [], 2)
    assert sessions.redacted(out, "v")["rounds"] == 0  # nobody is left


def test_without_user(spark):
    t = "session_key string, lines array<string>, bot_lines array<string>, history array<string>, participants array<string>, user_id string"
    rows = [("a", [said("u", "x"), said("v", "y")], [], [said("u", "old secret"), "k"], ["u", "v"], "u"), ("b", [said("u", "x")], ["bot"], [], ["u", "v"], "v"), ("c", [said("u", "x")], ["bot"], [], ["u"], "u"), ("d", [said("u", "x")], [], [], ["u", "v"], "u")]
    got = {r["session_key"]: r for r in retain.without_user(spark.createDataFrame(rows, t), "u").collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["lines"], got["a"]["history"], got["a"]["user_id"], got["b"]["bot_lines"], got["b"]["user_id"]) == ([said("v", "y")], ["k"], "v", ["bot"], "v")


def test_a_failing_sink_loses_no_batch(feed, tmp_path):
    """What failed goes alone before later batches; after it a new start takes waiting batches in the order of their first times."""
    feed.put(talk("qq:gm:1", 1, 0), talk("qq:gm:2", 1, 10), talk("qq:gm:3", 1, 20), talk("qq:gm:4", 1, 30))
    calls, written = [], []

    def write(df, epoch, again):
        keys = sorted(r["session_key"] for r in df.collect())
        calls.append((epoch, again, keys))
        if keys == ["qq:gm:2"] and epoch < 3:
            raise OSError("down")
        written.extend(keys)

    ran(sessions.retained(feed.stream(), shards=1, timers=False), tmp_path, write=sessions.deliver(write, f"{tmp_path}/failed"))
    assert sorted(written) == ["qq:gm:1", "qq:gm:2", "qq:gm:3", "qq:gm:4"]
    assert [c for c in calls if c[2] == ["qq:gm:2"]] == [(1, False, ["qq:gm:2"]), (2, True, ["qq:gm:2"]), (3, True, ["qq:gm:2"])]


def test_a_new_start_takes_waiting_batches(spark, feed, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    kind = "session_key string, first_ts timestamp, last_ts timestamp, lines array<string>, bot_lines array<string>, history array<string>, participants array<string>, rounds int, failed boolean"
    waiting = spark.createDataFrame([("qq:dm:1", at(-50), at(-40), ["second"], [], ["no"], ["v"], 2, False), ("qq:dm:1", at(-90), at(-80), ["first"], [], ["h"], ["u"], 2, False), ("qq:dm:2", at(-9), at(-8), ["alone"], [], [], ["w"], 1, True)], kind)
    feed.put(talk("qq:dm:1", 1, 0, "x"), talk("qq:dm:1", 1, 100, "x"))
    got, _ = ran(sessions.retained(feed.stream(), shards=2, waiting=waiting, timers=False), tmp_path)
    assert len(got) == 1 and (got[0]["rounds"], got[0]["lines"][:2], got[0]["history"], got[0]["participants"]) == (5, ["first", "second"], ["h"], ["u", "v", "x"])
    assert got[0]["first_ts"] == at(-90)
