"""The retain stream's state: a bounded set of sessions, late lines kept, people erased while it runs.

Sessions are dealt to ``SHARDS`` keys of Spark's state. A shard holds its sessions' lines and waiting batches by session,
an index of when each was last heard (in event time and on the wall), and the generation of each erased person. So an
erasure, which names a person and no session, is one row for each shard, and the number of sessions is bounded by the shard.

Time is kept in the state, not by a watermark: a watermark is one for all sessions and would drop the lines of a slow one.
A shard's clock is the latest time it has seen. A session is idle ``idle_s`` behind that clock, or, where a shard hears
nothing at all, by a timer on the wall; its waiting batch is then flushed. It leaves the state ``keep_s`` behind the clock, or
earlier as the longest unheard of more than ``limit`` sessions of its shard; what it still holds, unanswered lines too, is
flushed first. A late line is taken by its session like any other, in the order in which micro-batches bring it.

Erasure redacts the waiting batch (lines, bot lines, history), the cache and the people of every session of the shard, hands a
batch over to the next person, and drops one that nobody is left in. Each message carries the generation of its person when it
was read: one older than the person's erasure is dropped, so what was under way does not come back; newer ones are kept.

A stream that starts anew, under another checkpoint, takes the batches that wait in a table as its first state, merged by
session in the order of their first times. ``deliver`` is a sink that loses no batch: what cannot be written is put into a
table of failed batches, each tried again by itself before later batches.

Defined cases: a message without a session key or time is left out; one without a message key is a line of its own; a message that comes
again under its key replaces the former one; an erasure without a person or generation is left out, and of several the greatest
generation counts; within a micro-batch erasures act first.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .retain import OUT, _round, empty_state, flush, merged, step

#: Keys of the state, and sessions that one of them holds.
SHARDS, LIMIT = 64, 200
IDLE_S, KEEP_S = 1800, 7 * 86400
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What goes into the state: messages, and erasures (uid, generation) for every shard.
IN = "shard int, erase boolean, session_key string, msg_key string, line string, uid string, is_bot boolean, ts timestamp, generation long"


def names(line: str, uid: str) -> bool:
    """Whether a line's head, before its first '>', names the person."""
    return f'uid="{uid}"' in line.partition(">")[0]


def redacted(s: dict, uid: str) -> dict:
    """The state of a session without a person."""
    out = s | {c: [x for x in s[c] if not names(x, uid)] for c in ("lines", "bot_lines", "history")}
    out["cache"] = [x for x in s["cache"] if x["uid"] != uid and not names(x["line"], uid)]
    out["people"] = [p for p in s["people"] if p != uid]
    if not (out["lines"] or out["bot_lines"]) or not out["people"]:
        out |= {k: v for k, v in empty_state().items() if k != "cache"}
    return out


class Sessions(StatefulProcessor):
    """A shard's sessions."""

    def __init__(self, group: int, private: int, idle_s: float, keep_s: float, limit: int, timers: bool) -> None:
        self.group, self.private, self.idle_s, self.keep_s, self.limit, self.timers = group, private, idle_s, keep_s, limit, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "session string", "state string")
        self.erased = handle.getMapState("erased", "uid string", "generation long")
        self.index = handle.getValueState("index", "heard string")  # {session: [event time, wall time in ms, batch waits]}, longest unheard first

    def close(self) -> None:
        pass

    # -- state -----------------------------------------------------------------------------------------------------

    def _index(self) -> dict[str, list]:
        return json.loads(self.index.get()[0]) if self.index.exists() else {}

    def _load(self, session: str) -> dict:
        return json.loads(self.held.getValue((session,))[0]) if self.held.containsKey((session,)) else empty_state()

    def _save(self, session: str, s: dict, index: dict, heard: float, wall: int) -> None:
        self.held.updateValue((session,), (json.dumps(s),))
        index.pop(session, None)
        index[session] = [heard, wall, bool(s["rounds"])]

    def _leave(self, session: str, index: dict, reason: str) -> list[dict]:
        """What a session still holds as a batch; the session is gone."""
        s = self._load(session)
        _round(s)
        self.held.removeKey((session,))
        del index[session]
        return [flush(session, s, reason)] if s["rounds"] else []

    def _done(self, index: dict, wall: int) -> None:
        self.index.update((json.dumps(index),))
        if not self.timers:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if any(at[2] for at in index.values()):
            self.handle.registerTimer(int(wall + self.idle_s * 1000))

    # -- events ----------------------------------------------------------------------------------------------------

    def _erase(self, uid: str, generation: int, index: dict) -> None:
        if self.erased.containsKey((uid,)) and self.erased.getValue((uid,))[0] >= generation:
            return
        self.erased.updateValue((uid,), (generation,))
        for session, at in index.items():
            s = redacted(self._load(session), uid)
            self.held.updateValue((session,), (json.dumps(s),))
            at[2] = bool(s["rounds"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, index, wall, out = pd.concat(list(rows)), self._index(), int(time.time() * 1000), []
        for r in frame[frame["erase"]].sort_values("generation").itertuples():
            self._erase(r.uid, int(r.generation), index)
        said = frame[~frame["erase"]]
        for session, part in said.groupby("session_key"):
            gone = {u: self.erased.getValue((u,))[0] for u in part["uid"].dropna().unique() if self.erased.containsKey((u,))}
            part = part[part["generation"].fillna(0) >= part["uid"].map(gone).fillna(-1)]
            if not len(part):
                continue
            s, due = step(self._load(session), session, part, self.group if ":gm:" in session else self.private)
            out += due
            self._save(session, s, index, max(part["ts"].max().timestamp(), index.get(session, [0.0])[0]), wall)
        clock = max((at[0] for at in index.values()), default=0.0)
        for session, at in list(index.items()):
            if at[0] + self.keep_s <= clock:
                out += self._leave(session, index, "left")
            elif at[2] and at[0] + self.idle_s <= clock:
                out += self._idle(session, at)
        while len(index) > self.limit:
            out += self._leave(next(iter(index)), index, "evicted")
        self._done(index, wall)
        if out:
            yield pd.DataFrame(out)

    def _idle(self, session: str, at: list) -> list[dict]:
        s = self._load(session)
        out = [flush(session, s, "idle")]
        self.held.updateValue((session,), (json.dumps(s),))
        at[2] = False
        return out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index, wall = self._index(), int(time.time() * 1000)
        out = [row for session, at in index.items() if at[2] and at[1] + self.idle_s * 1000 <= wall for row in self._idle(session, at)]
        self._done(index, wall)
        if out:
            yield pd.DataFrame(out)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        index, wall = self._index(), int(time.time() * 1000)
        for r in initialState.sort_values("first_ts").itertuples():
            s = empty_state() | {"rounds": int(r.rounds), "first": r.first_ts.timestamp(), "last": r.last_ts.timestamp(), "people": list(r.participants)}
            s |= {c: list(getattr(r, c)) for c in ("lines", "bot_lines", "history")}
            self._save(r.session_key, s, index, s["last"], wall)
        self._done(index, wall)


def shard(session, shards: int = SHARDS):
    return F.pmod(F.xxhash64(session), F.lit(shards)).cast("int")


def events(messages: DataFrame, erasures: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """IN from messages (session_key, msg_key, line, uid, is_bot, ts[, generation]) and erasures (uid, generation), each a stream."""
    generation = F.coalesce(F.col("generation").cast("long"), F.lit(0)) if "generation" in messages.columns else F.lit(0).cast("long")
    own = messages.filter("session_key IS NOT NULL AND ts IS NOT NULL").select(
        shard("session_key", shards).alias("shard"), F.lit(False).alias("erase"), "session_key", F.coalesce("msg_key", F.uuid()).alias("msg_key"), "line",
        F.coalesce("uid", F.lit("")).alias("uid"), F.coalesce("is_bot", F.lit(False)).alias("is_bot"), F.col("ts").cast("timestamp").alias("ts"), generation.alias("generation"),
    )
    if erasures is None:
        return own
    none = F.lit(None).cast("string")
    gone = erasures.filter("uid IS NOT NULL AND generation IS NOT NULL").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("erase"), none.alias("session_key"), none.alias("msg_key"), none.alias("line"),
        "uid", F.lit(False).alias("is_bot"), F.lit(None).cast("timestamp").alias("ts"), F.col("generation").cast("long").alias("generation"),
    )
    return own.unionByName(gone)


def retained(
    messages: DataFrame, group: int = 1, private: int = 5, idle_s: float = IDLE_S, keep_s: float = KEEP_S, limit: int = LIMIT, shards: int = SHARDS,
    erasures: DataFrame | None = None, waiting: DataFrame | None = None, timers: bool = True,
) -> DataFrame:
    """Flushed batches of a stream of messages, as ``events`` takes them; waiting: batches to begin with, as ``retain.merged`` takes them.

    The state lies in RocksDB under Spark's checkpoint, which is set for the session here: a lost executor loses no batch, and a
    shard's sessions need not fit its memory. limit: sessions of a shard. With timers, Spark starts a micro-batch at every trigger to
    look at them, so a stream that is to end (availableNow) is started without; a shard's clock alone then tells who is idle.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    first = None
    if waiting is not None:
        one = merged(waiting.filter(~F.coalesce("failed", F.lit(False))))
        first = one.select(shard("session_key", shards).alias("shard"), "session_key", "lines", "bot_lines", "history", "participants", "rounds", "first_ts", "last_ts").groupBy("shard")
    keyed = events(messages, erasures, shards).groupBy("shard")
    return keyed.transformWithStateInPandas(Sessions(group, private, idle_s, keep_s, limit, timers), OUT, "append", "ProcessingTime" if timers else "None", initialState=first)


# -- delivery --------------------------------------------------------------------------------------------------------


def _failed(spark: SparkSession, path: str, upto: int) -> DataFrame | None:
    """The batches under path that failed before epoch `upto` and have not been written since."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    epochs = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(where) if "=" in f.getPath().getName()) if fs.exists(where) else []
    before = [e for e in epochs if e < upto]
    return spark.read.schema(OUT).parquet(f"{path}/epoch={before[-1]}") if before else None


def deliver(write: Callable[[DataFrame, int, bool], None], failed: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: write(batches, epoch, again) must be idempotent by session and first_ts.

    Before an epoch's batches come those that failed, with again = True, each in a call of its own, so that none spoils others. What
    raises is kept under ``failed`` in a table of its epoch, which replaces the one before; a repeated epoch starts from the same
    table, so it neither loses nor doubles a batch.
    """

    def run(batches: DataFrame, epoch: int) -> None:
        spark, left = batches.sparkSession, []
        before = _failed(spark, failed, epoch)
        # failures are few: a sink that is down fails whole epochs, which stay one entry each until it is up
        keys = before.select("session_key", "first_ts").distinct().collect() if before is not None else []
        for k in keys:
            one = before.filter(F.col("session_key").eqNullSafe(k[0]) & F.col("first_ts").eqNullSafe(k[1]))
            try:
                write(one, epoch, True)
            except Exception:  # noqa: BLE001 - whatever the sink raises
                left.append(one)
        batches.persist()
        try:
            write(batches, epoch, False)
        except Exception:  # noqa: BLE001
            left.append(batches)
        if left or keys:
            out = batches.limit(0)
            for x in left:
                out = out.unionByName(x)
            out.coalesce(1).write.mode("overwrite").parquet(f"{failed}/epoch={epoch}")
        batches.unpersist()

    return run
