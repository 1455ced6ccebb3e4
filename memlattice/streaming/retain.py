"""Retaining messages in batches: a stateful stream, the same batches as window queries, and the table of waiting batches.

State of a session: its latest LINES lines (a message that arrives again under its key replaces the earlier one and moves
to the end), which of them were consumed, and the batch that waits. A line of the bot ends a round; the round takes all
lines not consumed yet, unless the bot alone spoke. A batch is flushed after ``every`` rounds, or when its session has
been idle. Its history are the lines before its first round. ``sessions`` keeps this state in a stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import message_line

HISTORY, LINES, BOT_IDS = 10, 30, 100
OUT = (
    "session_key string, rounds int, n_lines int, lines array<string>, bot_lines array<string>, history array<string>, participants array<string>, "
    "first_ts timestamp, last_ts timestamp, reason string"
)


def rounds_needed(session: Column, group: int = 1, private: int = 5) -> Column:
    return F.when(F.contains(session, F.lit(":gm:")), group).otherwise(private)


def offline(lines: DataFrame, group: int = 1, private: int = 5) -> DataFrame:
    """(session_key, batch_no, ...) for lines (session_key, turn, role, text, uid): the batches that the counts alone give."""
    w = Window.partitionBy("session_key").orderBy("conv_id", "turn")
    done = F.coalesce(F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("batch_no", F.floor(done / rounds_needed(F.col("session_key"), group, private)).cast("long"))
    return rows.groupBy("session_key", "batch_no").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("role") == "assistant").alias("rounds"),
        F.count_distinct(F.when(F.col("role") != "assistant", F.col("uid"))).alias("n_people"), F.sum(F.length("text")).alias("chars"),
    )


def idle_batches(events: DataFrame, idle_s: int = 1800) -> DataFrame:
    """(session, start, end, n) of events (session, ts) split where a session pauses for idle_s."""
    out = events.groupBy("session", F.session_window("ts", f"{idle_s} seconds")).agg(F.count("*").alias("n"))
    return out.select("session", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


# -- the stream ---------------------------------------------------------------------------------------------------


def empty_state() -> dict:
    return {"cache": [], "rounds": 0, "lines": [], "bot_lines": [], "history": [], "people": [], "first": 0.0, "last": 0.0}


def _round(s: dict) -> None:
    """Moves what was not consumed into the waiting batch, if a person spoke."""
    fresh = [x for x in s["cache"] if not x["used"]]
    said = [x for x in fresh if not x["bot"]]
    if not said:
        return
    if not s["rounds"]:
        s["history"] = [x["line"] for x in s["cache"] if x["used"]][-HISTORY:]
        s["first"] = min(x["ts"] for x in fresh)
    s["rounds"] += 1
    s["lines"] = s["lines"] + [x["line"] for x in said]
    s["bot_lines"] = s["bot_lines"] + [x["line"] for x in fresh if x["bot"]]
    s["people"] = list(dict.fromkeys([*s["people"], *(x["uid"] for x in said if x["uid"])]))
    s["last"] = max(s["last"], *(x["ts"] for x in fresh))
    for x in fresh:
        x["used"] = True


def flush(key: str, s: dict, reason: str) -> dict:
    """The waiting batch as a row; the state keeps its lines, the batch leaves it."""
    row = {
        "session_key": key, "rounds": s["rounds"], "n_lines": len(s["lines"]) + len(s["bot_lines"]), "lines": s["lines"], "bot_lines": s["bot_lines"], "history": s["history"],
        "participants": s["people"], "first_ts": pd.Timestamp(s["first"], unit="s"), "last_ts": pd.Timestamp(s["last"], unit="s"), "reason": reason,
    }
    s.update({k: v for k, v in empty_state().items() if k != "cache"})
    return row


def step(state: dict | None, key: str, rows: pd.DataFrame, every: int) -> tuple[dict, list[dict]]:
    """The state after rows (msg_key, line, uid, is_bot, ts) in time order, and the batches that became due."""
    s, out = state or empty_state(), []
    held = {x["key"]: x for x in s["cache"]}
    for r in rows.sort_values(["ts", "msg_key"]).itertuples():
        before = held.pop(r.msg_key, None)
        held[r.msg_key] = {"key": r.msg_key, "line": r.line, "uid": r.uid or "", "bot": bool(r.is_bot), "ts": r.ts.timestamp(), "used": bool(before and before["used"])}
        while len(held) > LINES:
            del held[next(iter(held))]
        if r.is_bot and before is None:
            s["cache"] = list(held.values())
            _round(s)
            if s["rounds"] >= max(1, every):
                out.append(flush(key, s, "rounds"))
    s["cache"] = list(held.values())
    return s, out


#: What a hook's event is to the stream: a line of a person, a line of the bot, or nothing to keep.
HOOKS = {"im_message": False, "message_sent": True}


def from_hooks(events: DataFrame) -> DataFrame:
    """Messages from a host's events (hook, platform, kind, peer, message_id, user_id, text, ts); kind: dm or gm. Others are left out."""
    own = events.filter(F.col("hook").isin(*HOOKS) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    bot = F.col("hook") == "message_sent"
    key = F.concat_ws(":", "platform", "kind", "peer")
    line = message_line(F.col("user_id"), F.col("text"), F.col("ts"), F.col("user_id"), bot, F.lit(False), F.lit(""))
    return own.select(key.alias("session_key"), F.col("message_id").alias("msg_key"), line.alias("line"), F.col("user_id").alias("uid"), bot.alias("is_bot"), "ts")


def sink(batches: DataFrame, write, checkpoint: str, trigger: dict | None = None):
    """Starts the stream; write(df, epoch) must be idempotent, as insert by document_id is."""
    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).outputMode("append").start()


# -- waiting batches as a table -------------------------------------------------------------------------------------


def merged(batches: DataFrame) -> DataFrame:
    """Batches (session_key, first_ts, last_ts, lines, bot_lines, history, participants, rounds, failed) of a session as one.

    Ordered by their first time: the earliest one's history stays, people in order of appearance, rounds summed. A
    failed batch stays alone, so that it cannot spoil others; it is told by its first time.
    """
    alone = F.when(F.coalesce("failed", F.lit(False)), F.col("first_ts")).alias("_alone")
    ordered = F.array_sort(F.collect_list(F.struct("first_ts", "last_ts", "lines", "bot_lines", "history", "participants")))
    out = batches.groupBy("session_key", alone).agg(ordered.alias("o"), F.sum("rounds").cast("int").alias("rounds"), F.max(F.coalesce("failed", F.lit(False))).alias("failed"))
    return out.select(
        "session_key", F.flatten(F.transform("o", lambda x: x["lines"])).alias("lines"), F.flatten(F.transform("o", lambda x: x["bot_lines"])).alias("bot_lines"),
        F.col("o")[0]["history"].alias("history"), F.array_distinct(F.flatten(F.transform("o", lambda x: x["participants"]))).alias("participants"), "rounds", "failed",
        F.col("o")[0]["first_ts"].alias("first_ts"), F.array_max(F.transform("o", lambda x: x["last_ts"])).alias("last_ts"),
    )


def reseated(waiting: DataFrame, failed: DataFrame) -> DataFrame:
    """waiting with the batches whose writing failed back in it, marked, to be flushed alone next time."""
    return waiting.unionByName(failed.withColumn("failed", F.lit(True)))


def stored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (session_key, payload, updated_at) after an upsert: of each session the one written last; of equal times the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = F.max(F.struct("updated_at", "_new", "payload")).alias("m")
    return both.groupBy("session_key").agg(best).select("session_key", "m.payload", "m.updated_at")


def cleared(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows without those written up to the cutoff of their session in done (session_key, cutoff); later ones stay."""
    j = rows.join(done.groupBy("session_key").agg(F.max("cutoff").alias("_cut")), "session_key", "left")
    return j.filter(F.col("_cut").isNull() | (F.col("updated_at") > F.col("_cut"))).select(*rows.columns)


def without_user(batches: DataFrame, uid: str) -> DataFrame:
    """Batches without a person: the lines (of people, of the bot, of the history) whose head, before the first '>', names them,
    and their place among the participants, whose first one owns the batch. A batch with lines of the bot alone stays; one without
    any line or without anybody goes. A column user_id or generation then tells the owner, or that nobody read it before."""
    mark = f'uid="{uid}"'
    keep = lambda c: F.filter(c, lambda x: ~F.contains(F.split_part(x, F.lit(">"), F.lit(1)), F.lit(mark)))
    out = batches.withColumns({**{c: keep(c) for c in ("lines", "bot_lines", "history") if c in batches.columns}, "participants": F.array_remove("participants", uid)})
    if "user_id" in out.columns:
        out = out.withColumn("user_id", F.when(F.col("user_id") == uid, F.try_element_at("participants", F.lit(1))).otherwise(F.col("user_id")))
    said = F.size("lines") + (F.size("bot_lines") if "bot_lines" in out.columns else F.lit(0))
    return out.filter((said > 0) & (F.size("participants") > 0))


def not_erased(batches: DataFrame, erased: DataFrame) -> DataFrame:
    """Batches of people (user_id, generation when read) that were not erased since; erased: (user_id, generation)."""
    now = erased.groupBy(F.col("user_id").alias("_u")).agg(F.max("generation").alias("_g"))
    j = batches.join(now, F.col("user_id") == F.col("_u"), "left")
    return j.filter(F.coalesce("generation", F.lit(0)) >= F.coalesce("_g", F.lit(0))).select(*batches.columns)


def history(lines: DataFrame, batch: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n lines of each session that are not in its batch (msg_key)."""
    w = Window.partitionBy("session_key").orderBy(F.desc("ts"), F.desc("msg_key"))
    rest = lines.join(batch.select("session_key", "msg_key"), ["session_key", "msg_key"], "left_anti")
    return rest.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def latest_lines(lines: DataFrame, n: int = LINES) -> DataFrame:
    """A session's cache: of each message key its last line, the n latest lines."""
    one = lines.groupBy("session_key", "msg_key").agg(F.max(F.struct("ts", "line", "uid", "is_bot")).alias("m")).select("session_key", "msg_key", "m.*")
    w = Window.partitionBy("session_key").orderBy(F.desc("ts"), F.desc("msg_key"))
    return one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def bot_messages(sent: DataFrame, n: int = BOT_IDS) -> DataFrame:
    """(session_key, message_id, ts) that the bot sent: each id once, where it came first; the n latest of each session."""
    one = sent.groupBy("session_key", "message_id").agg(F.min("ts").alias("ts"))
    w = Window.partitionBy("session_key").orderBy(F.desc("ts"), F.desc("message_id"))
    return one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def quote_text(messages: DataFrame, cache: DataFrame, lines: int = 2, chars: int = 200) -> DataFrame:
    """(turn_id, query): a turn's text with the lines that it quotes behind it, each and all cut to so many characters.

    messages: (turn_id, session_key, text, quotes), cache: (session_key, msg_key, line, ts), as latest_lines gives.
    """
    asked = messages.select("turn_id", "session_key", F.explode(F.array_distinct("quotes")).alias("msg_key"))
    hits = asked.join(cache, ["session_key", "msg_key"]).withColumn("line", F.substring(F.trim("line"), 1, chars)).filter("line <> ''")
    w = Window.partitionBy("turn_id").orderBy("ts", "msg_key")
    best = hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= lines)
    text = best.groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), " ").alias("quote"))
    out = messages.join(text, "turn_id", "left")
    return out.select("turn_id", F.substring(F.trim(F.concat_ws(" ", F.trim("text"), "quote")), 1, chars).alias("query"))


#: Seconds between the runs of the background passes.
PASSES = {"embeddings": 300, "cycle": 6 * 3600, "decay": 14 * 86400, "archive": 7 * 86400}


def due(runs: DataFrame, now: Column, passes: dict[str, int] | None = None) -> DataFrame:
    """(name) of the passes that are due; runs: (name, last_run). One that never ran is due."""
    spark = runs.sparkSession
    every = spark.createDataFrame(list((passes or PASSES).items()), "name string, every_s long")
    last = every.join(runs.groupBy("name").agg(F.max("last_run").alias("last")), "name", "left")
    gone = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return last.filter(F.col("last").isNull() | (gone >= F.col("every_s"))).select("name")
