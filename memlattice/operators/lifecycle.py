"""Session reads, archive lifecycle, injection texts and short-lived memos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import relative_precise, sanitized, time_label, unmimicked
from .recall import within_budget


def _in(session: str, platform: str = "") -> Column:
    c = F.col("session_id") == session
    return c & (F.col("platform") == platform) if platform else c


def archive(summaries: DataFrame, now: Column, after_days: int, window_days: int) -> DataFrame:
    """Old rows that nobody recalled lately are archived, in one pass."""
    stale = ~F.col("archived") & (F.col("written_at") < now - F.expr(f"INTERVAL {after_days} DAYS")) & (F.col("last_recall_at").isNull() | (F.col("last_recall_at") < now - F.expr(f"INTERVAL {window_days} DAYS")))
    return summaries.withColumn("archived_now", stale).withColumn("archived", F.col("archived") | stale)


def reinforce(summaries: DataFrame, injected: DataFrame, now: Column) -> DataFrame:
    """Rows that were injected (document_id) count one more recall; archived ones do not."""
    j = summaries.join(injected.select("document_id").distinct().withColumn("_hit", F.lit(True)), "document_id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("archived")
    return j.withColumn("last_recall_at", F.when(hit, now).otherwise(F.col("last_recall_at"))).withColumn("recall_count", F.coalesce("recall_count", F.lit(0)) + F.when(hit, 1).otherwise(0)).drop("_hit")


def restore(summaries: DataFrame, row_id: int, session: str = "") -> DataFrame:
    hit = (F.col("id") == row_id) & F.col("archived")
    hit = hit & (F.col("session_id") == session) if session else hit
    return summaries.withColumn("archived", F.col("archived") & ~hit).withColumn("archived_at", F.when(~hit, F.col("archived_at")))


def delete_summary(summaries: DataFrame, document_id: str, session: str = "", user: str = "") -> DataFrame:
    """Without the document, if the session or the user owns it (no owner given: always)."""
    own = F.lit(not (session or user))
    if session:
        own = own | (F.col("session_id") == session)
    if user:
        own = own | (F.col("user_id") == user)
    return summaries.filter(~((F.col("document_id") == document_id) & own))


def recent_participants(summaries: DataFrame, session: str, limit: int = 20, platform: str = "", bots: tuple[str, ...] = ()) -> DataFrame:
    """(key): people of the session's latest batches in order of first appearance, without the bot."""
    rows = summaries.filter(_in(session, platform) & F.col("summarized") & (F.col("kind") == "chat_summary")).orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)
    at = rows.withColumn("r", F.row_number().over(Window.orderBy(F.desc("occurred_at"), F.desc("id")))).select("r", F.posexplode("participants").alias("p", "key"))
    out = at.groupBy("key").agg(F.min(F.struct("r", "p")).alias("first")).orderBy("first").select("key")
    return out.filter(~F.split_part("key", F.lit(":"), F.lit(2)).isin(*bots)) if bots else out


def rollout(summaries: DataFrame, session: str, skip: int, limit: int, platform: str = "") -> DataFrame:
    """Latest chat summaries behind the `skip` latest rows of any kind: the offset is skip less the bot's rows among those."""
    rows = summaries.filter(_in(session, platform) & F.col("summarized"))
    w = Window.orderBy(F.desc("occurred_at"), F.desc("id"))
    top = rows.orderBy(F.desc("occurred_at"), F.desc("id")).limit(skip).agg(F.count_if(F.col("kind") == "bot_self").alias("bots"))
    chat = rows.filter("kind = 'chat_summary'").withColumn("rn", F.row_number().over(w))
    off = F.greatest(F.lit(0), F.lit(skip) - F.col("bots"))
    return chat.crossJoin(F.broadcast(top)).filter((F.col("rn") > off) & (F.col("rn") <= off + limit)).drop("bots")  # top: one row


def cross_session(summaries: DataFrame, keys: list[str], now: Column, limit: int, max_days: int, session: str = "", platform: str = "", kind: str = "") -> DataFrame:
    """Latest summaries of these people outside the current session (told by id, platform and direct or group), not older than max_days, none from the future."""
    here = F.lit(False)
    if session:
        here = _in(session, platform)
        here = here & ((F.col("group_id") == "") if kind == "dm" else (F.col("group_id") != "")) if kind in ("dm", "gm") else here
    seen = F.arrays_overlap("participants", F.array(*map(F.lit, keys))) if keys else F.lit(False)
    ok = (F.col("kind") == "chat_summary") & F.col("summarized") & ~F.col("archived") & seen & ~here & F.col("occurred_at").between(now - F.expr(f"INTERVAL {max_days} DAYS"), now)
    return summaries.filter(ok).orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)


def rollout_text(rows: DataFrame, now: Column, budget: int, tz: str = "UTC", mode: str = "both") -> DataFrame:
    """(text): the newest rows that fit the budget, shown oldest first with their time."""
    lines = rows.withColumn("line", F.concat(F.lit("["), time_label(F.col("occurred_at"), now, tz, mode), F.lit("] "), F.col("content")))
    fit = within_budget(lines, [F.desc("occurred_at"), F.desc("id")], budget, "line", 1)
    return fit.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "id", "line"))), lambda x: x["line"]), "\n").alias("text"))


def cross_session_text(rows: DataFrame, now: Column, budget: int, preamble: int = 0) -> DataFrame:
    """(text, document_ids): numbered entries, newest first, while the whole block fits."""
    body = sanitized(unmimicked(F.trim("content")))
    body = F.when(F.length(body) > budget, F.concat(F.substring(body, 1, max(0, budget - 3)), F.lit("..."))).otherwise(body)
    when = F.concat(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"), F.lit("（"), relative_precise(F.col("occurred_at"), now), F.lit("）"))
    order = [F.desc("occurred_at"), F.desc("id")]
    entry = F.concat(F.row_number().over(Window.orderBy(*order)).cast("string"), F.lit(". session_id："), "session_id", F.lit("\n   对话发生时间："), when, F.lit("\n   摘要内容："), body)
    fit = within_budget(rows.withColumn("entry", entry), order, budget - preamble - 2, "entry", 2, first_may_overflow=False)
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_micros("occurred_at")).alias("t"), "id", "entry", "document_id")))
    return fit.agg(F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n\n").alias("text"), F.transform(ordered, lambda x: x["document_id"]).alias("document_ids"))


def injection_text(rows: DataFrame, now: Column, order: list[Column], budget: int = 2048, blacklist: tuple[str, ...] = (), tz: str = "UTC", mode: str = "both") -> DataFrame:
    """(id, document_id, line): recalled rows as labelled lines within the budget; the first may overflow."""
    for word in blacklist:
        rows = rows.filter(~F.contains(F.col("content"), F.lit(word)))
    label = time_label(F.col("occurred_at"), now, tz, mode)
    lines = rows.withColumn("line", F.concat(F.when(label == "", "").otherwise(F.concat(F.lit("["), label, F.lit("] "))), unmimicked(F.col("content"))))
    return within_budget(lines, order, budget, "line", 1)


#: Seconds for which a staged memo counts although nothing committed it yet.
IN_FLIGHT_S = 300


def staged(memos: DataFrame, key: str, documents: DataFrame, now: Column) -> DataFrame:
    """memos (key, document_id, at, committed) with documents chosen for a prompt under key, not committed yet."""
    return memos.unionByName(documents.select(F.lit(key).alias("key"), "document_id", now.alias("at"), F.lit(False).alias("committed")))


def committed(memos: DataFrame, key: str) -> DataFrame:
    """memos after the prompt under key was sent."""
    return memos.withColumn("committed", F.col("committed") | (F.col("key") == key))


def fresh_memos(memos: DataFrame, now: Column, ttl_s: int = 1800, cap: int = 64) -> DataFrame:
    """Memos (key, document_id, at[, committed]) that still count; recall anti-joins them.

    Committed ones count for their time to live, the latest `cap` per key; staged ones for IN_FLIGHT_S, beyond the cap.
    """
    if "committed" not in memos.columns:
        memos = memos.withColumn("committed", F.lit(True))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))
    live = memos.filter(F.when(F.col("committed"), age <= ttl_s).otherwise(age <= IN_FLIGHT_S))
    w = Window.partitionBy("key", "committed").orderBy(F.desc("at"), "document_id")
    return live.withColumn("rn", F.row_number().over(w)).filter(~F.col("committed") | (F.col("rn") <= cap)).drop("rn")
