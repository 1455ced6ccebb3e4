"""Writing encoded batches: facts, then relations, then the summary, each idempotent by its key; and encoding old rows anew.

An encoded batch is a row (session_id, platform, group_id, user_id, occurred_at, participants, text, summary, ok,
embedding, facts, relations), where facts and relations are arrays of structs as the encoder gives them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cosine, document_key, evidence_key, fact_key, is_placeholder, without_nul
from ..schemas import Config
from ..sources import store
from ..sources.scratch import saved
from . import facts as facts_of
from . import graph, people

FACTS = "array<struct<user_id:string,related_user_ids:array<string>,display_name:string,category:string,statement:string,confidence:string>>"
RELATIONS = (
    "array<struct<subject_user_id:string,object_user_id:string,subject_display_name:string,object_display_name:string,label:string,statement:string,confidence:string>>"
)


class Written(NamedTuple):
    """The four tables after a write."""

    facts: DataFrame
    aliases: DataFrame
    edges: DataFrame
    summaries: DataFrame


def fact_rows(batches: DataFrame, bots: list[str], tz: str = "UTC") -> DataFrame:
    """Facts of encoded batches that hold, with their keys: people, session, day and statement."""
    items = batches.select("session_id", "platform", "group_id", "occurred_at", F.explode("facts").alias("f")).select("session_id", "platform", "group_id", "occurred_at", "f.*")
    ok = facts_of.without_bot(facts_of.valid_facts(items), bots)
    uids = F.concat(F.array("user_id"), "related_user_ids")
    return ok.withColumn("document_id", fact_key(uids, F.col("session_id"), F.col("occurred_at"), F.col("statement"), tz)).withColumn("evidence_key", evidence_key(F.col("session_id"), F.col("occurred_at"), tz))


def relation_rows(batches: DataFrame, aliases: DataFrame, bots: list[str], c: Config = Config(), min_evidence: int = 2, tz: str = "UTC") -> DataFrame:
    """Rows to upsert from encoded batches; a placeholder for a name becomes the owner's latest real one, or empty."""
    items = batches.select("session_id", "platform", "occurred_at", F.posexplode("relations").alias("i", "r")).select("session_id", "platform", "occurred_at", "i", "r.*")
    ok = graph.valid_relations(items)
    names = graph.canonical_names(aliases)
    for side in ("subject", "object"):
        own = names.select("platform", F.col("user_id").alias(f"{side}_user_id"), F.col("canon").alias("_c"))
        ok = ok.join(own, ["platform", f"{side}_user_id"], "left")
        given = F.col(f"{side}_display_name")
        ok = ok.withColumn(f"{side}_name", F.when(is_placeholder(given), F.coalesce("_c", F.lit(""))).otherwise(given)).drop("_c")
    bot = F.col("subject_user_id").isin(*bots) | F.col("object_user_id").isin(*bots) if bots else F.lit(False)
    pos = F.struct(F.col("occurred_at").alias("at"), "session_id", "i")
    return ok.select(
        "platform", F.col("subject_user_id").alias("subject_uid"), F.col("object_user_id").alias("object_uid"), F.col("label").alias("relation_label"), "subject_name", "object_name",
        "statement", "confidence", "occurred_at", evidence_key(F.col("session_id"), F.col("occurred_at"), tz).alias("evidence_key"), pos.alias("pos"),
        F.lit(True).alias("count_on_conflict"), bot.alias("is_bot_edge"), F.lit(min_evidence).alias("min_evidence"),
    )


def summary_rows(batches: DataFrame) -> DataFrame:
    """A summary for each batch; where encoding failed it is the conversation itself, to be encoded later."""
    text = without_nul(F.when(F.col("ok") & (F.trim(F.coalesce("summary", F.lit(""))) != ""), F.col("summary")).otherwise(F.col("text")))
    kind = F.lit("chat_summary")
    return batches.select(
        document_key(kind, F.col("session_id"), text).alias("document_id"), kind.alias("kind"), "platform", "session_id", "group_id", "user_id", "participants",
        text.alias("content"), "occurred_at", F.when(F.col("ok"), F.col("embedding")).alias("embedding"), F.col("ok").alias("summarized"),
    )


def novel(old: DataFrame, new: DataFrame, window: int = 8, threshold: float = 0.85) -> DataFrame:
    """new summaries without those as near as threshold to one of the `window` latest of their session and platform.

    Only encoded rows are held against others; a row without a vector is written. A session's latest are one short row.
    """
    own = ["session_id", "platform"]
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("occurred_at"), F.desc("id")))
    held = old.filter((F.col("kind") == "chat_summary") & F.col("summarized") & F.col("embedding").isNotNull()).withColumn("_r", rank).filter(F.col("_r") <= window)
    held = held.groupBy(*own).agg(F.collect_list("embedding").alias("_held"))
    near = F.exists(F.coalesce("_held", F.array().cast("array<array<float>>")), lambda v: F.coalesce(cosine(F.col("embedding"), v) >= threshold, F.lit(False)))
    return new.join(held, own, "left").filter(~(F.col("summarized") & near)).drop("_held").select(*new.columns)


def retained(batches: DataFrame, facts: DataFrame, aliases: DataFrame, edges: DataFrame, summaries: DataFrame, now: Column, bots: list[str], c: Config = Config(), stopwords: list[str] | None = None) -> Written:
    """The tables after encoded batches: facts, names that their statements give, relations, and summaries, in this order.

    All is idempotent: facts and summaries by document, edges by evidence key; so a write that failed half way is repeated whole.
    """
    rows = saved(fact_rows(batches, bots), "facts")
    after = store.insert_facts(facts, rows, now)
    named = people.fact_code_aliases(rows.select("platform", F.xxhash64("document_id").alias("id"), "statement", F.col("occurred_at").alias("last_seen")))
    known = saved(people.alias_upsert(aliases, named), "aliases")
    left = graph.upserted(edges, saved(relation_rows(batches, known, bots, c), "relations"), now, stopwords)
    fresh = saved(novel(summaries, summary_rows(batches), c.write_window, c.dedup), "summaries")
    return Written(after, known, left, store.insert_summaries(summaries, fresh, now))


def reencoded(summaries: DataFrame, encoded: DataFrame, facts: DataFrame, aliases: DataFrame, edges: DataFrame, now: Column, bots: list[str], c: Config = Config()) -> Written:
    """The tables after rows that could not be encoded before were: (id, ok, summary, embedding, facts, relations).

    Facts and relations come first, under the row's own session and time; a row whose encoding failed again stays as it is.
    """
    rows = summaries.filter(~F.col("summarized") & (F.col("kind") != "bot_self")).select("id", "session_id", "platform", "group_id", "user_id", "occurred_at", "participants", F.col("content").alias("text"))
    batches = saved(rows.join(encoded.filter("ok"), "id"), "encoded")
    made = saved(fact_rows(batches, bots), "facts")
    left = graph.upserted(edges, saved(relation_rows(batches, aliases, bots, c), "relations"), now)
    done = batches.select("id", F.col("summary").alias("content"), "embedding")
    return Written(store.insert_facts(facts, made, now), aliases, left, store.encoded_back(summaries, done))


def table_deltas(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, before, after, added): row counts of tables around an import, one aggregate for each."""
    out = None
    for name in sorted(after):
        n = after[name].agg(F.count("*").alias("after"))
        o = before[name].agg(F.count("*").alias("before"))
        row = o.crossJoin(n).select(F.lit(name).alias("name"), "before", "after", (F.col("after") - F.col("before")).alias("added"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out
