"""What an agent may do with its memory, as functions on DataFrames: search, write, correct, remove, profile, look up.

Every tool acts for one person (platform, user_id); a cluster of somebody else looks as if it did not exist.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import correction_key, evidence_key, fact_key
from ..schemas import Config
from ..sources import store
from ..sources.scratch import saved
from . import facts as facts_of
from . import graph, people, recall

#: Categories that a person may write; the others come from the engine itself.
WRITABLE = ("identity", "stable", "preference", "commitment", "interaction", "naming")


class Outcome(NamedTuple):
    """State after a tool, and one row (action, cluster_id) that tells what it did."""

    clusters: DataFrame
    facts: DataFrame
    profiles: DataFrame
    edges: DataFrame | None
    summary: DataFrame


def search(summaries: DataFrame, query: list[float] | None, text: str, s: recall.Scope, now: Column, **options) -> DataFrame | None:
    """memory_search: recalled rows with their score; None for a blank query."""
    found = recall.search(summaries, query, text, s, now, **options)
    return None if found is None else found.select("id", "document_id", "session_id", "user_id", "content", "occurred_at", "score")


def write(clusters: DataFrame, facts: DataFrame, profiles: DataFrame, item: DataFrame, now: Column, c: Config = Config(), replaces: int | None = None, edges: DataFrame | None = None, tz: str = "UTC") -> Outcome:
    """memory_write, and memory_correct with `replaces`: one fact becomes a cluster at once.

    item: one row (platform, session_id, group_id, user_id, display_name, category, statement, confidence, occurred_at,
    embedding). Its key keeps the time as given, the row a time not in the future. The same statement of a person on the
    same day is skipped; a correction of it takes a key of its own, so that the earlier statement can hold again.
    """
    target = F.lit(replaces).cast("long")
    uids = F.array("user_id")
    plain = fact_key(uids, F.col("session_id"), F.col("occurred_at"), F.col("statement"), tz)
    again = correction_key(uids, F.col("session_id"), F.col("occurred_at"), F.col("statement"), target, tz)
    ok = item.filter(F.col("category").isin(*WRITABLE) & (F.trim("statement") != ""))
    used = facts.filter("extracted_flag = 1").select(F.col("document_id").alias("_d")).distinct()
    keyed = ok.withColumn("_plain", plain).join(F.broadcast(used.join(ok.select(plain.alias("_d")), "_d", "left_semi")), F.col("_plain") == F.col("_d"), "left")  # at most one row
    doc = F.when(F.col("_d").isNotNull() & target.isNotNull(), again).otherwise(F.col("_plain"))
    row = keyed.withColumn("document_id", doc).withColumn("evidence_key", evidence_key(F.col("session_id"), F.col("occurred_at"), tz)).withColumn("related_user_ids", F.array().cast("array<string>"))
    row = saved(row, "item")
    after = saved(store.upsert_facts(facts, row.withColumn("occurred_at", F.least("occurred_at", now)).drop("_plain", "_d")), "facts")
    mine = after.join(row.select("document_id"), "document_id", "left_semi").filter("extracted_flag = 0")
    chosen = mine.select(F.col("id").alias("fact_id"), F.lit("create" if replaces is None else "replace").alias("action"), target.alias("cluster_id"))
    if replaces is not None:
        own = facts_of.owner_of(clusters, replaces).join(ok.select("platform", "user_id"), ["platform", "user_id"], "left_semi")
        chosen = chosen.crossJoin(F.broadcast(own.select(F.lit(1).alias("_own")).limit(1))).drop("_own")  # nothing for another's cluster
    state = facts_of.applied(clusters, after, chosen, now, c, None, profiles, edges)
    made = state.clusters.join(clusters.select("id"), "id", "left_anti").select("id")
    said = made.agg(F.max("id").alias("cluster_id")).select(F.when(F.col("cluster_id").isNull(), "skipped").otherwise("create" if replaces is None else "replace").alias("action"), "cluster_id")
    return Outcome(state.clusters, state.facts, state.profiles, state.edges, said)


def correct(clusters: DataFrame, facts: DataFrame, profiles: DataFrame, item: DataFrame, cluster_id: int, now: Column, c: Config = Config(), edges: DataFrame | None = None) -> Outcome:
    """memory_correct: the statement takes the cluster's place."""
    return write(clusters, facts, profiles, item, now, c, cluster_id, edges)


def remove(clusters: DataFrame, profiles: DataFrame, cluster_id: int, action: str, now: Column, platform: str, user_id: str) -> tuple[DataFrame, DataFrame]:
    """memory_remove: (clusters, profiles) after drop, dispute or reactivate of one's own cluster."""
    after = facts_of.change_status(clusters, cluster_id, action, now, platform, user_id)
    return after, facts_of.synced_profiles(profiles, after, now)


def profile(profiles: DataFrame, clusters: DataFrame, aliases: DataFrame, platform: str, user_id: str, limit: int = 5, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """memory_profile: (platform, user_id, text) of one person."""
    own = (F.col("platform") == platform) & (F.col("user_id") == user_id)
    rows = people.sections(profiles.filter(own), clusters, limit)
    return people.profile_text(rows, aliases.filter(own), people.uncertain(clusters.filter(own), None, limit), blacklist)


def lookup(clusters: DataFrame, edges: DataFrame, aliases: DataFrame, query: list[float], limit: int, platform: str = "", user_ids: list[str] | None = None, category: str = "", inactive: str = "no") -> DataFrame:
    """memory_lookup: the nearest facts with their owner's name, and the owner's active relations as lines.

    (kind, id, platform, user_id, name, statement, status, relevance); the relations' table is met by the facts' owners.
    """
    found = facts_of.search(clusters, query, limit, platform, user_ids, category, inactive)
    names = people.names_by_owner(aliases, found.select("platform", "user_id"))
    cols = ["kind", "id", "platform", "user_id", "name", "statement", "status", "relevance"]
    facts_ = found.join(names, ["platform", "user_id"], "left").select(F.lit("fact").alias("kind"), "id", "platform", "user_id", "name", F.col("canonical_statement").alias("statement"), "status", "relevance")
    owners = found.select("platform", "user_id").distinct()
    ends = F.explode(F.array("subject_uid", "object_uid")).alias("user_id")
    touch = edges.filter("status = 'active'").select("id", "platform", "statement", "status", ends).join(owners, ["platform", "user_id"]).join(names, ["platform", "user_id"], "left")
    relations = touch.select(F.lit("relation").alias("kind"), "id", "platform", "user_id", "name", "statement", "status", F.lit(None).cast("double").alias("relevance"))
    return facts_.select(*cols).unionByName(relations.select(*cols))


def relation_section(edges: DataFrame, text: str, nodes: list[str], bots: list[str], platform: str, nickname: str, addressed: bool, now: Column, stopwords: list[str] | None = None, per_anchor: int = 2, total: int = 3) -> DataFrame:
    """(id, line, scenario): the relations to mention for a text, as sentences with the day they were last seen."""
    order = [F.desc("evidence_count"), F.desc("last_seen"), F.col("id")]
    chosen = graph.selected(graph.active_edges(edges, [*nodes, *[f"{platform}:{b}" for b in bots]]), text, nodes, bots, platform, addressed, stopwords or [], per_anchor, total)
    lines = graph.statement_lines(chosen, bots, platform, nickname, F.date_format("last_seen", "yyyy-MM-dd"))
    return lines.orderBy(*order).select("id", "line", "scenario")
