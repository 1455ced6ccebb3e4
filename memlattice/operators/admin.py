"""Admin reads and edits: counts, browsing, whitelists, erasure."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import search_text
from ..schemas import CATEGORIES, CONFIDENCES
from . import facts as facts_of
from . import graph, people


def page_of(page: int, size: int) -> tuple[int, int]:
    """(offset, limit): page from 1, size from 1 to 100."""
    size = min(100, max(1, size))
    return (max(1, page) - 1) * size, size


def paged(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    offset, limit = page_of(page, size)
    return df.orderBy(*order).offset(offset).limit(limit)


def _ilike(col: str, q: str) -> Column:
    return F.contains(F.lower(col), F.lower(F.lit(q)))


def overview(summaries: DataFrame, facts: DataFrame, clusters: DataFrame, profiles: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row of counts, one aggregate for each table."""
    one = [
        summaries.agg(F.count("*").alias("summaries"), F.count_if(~F.col("summarized")).alias("unsummarized"), F.count_if("archived").alias("archived")),
        facts.agg(F.count("*").alias("facts"), F.count_if(F.col("extracted_flag") == 0).alias("pending_facts")),
        clusters.agg(F.count("*").alias("clusters"), F.count_if(F.col("status") == "profiled").alias("profiled"), F.count_if(F.col("status") == "pending_uncertain").alias("uncertain"), F.count_distinct(F.struct("platform", "user_id")).alias("users")),
        profiles.agg(F.count("*").alias("profiles")), edges.agg(F.count("*").alias("edges")), aliases.agg(F.count("*").alias("aliases")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # one row each
    return out


def users(clusters: DataFrame, facts: DataFrame, q: str = "") -> DataFrame:
    """A row for each owner of a cluster or fact: counts by status, best score, latest change, latest name."""
    own = ["platform", "user_id"]
    owners = clusters.select(*own).union(facts.select(*own)).distinct()
    latest = clusters.select(*own, F.col("updated_at").alias("t")).unionByName(facts.select(*own, F.col("occurred_at").alias("t"))).groupBy(*own).agg(F.max("t").alias("latest"))
    c = clusters.groupBy(*own).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("active", "profiled", "pending_uncertain", "dead")], F.max("score").alias("max_score"))
    n = facts.filter("display_name <> ''").groupBy(*own).agg(F.max_by("display_name", F.struct("occurred_at", "id")).alias("name"))
    out = owners.join(c, own, "left").join(latest, own, "left").join(n, own, "left").fillna(0, ["active", "profiled", "pending_uncertain", "dead"])
    return out.filter(_ilike("user_id", q) | F.coalesce(_ilike("name", q), F.lit(False))) if q else out


def browse_facts(facts: DataFrame, user_id: str = "", session_id: str = "", category: str = "", confidence: str = "", extracted: int | None = None, q: str = "") -> DataFrame:
    """Unknown categories and confidences do not filter."""
    for col, v, known in (("user_id", user_id, None), ("session_id", session_id, None), ("category", category, CATEGORIES), ("confidence", confidence, CONFIDENCES)):
        if v and (known is None or v in known):
            facts = facts.filter(F.col(col) == v)
    if extracted in (0, 1):
        facts = facts.filter(F.col("extracted_flag") == extracted)
    return facts.filter(_ilike("statement", q)) if q else facts


def browse_clusters(clusters: DataFrame, user_id: str = "", category: str = "", status: str = "", session_id: str = "", q: str = "") -> DataFrame:
    if user_id:
        clusters = clusters.filter(F.col("user_id") == user_id)
    if category in CATEGORIES:
        clusters = clusters.filter(F.col("category") == category)
    if status in ("active", "profiled", "pending_uncertain", "replaced", "dead"):
        clusters = clusters.filter(F.col("status") == status)
    if session_id:
        clusters = clusters.filter(F.exists("evidence_keys", lambda k: F.startswith(k, F.lit(f"{session_id}|"))))
    return clusters.filter(_ilike("canonical_statement", q)) if q else clusters


def browse_summaries(summaries: DataFrame, session_id: str = "", user_id: str = "", kind: str = "", q: str = "") -> DataFrame:
    for col, v in (("session_id", session_id), ("user_id", user_id), ("kind", kind)):
        summaries = summaries.filter(F.col(col) == v) if v else summaries
    return summaries.filter(_ilike("content", q)) if q else summaries


STATUSES = ("active", "profiled", "pending_uncertain", "replaced", "dead")


class Edited(NamedTuple):
    """State after an edit of a cluster; revived: (cluster_id) to extract relations from again."""

    clusters: DataFrame
    profiles: DataFrame | None
    edges: DataFrame | None
    revived: DataFrame


def update_cluster(clusters: DataFrame, row_id: int, now: Column, statement: str | None = None, score: float | None = None, status: str | None = None) -> DataFrame:
    """Edits one cluster: score within 0..10, a new statement drops the vector, demoted_at follows the status.

    A blank statement and an unknown status are errors. A replaced cluster keeps its status whatever is asked.
    """
    if statement is not None and not statement.strip():
        raise ValueError("a statement must not be blank")
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    hit = F.col("id") == row_id
    stamp = now.cast(clusters.schema["updated_at"].dataType)
    new = {"updated_at": F.when(hit, stamp).otherwise(F.col("updated_at"))}
    if statement is not None:
        changed = hit & (F.col("canonical_statement") != statement)
        new["canonical_statement"] = F.when(hit, F.lit(statement)).otherwise(F.col("canonical_statement"))
        if "embedding" in clusters.columns:
            new["embedding"] = F.when(~changed, F.col("embedding"))
    if score is not None:
        new["score"] = F.when(hit, F.lit(min(10.0, max(0.0, score)))).otherwise(F.col("score"))
    if status is not None:
        moves = hit & (F.col("status") != "replaced")
        demoted = F.coalesce("demoted_at", now.cast(clusters.schema["demoted_at"].dataType)) if status == "pending_uncertain" else F.lit(None)
        new["demoted_at"] = F.when(~moves, F.col("demoted_at")).otherwise(demoted)
        new["status"] = F.when(moves, F.lit(status)).otherwise(F.col("status"))
    return clusters.withColumns(new)


def edit_cluster(clusters: DataFrame, row_id: int, now: Column, profiles: DataFrame | None = None, edges: DataFrame | None = None, **values) -> Edited:
    """An edit with all that follows: the profile row, edges that rest on a killed cluster, and the list of revived ones."""
    after = update_cluster(clusters, row_id, now, **values)
    both = clusters.filter(F.col("id") == row_id).select("id", F.col("status").alias("old")).join(after.select("id", F.col("status").alias("new")), "id")
    gone = both.filter("new IN ('replaced', 'dead') AND old NOT IN ('replaced', 'dead')").select(F.col("id").alias("cluster_id"))
    back = both.filter("new IN ('active', 'profiled') AND old IN ('pending_uncertain', 'dead')").select(F.col("id").alias("cluster_id"))
    left = None
    if profiles is not None:
        own = after.filter((F.col("id") == row_id) & (F.col("status") == "profiled")).select(F.col("id").alias("cluster_id"), F.col("canonical_statement").alias("_t"), F.col("score").alias("_s"))
        left = facts_of.synced_profiles(profiles, after, now).join(own, "cluster_id", "left")
        stamp = now.cast(profiles.schema["updated_at"].dataType)
        left = left.withColumns({"statement": F.coalesce("_t", "statement"), "score": F.coalesce("_s", "score"), "updated_at": F.when(F.col("_s").isNotNull(), stamp).otherwise(F.col("updated_at"))})
        left = left.select(*profiles.columns)
    return Edited(after, left, None if edges is None else graph.retired(edges, gone, now), back)


def profile_preview(profiles: DataFrame, clusters: DataFrame, platform: str, user_id: str, limit: int = 5) -> DataFrame:
    """(category, rn, statement, score, cluster_id): what a person's profile shows, section by section."""
    own = profiles.filter((F.col("platform") == platform) & (F.col("user_id") == user_id))
    return people.sections(own, clusters, limit).select("category", "rn", "statement", "score", "cluster_id")


def delete_fact(facts: DataFrame, clusters: DataFrame, fact_id: int) -> tuple[DataFrame, DataFrame]:
    return facts.filter(F.col("id") != fact_id), clusters.withColumn("source_fact_ids", F.array_remove("source_fact_ids", F.lit(fact_id).cast("long")))


def update_summary(summaries: DataFrame, row_id: int, content: str) -> DataFrame:
    hit = F.col("id") == row_id
    out = summaries.withColumns({"content": F.when(hit, F.lit(content)).otherwise(F.col("content")), "embedding": F.when(~hit, F.col("embedding")), "summarized": F.col("summarized") | hit})
    return out.withColumn("search_text", F.when(hit, search_text(F.lit(content))).otherwise(F.col("search_text"))) if "search_text" in summaries.columns else out


def update_edge(edges: DataFrame, row_id: int, status: str, now: Column) -> DataFrame:
    """Sets one edge's status; an edge put down by hand says so, and its change shows in updated_at."""
    if status not in ("active", "pending", "superseded"):
        raise ValueError(f"unknown status: {status}")
    hit = F.col("id") == row_id
    new = {"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if "supersede_reason" in edges.columns:
        new["supersede_reason"] = F.when(hit, F.lit("manual") if status == "superseded" else F.lit(None)).otherwise(F.col("supersede_reason"))
    return edges.withColumns(new)


def erase_user(tables: dict[str, DataFrame], platform: str, uid: str) -> dict[str, DataFrame]:
    """All tables without one person; summaries stay."""
    own = (F.col("platform") == platform) & (F.col("user_id") == uid)
    ends = (F.col("platform") == platform) & ((F.col("subject_uid") == uid) | (F.col("object_uid") == uid))
    return {n: d.filter(~ends) if n == "edge" else d.filter(~own) if n in ("fact", "cluster", "profile", "alias") else d for n, d in tables.items()}


def allowed(events: DataFrame, users_: list[str], sessions: list[str]) -> DataFrame:
    """Events (platform, user_id, raw_session, session_id) of listed users (bare or platform:uid) in listed sessions (bare, platform:bare or full); two empty lists deny all."""
    if not users_ and not sessions:
        return events.filter(F.lit(False))
    who = F.col("user_id").isin(*users_) | F.concat("platform", F.lit(":"), "user_id").isin(*users_) if users_ else F.lit(True)
    keys = F.array(F.col("raw_session"), F.concat("platform", F.lit(":"), "raw_session"), F.col("session_id"))
    where = F.arrays_overlap(keys, F.array(*map(F.lit, sessions))) if sessions else F.lit(True)
    return events.filter(who & where)


def top_platform(rows: DataFrame) -> DataFrame:
    """The most frequent platform; of equals the one seen first (pos)."""
    return rows.groupBy("platform").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(1).select("platform")


def recent_by_session(summaries: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("occurred_at"), F.desc("id"))
    return summaries.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
