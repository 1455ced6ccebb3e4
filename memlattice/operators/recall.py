"""Scoped hybrid recall: predicates, vector and lexical legs, fusion, decay, near-duplicate removal, quotas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cosine, cosine_to, decay_factor, search_tokens

SCOPES = ("session", "user", "user_session")


@dataclass(frozen=True)
class Scope:
    """What a recall may see. Empty fields do not restrict."""

    scope: str = "session"
    session_id: str = ""
    platform: str = ""
    cross_session: bool = False
    user_keys: tuple[str, ...] = ()
    user_ids: tuple[str, ...] = ()
    expanded_keys: tuple[str, ...] = ()
    expanded_ids: tuple[str, ...] = ()
    entity_keys: tuple[str, ...] = ()
    entity_ids: tuple[str, ...] = ()
    exclude_kinds: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    exclude_recent: int = 0
    exclude_documents: tuple[str, ...] = ()
    archived: str = "hide"  # hide | include | only
    extra: tuple = field(default=())


def _session(s: Scope) -> Column:
    c = F.col("session_id") == s.session_id
    return c & (F.col("platform") == s.platform) if s.platform else c


def _member(keys: tuple[str, ...], ids: tuple[str, ...]) -> Column | None:
    keys, ids = tuple(k for k in keys if k), tuple(i for i in ids if i)
    parts = []
    if keys:
        parts.append(F.coalesce(F.arrays_overlap("participants", F.array(*map(F.lit, keys))), F.lit(False)))
    if ids:
        parts.append(F.col("user_id").isin(*ids))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def _any(parts: list[Column | None]) -> Column | None:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out | p
    return out


def predicate(s: Scope) -> Column:
    """The scope as one boolean expression, all of it below any top-k."""
    if s.scope not in SCOPES:
        raise ValueError(f"unknown scope: {s.scope}")
    done, bot = F.col("summarized"), F.col("kind") == "bot_self"
    own_bot = bot & _session(s) if s.session_id else None
    parts: list[Column] = []
    if s.scope == "session" and s.cross_session:
        parts.append((done & F.col("kind").isin("chat_summary", "bot_self")) | bot)
    elif s.scope == "session" and s.session_id:
        parts.append((_session(s) & done) | own_bot)
    elif s.scope == "user_session" and s.session_id:
        parts.append(_session(s) & done)
    entity = _member(s.entity_keys, s.entity_ids)
    primary = _any([_member(s.user_keys, s.user_ids), entity if s.cross_session else None])
    expanded = _member(s.expanded_keys, s.expanded_ids) if s.session_id else None
    pinned = entity if s.session_id and not s.cross_session else None
    people = _any([primary & done if primary is not None else None, expanded & done & _session(s) if expanded is not None else None, pinned & done & _session(s) if pinned is not None else None])
    if people is not None:
        parts.append(_any([people, own_bot]))
    if s.exclude_kinds:
        parts.append(~F.col("kind").isin(*s.exclude_kinds))
    parts += [~F.contains(F.col("content"), F.lit(k)) for k in s.blacklist]
    if s.exclude_documents:
        parts.append(~F.col("document_id").isin(*s.exclude_documents))
    where = None
    for p in parts:
        where = p if where is None else where & p
    if where is None:
        where = done | bot
    return where & {"hide": ~F.col("archived"), "only": F.col("archived"), "include": F.lit(True)}[s.archived]


def scoped(rows: DataFrame, s: Scope) -> DataFrame:
    """Rows within the scope, without the session's latest batches (any kind, summarized)."""
    out = rows.filter(predicate(s))
    if s.exclude_recent > 0 and s.session_id:
        latest = rows.filter(_session(s) & F.col("summarized")).orderBy(F.desc("occurred_at"), F.desc("id")).limit(s.exclude_recent).select("id")
        out = out.join(latest, "id", "left_anti")
    return out


def with_relevance(rows: DataFrame, query: list[float]) -> DataFrame:
    """Adds the cosine to the query; rows without a comparable vector go."""
    return rows.withColumn("relevance", cosine_to(F.col("embedding"), query)).filter(F.col("relevance").isNotNull())


def vector_leg(rows: DataFrame, query: list[float], s: Scope, n: int) -> DataFrame:
    return with_relevance(scoped(rows, s), query).orderBy(F.desc("relevance"), "id").limit(n)


def query_tokens(text: str) -> list[str]:
    """The different tokens of a query, as search_tokens gives them: a query is one short text, so no job is run for it."""
    out: list[str] = []
    for run in re.findall("[\u4e00-\u9fff]+", text):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return list(dict.fromkeys(out + [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]))


def _bm25(tf: Column, length: Column, df: Column, n: Column, avg: Column, k1: float, b: float) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


#: What tokens are made of.
_CJK, _WORD = "[\\x{4e00}-\\x{9fff}]", "[A-Za-z0-9]"


def _occurrences(token: str) -> Column:
    """How often a token of search_tokens occurs in content, without making the tokens."""
    if re.fullmatch("[a-z0-9]+", token):
        pattern = f"(?i)(?<!{_WORD}){token}(?!{_WORD})"
        return F.when(F.contains(F.lower("content"), F.lit(token)), F.regexp_count("content", F.lit(pattern))).otherwise(0)
    pattern = f"(?={token})" if len(token) > 1 else f"(?<!{_CJK}){token}(?!{_CJK})"
    return F.when(F.contains("content", F.lit(token)), F.regexp_count("content", F.lit(pattern))).otherwise(0)


def token_counts(rows: DataFrame, asked: list[str]) -> DataFrame:
    """(id, len, tfs): each row's number of tokens, and of each token asked; no token is made, let alone exploded.

    A run of n characters beyond ASCII makes n - 1 pairs, a single one itself. The narrow rows are exchanged once and
    serve both the statistics and the scores.
    """
    words = F.regexp_count("content", F.lit(f"{_WORD}+"))
    pairs = F.regexp_count("content", F.lit(f"{_CJK}(?={_CJK})")) + F.regexp_count("content", F.lit(f"(?<!{_CJK}){_CJK}(?!{_CJK})"))
    length = words + F.when(F.col("content").rlike(_CJK), pairs).otherwise(0)
    one = rows.select("id", F.coalesce(length, F.lit(0)).alias("len"), F.array(*[F.coalesce(_occurrences(w), F.lit(0)) for w in asked]).alias("tfs"))
    return one.repartition("id")


def lexical_scores(counts: DataFrame, n_asked: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, bm25) of the rows that hold a token asked; counts: as token_counts gives."""
    stats = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col("tfs")[i] > 0).alias(f"d{i}") for i in range(n_asked)])  # one row
    hits = counts.filter(F.exists("tfs", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(n_asked):
        own = _bm25(F.col("tfs")[i], F.col("len"), F.col(f"d{i}"), F.col("n"), F.col("avg"), k1, b)
        score = score + F.when(F.col("tfs")[i] > 0, own).otherwise(F.lit(0.0))
    return hits.select("id", score.alias("bm25"))


def indexed_scores(postings: DataFrame, stats: DataFrame, asked: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, bm25) from stored postings (bucket, token, id, tf, len) and stats (n, avg): only the query's buckets and tokens are read."""
    from ..sources.postings import bucket_of

    own = postings.filter(F.col("bucket").isin(*sorted({bucket_of(t) for t in asked})) & F.col("token").isin(*asked))
    df = own.groupBy("token").agg(F.count("*").alias("df"))  # a row for each token of the query
    scored = own.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))
    return scored.groupBy("id").agg(F.sum(_bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("n"), F.col("avg"), k1, b)).alias("bm25"))


def lexical_leg(rows: DataFrame, query_text: str, query: list[float], s: Scope, n: int, k1: float = 1.2, b: float = 0.75, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """BM25 over all rows' tokens, for scoped rows with a vector that hold any token of the query.

    index: stored postings and stats; without them the rows' tokens are counted anew.
    """
    asked = query_tokens(query_text)
    if not asked:
        return with_relevance(scoped(rows, s), query).withColumn("bm25", F.lit(0.0)).limit(0)
    ranked = lexical_scores(token_counts(rows, asked), len(asked), k1, b) if index is None else indexed_scores(*index, asked, k1, b)
    return with_relevance(scoped(rows, s), query).join(ranked, "id").orderBy(F.desc(F.round("bm25", 9)), "id").limit(n)


def fuse(vector: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion, ranks from 0; ties keep the vector leg's order, then the lexical one's."""
    v = vector.select("id", (F.row_number().over(Window.orderBy(F.desc("relevance"), "id")) - 1).alias("v_rank"))
    t = lexical.select("id", (F.row_number().over(Window.orderBy(F.desc(F.round("bm25", 9)), "id")) - 1).alias("t_rank"))
    both = v.join(t, "id", "full_outer")
    return both.withColumn("rrf", F.coalesce(1 / (k + F.col("v_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("t_rank")), F.lit(0.0)))


def hybrid(rows: DataFrame, query: list[float], query_text: str, s: Scope, n: int, k: int = 60, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Both legs fused, each computed once; without a token in the query the vector leg alone."""
    v = vector_leg(rows, query, s, n)
    if not query_tokens(query_text):
        return v.withColumn("rrf", F.lit(None).cast("double"))
    t = lexical_leg(rows, query_text, query, s, n, index=index)
    cols, none = v.columns, F.lit(None).cast("int")
    # the legs hold n rows each, so ranking them in one task is bounded
    v_rank = F.row_number().over(Window.orderBy(F.desc("relevance"), "id")) - 1
    t_rank = F.row_number().over(Window.orderBy(F.desc(F.round("bm25", 9)), "id")) - 1
    row = F.struct(*cols).alias("row")
    both = v.select("id", row, v_rank.alias("v_rank"), none.alias("t_rank")).unionByName(t.select("id", row, none.alias("v_rank"), t_rank.alias("t_rank")))
    one = both.groupBy("id").agg(F.any_value("row").alias("row"), F.max("v_rank").alias("v_rank"), F.max("t_rank").alias("t_rank"))
    rrf = F.coalesce(1 / (k + F.col("v_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("t_rank")), F.lit(0.0))
    return one.select("row.*", "v_rank", "t_rank", rrf.alias("rrf")).orderBy(F.desc("rrf"), F.col("v_rank").asc_nulls_last(), "t_rank")


def aged(rows: DataFrame, now: Column, half_life_days: float, score: str = "relevance") -> DataFrame:
    return rows.withColumn(score, F.col(score) * decay_factor(F.col("occurred_at"), now, half_life_days))


def reranked(rows: DataFrame, scores: DataFrame | None) -> DataFrame:
    """scores: (id, rerank). Missing ids score -1; without scores relevance stands in."""
    if scores is None:
        return rows.withColumn("score", F.col("relevance"))
    return rows.join(scores, "id", "left").withColumn("score", F.coalesce("rerank", F.lit(-1.0))).drop("rerank")


def keep_distinct(group: list[str], order: list[tuple[str, bool]], threshold: float, top_k: int | None):
    """A function for applyInPandas: drops a row iff an already kept one is as near as threshold; rows without a vector stay."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c, _ in order], ascending=[a for _, a in order], kind="stable")
        kept, vectors = [], []
        for i, raw in enumerate(pdf["embedding"]):
            v = None if raw is None else np.asarray(raw, dtype=np.float64)
            length = 0.0 if v is None or not v.size else float(np.sqrt(v @ v))
            if length > 0:
                if any(len(u) == len(v) and round(float(u @ v) / length, 12) >= threshold for u in vectors):
                    continue
                vectors.append(v / length)
            kept.append(i)
            if top_k is not None and len(kept) >= top_k:
                break
        return pdf.iloc[kept]

    return run


def distinct_vectors(rows: DataFrame, order: list[tuple[str, bool]], threshold: float = 0.85, top_k: int | None = None, group: list[str] | None = None) -> DataFrame:
    """Greedy removal of near duplicates in the given order, per group (a query's candidates: a bounded number of rows)."""
    keyed = rows if group else rows.withColumn("_all", F.lit(0))
    by = group or ["_all"]
    out = keyed.groupBy(*by).applyInPandas(keep_distinct(by, order, threshold, top_k), keyed.schema)
    return out if group else out.drop("_all")


def within_quota(rows: DataFrame, uids: list[str], platform: str, top_k: int, order: list[tuple[str, bool]]) -> DataFrame:
    """Per-user quotas: a row goes to its first listed owner with room, is dropped if its owners are full, else shares top_k slots."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c, _ in order], ascending=[a for _, a in order], kind="stable")
        left, shared, keep = dict.fromkeys(uids, top_k), top_k, []
        for i, (uid, people) in enumerate(zip(pdf["user_id"], pdf["participants"])):
            people = [] if people is None else list(people)
            owners = [u for u in uids if uid == u or f"{platform}:{u}" in people]
            if owners:
                owner = next((u for u in owners if left[u] > 0), None)
                if owner is None:
                    continue
                left[owner] -= 1
            elif shared > 0:
                shared -= 1
            else:
                continue
            keep.append(i)
        return pdf.iloc[keep]

    keyed = rows.withColumn("_all", F.lit(0))
    return keyed.groupBy("_all").applyInPandas(run, keyed.schema).drop("_all")


def within_budget(rows: DataFrame, order: list[Column], budget: int, text: str = "content", joint: int = 0, first_may_overflow: bool = True) -> DataFrame:
    """The longest prefix whose texts fit a budget of characters."""
    w = Window.orderBy(*order)
    run = F.sum(F.length(text) + joint).over(w.rowsBetween(Window.unboundedPreceding, 0)) - joint
    out = rows.withColumn("_run", run).withColumn("_at", F.row_number().over(w))
    fits = F.col("_run") <= budget
    return out.filter(fits | (F.col("_at") == 1) if first_may_overflow else fits).drop("_run", "_at")


def best_recent(rows: DataFrame, query: list[float], s: Scope, window: int = 8) -> DataFrame:
    """(best): the highest cosine among the session's latest summaries that have a vector; 0 if none."""
    latest = rows.filter(_session(s) & (F.col("kind") == "chat_summary") & F.col("summarized") & F.col("embedding").isNotNull()).orderBy(F.desc("occurred_at"), F.desc("id")).limit(window)
    return with_relevance(latest, query).agg(F.coalesce(F.max("relevance"), F.lit(0.0)).alias("best"))


def novel(rows: DataFrame, new: DataFrame, s: Scope, window: int = 8, threshold: float = 0.85) -> DataFrame:
    """new (session's summaries to write, with embedding) without those as near to one of its latest summaries as threshold.

    Rows without a vector are written anyway. The latest summaries are `window` rows, broadcast.
    """
    latest = rows.filter(_session(s) & (F.col("kind") == "chat_summary") & F.col("summarized") & F.col("embedding").isNotNull()).orderBy(F.desc("occurred_at"), F.desc("id")).limit(window)
    held = latest.agg(F.collect_list("embedding").alias("_held"))  # one row
    near = F.exists("_held", lambda v: F.coalesce(cosine(F.col("embedding"), v) >= threshold, F.lit(False)))
    return new.crossJoin(F.broadcast(held)).filter(~near).drop("_held")


def search(rows: DataFrame, query: list[float] | None, query_text: str, s: Scope, now: Column, top_k: int = 5, hybrid_on: bool = True, threshold: float = 0.0, half_life_days: float | None = 90.0, dedup: float | None = 0.85, rerank: DataFrame | None = None, candidates: int = 0, per_user: tuple[str, ...] = (), index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame | None:
    """The whole recall: candidates, rerank, threshold, decay, distinct vectors, quota or top-k. A blank query or no vector gives None.

    Scores of fused ranks have no threshold, as they are no similarities. A session scope without a platform does not
    restrict users, as their keys need one. Equal scores keep the order before them.
    """
    if not query_text.strip() or query is None:
        return None
    if s.scope == "session" and not s.platform:
        s = replace(s, user_keys=(), user_ids=(), expanded_keys=(), expanded_ids=(), entity_keys=(), entity_ids=())
    n = max(candidates if rerank is not None else 0, 4 * top_k * max(1, len(per_user)))
    both = hybrid_on and bool(query_tokens(query_text))
    found = hybrid(rows, query, query_text, s, n, index=index) if both else vector_leg(rows, query, s, n).withColumn("rrf", F.lit(None).cast("double"))
    before = [F.desc("rrf"), F.col("v_rank").asc_nulls_last(), F.col("t_rank").asc_nulls_last(), F.col("id")] if both else [F.desc("relevance"), F.col("id")]
    found = found.withColumn("_at", F.row_number().over(Window.orderBy(*before)))  # at most 2 n rows
    fused = both and rerank is None
    scored = reranked(found, rerank)
    if fused:
        scored = scored.withColumn("score", F.col("rrf"))
    elif threshold > 0:
        scored = scored.filter(F.col("score") >= threshold)
    if half_life_days:
        scored = aged(scored, now, half_life_days, "score")
    order = [("score", False), ("_at", True)]
    if dedup:
        scored = distinct_vectors(scored, order, dedup, None if per_user else top_k)
    if per_user:
        return within_quota(scored, list(per_user), s.platform, top_k, order).drop("_at")
    return scored.orderBy(F.desc("score"), "_at").limit(top_k).drop("_at")
