"""Registered queries of the engine over the derived views, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import admin, facts, graph, lifecycle, people, recall
from ..schemas import Config
from ..sources import importers, postings, scratch, store
from ..streaming import retain
from .views import frame, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The query vector is that of vec_id 0; sessions and users are picked from the data's own names.
SESSION, USER, NOW = "src3", "7", "2024-01-31 00:00:00"
CONFIG = Config(recent_expire_days=10, commitment_expire_days=15, pending_dead_days=12)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row, read by a pushed-down filter."""
    return list(frame(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


_stored: dict[tuple[str, str], str] = {}


def stored_postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The postings of v_summary, as a store keeps them: written once for an application and tables, then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        root = scratch.path(spark, "postings")
        postings.write(frame(spark, sf_dir, "v_summary"), root)
        _stored[key] = root
    return postings.read(spark, _stored[key])


COS = "round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6)"
Q = "qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
LATE = f"late AS (SELECT id FROM v_summary WHERE session_id = '{SESSION}' AND summarized ORDER BY occurred_at DESC, id DESC LIMIT 5)"
SCOPE = f"((session_id = '{SESSION}' AND summarized) OR (kind = 'bot_self' AND session_id = '{SESSION}')) AND NOT contains(content, 'worthless') AND NOT archived AND id NOT IN (SELECT id FROM late)"


def scope() -> recall.Scope:
    return recall.Scope(session_id=SESSION, blacklist=("worthless",), exclude_recent=5)


# -- recall -----------------------------------------------------------------------------------------------------


@query(f"WITH {Q}, {LATE}, s AS (SELECT id, document_id, {COS} AS relevance FROM v_summary, qv WHERE embedding IS NOT NULL AND {SCOPE}) SELECT * FROM s ORDER BY relevance DESC, id LIMIT 10")
def recall_vector(spark, d):
    return recall.vector_leg(frame(spark, d, "v_summary"), vector(spark, d), scope(), 10).select("id", "document_id", F.round("relevance", 6).alias("relevance"))


TOKENS = "list_transform(regexp_extract_all(content, '[A-Za-z0-9]+'), lambda x: lower(x))"
BM25 = f"""tk AS (SELECT id, {TOKENS} AS t FROM v_summary), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tk),
    p AS (SELECT id, len(t) AS l, unnest(t) AS w FROM tk), tf AS (SELECT id, l, w, count(*) AS f FROM p WHERE w IN ('the', 'heon', 'ation', 'password') GROUP BY ALL),
    df AS (SELECT w, count(*) AS d FROM tf GROUP BY w),
    b AS (SELECT id, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) AS bm25 FROM tf JOIN df USING (w), st GROUP BY id)"""
TEXT = "the heon ation password"


@query(f"WITH tk AS (SELECT id, {TOKENS} AS t FROM v_summary), p AS (SELECT id, len(t) AS l, unnest(t) AS w FROM tk) SELECT w AS token, count(DISTINCT id) AS df, count(*) AS tf, CAST(max(l) AS INT) AS longest FROM p GROUP BY w")
def postings_written(spark, d):
    """Writes the postings and reads them all: each token's documents, occurrences and longest document."""
    return stored_postings(spark, d)[0].groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"), F.max("len").alias("longest"))


@query(f"WITH {Q}, {LATE}, {BM25} SELECT id, round(bm25, 6) AS bm25 FROM v_summary JOIN b USING (id), qv WHERE embedding IS NOT NULL AND {SCOPE} ORDER BY round(b.bm25, 9) DESC, id LIMIT 10")
def recall_lexical(spark, d):
    return recall.lexical_leg(frame(spark, d, "v_summary"), TEXT, vector(spark, d), scope(), 10, index=stored_postings(spark, d)).select("id", F.round("bm25", 6).alias("bm25"))


FUSED = f"""{Q}, {LATE}, {BM25}, base AS (SELECT v_summary.*, {COS} AS rel, list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))) AS raw FROM v_summary, qv WHERE embedding IS NOT NULL AND {SCOPE}),
    vl AS (SELECT id, row_number() OVER (ORDER BY raw DESC, id) - 1 AS r FROM base QUALIFY r < 20), tl AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) - 1 AS r FROM base JOIN b USING (id) QUALIFY r < 20),
    fu AS (SELECT id, sum(1.0 / (60 + r)) AS rrf FROM (SELECT * FROM vl UNION ALL SELECT * FROM tl) GROUP BY id)"""


@query(f"WITH {FUSED} SELECT id, round(rrf, 8) AS rrf FROM fu")
def recall_hybrid_rrf(spark, d):
    return recall.hybrid(frame(spark, d, "v_summary"), vector(spark, d), TEXT, scope(), 20, index=stored_postings(spark, d)).select("id", F.round("rrf", 8).alias("rrf"))


@query(f"WITH {FUSED} SELECT id, round(rrf * pow(2.0, -((epoch_us({{now}}) - epoch_us(occurred_at)) / 86400000000.0) / 90.0), 8) AS score FROM fu JOIN base USING (id)")
def recall_decayed(spark, d):
    rows = recall.hybrid(frame(spark, d, "v_summary"), vector(spark, d), TEXT, scope(), 20, index=stored_postings(spark, d))
    return recall.aged(rows, now().cast("timestamp"), 90.0, "rrf").select("id", F.round("rrf", 8).alias("score"))


@query(f"""WITH RECURSIVE {Q}, c AS (SELECT id, raw, embedding, row_number() OVER (ORDER BY round(raw, 9) DESC, id) AS rn FROM (SELECT id, CAST(embedding AS DOUBLE[]) AS embedding, list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))) AS raw
        FROM v_summary, qv WHERE embedding IS NOT NULL AND summarized AND NOT archived) QUALIFY rn <= 40),
    w(rn, kept) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL SELECT w.rn + 1, CASE WHEN EXISTS (SELECT 1 FROM c x JOIN c y ON y.rn = w.rn + 1 WHERE list_contains(w.kept, x.id)
        AND list_dot_product(x.embedding, y.embedding) / (sqrt(list_dot_product(x.embedding, x.embedding)) * sqrt(list_dot_product(y.embedding, y.embedding))) >= 0.3) THEN w.kept ELSE list_append(w.kept, (SELECT id FROM c WHERE c.rn = w.rn + 1)) END FROM w WHERE w.rn < (SELECT count(*) FROM c))
    SELECT unnest(kept) AS id FROM w WHERE rn = (SELECT max(rn) FROM w)""")
def recall_dedup(spark, d):
    rows = recall.with_relevance(frame(spark, d, "v_summary").filter("summarized AND NOT archived"), vector(spark, d)).withColumn("relevance", F.round("relevance", 9))
    top = rows.orderBy(F.desc("relevance"), "id").limit(40)
    return recall.distinct_vectors(top, [("relevance", False), ("id", True)], 0.3).select("id")


@query(f"WITH {Q} SELECT id FROM v_summary WHERE summarized AND (list_has_any(participants, ['en:{USER}', 'fr:{USER}']) OR user_id IN ('{USER}', '8')) AND NOT archived AND kind NOT IN ('bot_self')")
def recall_scope_user(spark, d):
    s = recall.Scope("user", user_keys=(f"en:{USER}", f"fr:{USER}"), user_ids=(USER, "8"), exclude_kinds=("bot_self",))
    return recall.scoped(frame(spark, d, "v_summary"), s).select("id")


@query(f"""SELECT id FROM v_summary WHERE (session_id = '{SESSION}' AND summarized) AND (((user_id IN ('{USER}')) AND summarized) OR (user_id IN ('8', '9') AND summarized AND session_id = '{SESSION}')
    OR (list_has_any(participants, ['en:10']) AND summarized AND session_id = '{SESSION}') OR (kind = 'bot_self' AND session_id = '{SESSION}'))""")
def recall_scope_user_session(spark, d):
    s = recall.Scope("user_session", SESSION, user_ids=(USER,), expanded_ids=("8", "9"), entity_keys=("en:10",), archived="include")
    return recall.scoped(frame(spark, d, "v_summary"), s).select("id")


@query("SELECT id FROM v_summary WHERE ((summarized AND kind IN ('chat_summary', 'bot_self')) OR kind = 'bot_self') AND archived")
def recall_scope_cross_archived(spark, d):
    return recall.scoped(frame(spark, d, "v_summary"), recall.Scope(cross_session=True, archived="only")).select("id")


@query(f"WITH {Q} SELECT round(coalesce(max({COS}), 0.0), 6) AS best FROM (SELECT * FROM v_summary WHERE session_id = '{SESSION}' AND kind = 'chat_summary' AND summarized AND embedding IS NOT NULL ORDER BY occurred_at DESC, id DESC LIMIT 8) s, qv")
def write_dedup_best(spark, d):
    return recall.best_recent(frame(spark, d, "v_summary"), vector(spark, d), recall.Scope(session_id=SESSION)).select(F.round("best", 6).alias("best"))


FOUND = FUSED.replace(f"{LATE}, ", "").replace(SCOPE, "user_id IN ('7', '8', '9') AND summarized AND NOT archived")


@query(f"""WITH RECURSIVE {FOUND}, sc AS (SELECT base.id, rrf * pow(2.0, -((epoch_us({{now}}) - epoch_us(occurred_at)) / 86400000000.0) / 90.0) AS score, CAST(embedding AS DOUBLE[]) AS e,
        row_number() OVER (ORDER BY rrf DESC, vl.r ASC NULLS LAST, tl.r ASC NULLS LAST, base.id) AS pos FROM base JOIN fu USING (id) LEFT JOIN vl USING (id) LEFT JOIN tl USING (id)),
    c AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS rn FROM sc),
    w(rn, kept) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL SELECT w.rn + 1, CASE WHEN EXISTS (SELECT 1 FROM c x JOIN c y ON y.rn = w.rn + 1 WHERE list_contains(w.kept, x.id)
        AND list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.3) THEN w.kept ELSE list_append(w.kept, (SELECT id FROM c WHERE c.rn = w.rn + 1)) END FROM w WHERE w.rn < (SELECT count(*) FROM c)),
    k AS (SELECT unnest(kept) AS id FROM w WHERE rn = (SELECT max(rn) FROM w))
    SELECT id, round(score, 8) AS score FROM c JOIN k USING (id) ORDER BY rn LIMIT 5""")
def recall_search(spark, d):
    s = recall.Scope("user", platform="en", user_ids=("7", "8", "9"))
    out = recall.search(frame(spark, d, "v_summary"), vector(spark, d), TEXT, s, now().cast("timestamp"), dedup=0.3, index=stored_postings(spark, d))
    return out.select("id", F.round("score", 8).alias("score"))


@query()
def recall_quota(spark, d):
    """Per-user quotas are a fold over ranked rows; tests hold it against a plain one."""
    s = recall.Scope("user", platform="en", user_ids=("7", "8", "9"))
    out = recall.search(frame(spark, d, "v_summary"), vector(spark, d), TEXT, s, now().cast("timestamp"), per_user=("7", "8"), index=stored_postings(spark, d))
    return out.select("id", "user_id", F.round("score", 8).alias("score"))


# -- sessions and lifecycle -------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS a FROM v_summary WHERE session_id = '{SESSION}' AND summarized), k AS (SELECT count(*) FILTER (kind = 'bot_self') AS b FROM r WHERE a <= 6),
    c AS (SELECT id, document_id, row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS rn FROM r WHERE kind = 'chat_summary') SELECT id, document_id FROM c, k WHERE rn > greatest(0, 6 - b) AND rn <= greatest(0, 6 - b) + 3""")
def session_rollout(spark, d):
    return lifecycle.rollout(frame(spark, d, "v_summary"), SESSION, 6, 3).select("id", "document_id")


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS a FROM v_summary WHERE session_id = '{SESSION}' AND summarized AND kind = 'chat_summary' QUALIFY a <= 20) SELECT DISTINCT p AS key FROM (SELECT unnest(participants) AS p FROM r)""")
def session_participants(spark, d):
    return lifecycle.recent_participants(frame(spark, d, "v_summary"), SESSION, 20)


@query(f"""SELECT id, document_id FROM v_summary WHERE kind = 'chat_summary' AND summarized AND NOT archived AND list_has_any(participants, ['en:7', 'en:8', 'en:9', 'de:7']) AND NOT (session_id = '{SESSION}' AND platform = 'en' AND group_id <> '')
    AND occurred_at BETWEEN {{now}} - INTERVAL 29 DAYS AND {{now}} ORDER BY occurred_at DESC, id DESC LIMIT 20""")
def session_cross(spark, d):
    return lifecycle.cross_session(frame(spark, d, "v_summary"), ["en:7", "en:8", "en:9", "de:7"], now(), 20, 29, SESSION, "en", "gm").select("id", "document_id")


@query("SELECT count(*) AS n, count(*) FILTER (NOT archived AND written_at < {now} - INTERVAL 20 DAYS AND (last_recall_at IS NULL OR last_recall_at < {now} - INTERVAL 29 DAYS)) AS archived_now FROM v_summary")
def lifecycle_archive(spark, d):
    return lifecycle.archive(frame(spark, d, "v_summary"), now(), 20, 29).agg(F.count("*").alias("n"), F.count_if("archived_now").alias("archived_now"))


@query(f"""WITH o AS (SELECT id, occurred_at, length(content) + 1 AS l FROM v_summary WHERE session_id = '{SESSION}'), r AS (SELECT id, sum(l) OVER (ORDER BY occurred_at DESC, id DESC) - 1 AS run, row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS rn FROM o) SELECT id FROM r WHERE run <= 20000 OR rn = 1""")
def budget_prefix(spark, d):
    return recall.within_budget(frame(spark, d, "v_summary").filter(F.col("session_id") == SESSION), [F.desc("occurred_at"), F.desc("id")], 20000, "content", 1).select("id")


@query("SELECT session_id, id, rn FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, id DESC) AS rn FROM v_summary) WHERE rn <= 3")
def session_latest(spark, d):
    return admin.recent_by_session(frame(spark, d, "v_summary"), 3).select("session_id", "id", "rn")


# -- facts ------------------------------------------------------------------------------------------------------


ANCHOR = "an AS (SELECT cluster_id FROM (SELECT p.cluster_id, row_number() OVER (PARTITION BY p.platform, p.user_id, p.category ORDER BY p.score DESC, p.updated_at DESC, p.id) AS rn FROM v_profile p JOIN v_cluster c ON c.id = p.cluster_id WHERE p.category <> 'recent' AND c.contradicted_at IS NULL) WHERE rn <= 5)"


@query(f"WITH {ANCHOR} SELECT cluster_id FROM an")
def profile_anchors(spark, d):
    return facts.anchors(frame(spark, d, "v_profile"), frame(spark, d, "v_cluster"), 5)


LIVE = "lv AS (SELECT DISTINCT 'qq' AS platform, CAST(2 * CAST(user_id AS INT) AS VARCHAR) AS user_id FROM v_fact WHERE occurred_at > TIMESTAMP '2024-01-20 00:00:00' AND event_type <> 'error')"


def _activity(spark, d):
    """A summary for each fact: no trigger user, one participant, the bot's own for some."""
    seen = frame(spark, d, "v_fact")
    kind = F.when(F.col("event_type") == "error", "bot_self").otherwise("chat_summary")
    people_ = F.array(F.concat(F.lit("qq:"), (F.col("user_id").cast("int") * 2).cast("string"), F.lit(":lost")))
    return seen.select(kind.alias("kind"), "platform", F.lit("").alias("user_id"), people_.alias("participants"), "occurred_at")


@query(f"""WITH {ANCHOR}, {LIVE}, a AS (SELECT c.*, c.id IN (SELECT cluster_id FROM an) AS anchor, EXISTS (SELECT 1 FROM lv WHERE lv.platform = c.platform AND lv.user_id = c.user_id) AS live,
        status IN ('active', 'profiled') AND ((category = 'recent' AND occurred_at < {{now}} - INTERVAL 10 DAYS) OR (category = 'commitment' AND last_evidence_at < {{now}} - INTERVAL 15 DAYS)) AS expired FROM v_cluster c),
    b AS (SELECT *, CASE WHEN status IN ('active', 'profiled') AND NOT expired AND category <> 'recent' AND live AND NOT anchor THEN CASE WHEN evidence_count >= 4 AND contradicted_at IS NULL AND score * 0.9 < 2.0 THEN 2.0 ELSE score * 0.9 END ELSE score END AS s2 FROM a),
    e AS (SELECT *, status = 'profiled' AND NOT expired AND s2 < 2.0 AND live AND NOT anchor AS demoted FROM b),
    f AS (SELECT *, CASE WHEN expired OR demoted THEN 'pending_uncertain' ELSE status END AS st, CASE WHEN expired OR demoted THEN {{now}} ELSE demoted_at END AS dm FROM e)
    SELECT id, round(s2, 6) AS score, CASE WHEN st = 'pending_uncertain' AND live AND coalesce(dm, last_evidence_at, occurred_at) < {{now}} - INTERVAL 12 DAYS THEN 'dead' ELSE st END AS status, expired, demoted FROM f""")
def fact_decay(spark, d):
    out = facts.decay(frame(spark, d, "v_cluster"), frame(spark, d, "v_profile"), _activity(spark, d), now(), CONFIG, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return out.select("id", F.round("score", 6).alias("score"), "status", "expired", "demoted")


@query("SELECT id, CASE WHEN status = 'active' AND score >= CASE category WHEN 'recent' THEN 4.0 WHEN 'naming' THEN 3.0 ELSE 6.0 END THEN 'profiled' ELSE status END AS status FROM v_cluster")
def fact_promote(spark, d):
    return facts.promote(frame(spark, d, "v_cluster"), now(), CONFIG).select("id", "status")


def _incoming(spark, d):
    c = frame(spark, d, "v_cluster").select(F.col("id").alias("cluster_id"), "platform", "user_id", "category", F.col("canonical_statement").alias("event_type"))
    return frame(spark, d, "v_fact").withColumn("evidence_key", F.concat("evidence_key", F.when(F.col("id") % 3 == 0, "|x").otherwise(""))).join(c, ["platform", "user_id", "category", "event_type"])


@query("""WITH f AS (SELECT x.id, c.id AS cid, concat(x.evidence_key, CASE WHEN x.id % 3 = 0 THEN '|x' ELSE '' END) AS k, CASE WHEN x.confidence = 'high' THEN 3.0 ELSE 2.0 END AS p, x.occurred_at AS seen
        FROM v_fact x JOIN v_cluster c ON c.platform = x.platform AND c.user_id = x.user_id AND c.category = x.category AND c.canonical_statement = x.event_type),
    n AS (SELECT f.* FROM f JOIN v_cluster c ON c.id = f.cid WHERE NOT list_contains(c.evidence_keys, f.k) QUALIFY row_number() OVER (PARTITION BY cid, k ORDER BY f.id) = 1),
    g AS (SELECT cid, sum(p) AS p, count(*) AS n FROM n GROUP BY cid), m AS (SELECT cid, max(seen) AS seen FROM f GROUP BY cid)
    SELECT c.id, round(CASE WHEN g.n > 0 THEN least(10.0, c.score + g.p) ELSE c.score END, 6) AS score, CAST(c.evidence_count + coalesce(g.n, 0) AS INT) AS evidence_count, CASE WHEN g.n > 0 AND c.status IN ('pending_uncertain', 'dead') THEN 'active' ELSE c.status END AS status,
        CASE WHEN m.seen IS NULL THEN c.last_evidence_at ELSE greatest(c.last_evidence_at, m.seen) END AS last_evidence_at FROM v_cluster c LEFT JOIN g ON g.cid = c.id LEFT JOIN m ON m.cid = c.id""")
def fact_merge(spark, d):
    out = facts.merged(frame(spark, d, "v_cluster"), _incoming(spark, d), now(), CONFIG)
    return out.select("id", F.round("score", 6).alias("score"), F.col("evidence_count").cast("int").alias("evidence_count"), "status", "last_evidence_at")


@query("""WITH v AS (SELECT f.id AS fact_id, c.id AS cluster_id, row_number() OVER (PARTITION BY f.id ORDER BY c.id) AS rank, CASE (f.id + c.id) % 5 WHEN 0 THEN 'correction' WHEN 1 THEN 'same' ELSE 'unrelated' END AS verdict, c.status, f.confidence, f.occurred_at >= c.occurred_at AS ok
        FROM v_fact f JOIN v_cluster c ON c.user_id = f.user_id AND c.category = f.category WHERE f.extracted_flag = 0),
    a AS (SELECT fact_id, min(CASE WHEN verdict = 'correction' AND confidence = 'high' AND ok THEN rank END) AS r, min(CASE WHEN verdict = 'same' THEN rank END) AS s FROM v WHERE status <> 'replaced' GROUP BY fact_id)
    SELECT f.id AS fact_id, CASE WHEN a.r IS NOT NULL THEN 'replace' WHEN a.s IS NOT NULL THEN 'merge' ELSE 'create' END AS action, v.cluster_id FROM v_fact f LEFT JOIN a ON a.fact_id = f.id LEFT JOIN v ON v.fact_id = f.id AND v.rank = coalesce(a.r, a.s) WHERE f.extracted_flag = 0""")
def fact_actions(spark, d):
    from pyspark.sql import Window

    f, c = frame(spark, d, "v_fact").filter("extracted_flag = 0"), frame(spark, d, "v_cluster")
    pair = f.select(F.col("id").alias("fact_id"), "user_id", "category").join(c.select(F.col("id").alias("cluster_id"), "user_id", "category"), ["user_id", "category"])
    v = pair.withColumn("rank", F.row_number().over(Window.partitionBy("fact_id").orderBy("cluster_id")))
    m = (F.col("fact_id") + F.col("cluster_id")) % 5
    return facts.actions(f, c, v.withColumn("verdict", F.when(m == 0, "correction").when(m == 1, "same").otherwise("unrelated")))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT f.id AS fact_id, c.id AS cluster_id, c.updated_at, fe.v AS fv, CASE WHEN fe.v IS NOT NULL AND ce.v IS NOT NULL THEN list_dot_product(fe.v, ce.v) / (sqrt(list_dot_product(fe.v, fe.v)) * sqrt(list_dot_product(ce.v, ce.v))) END AS near
        FROM v_fact f JOIN v_cluster c ON c.platform = f.platform AND c.category = f.category AND list_has_any(list_append(c.related_user_ids, c.user_id), list_append(f.related_user_ids, f.user_id))
        LEFT JOIN e fe ON fe.vec_id = f.id % 997 LEFT JOIN e ce ON ce.vec_id = c.id % 499 WHERE f.extracted_flag = 0)
    SELECT fact_id, cluster_id, rank FROM (SELECT fact_id, cluster_id, row_number() OVER (PARTITION BY fact_id ORDER BY near DESC NULLS LAST, updated_at DESC, cluster_id) AS rank FROM p WHERE fv IS NULL OR near IS NOT NULL) WHERE rank <= 20""")
def fact_candidates(spark, d):
    e = frame(spark, d, "embeddings").select("vec_id", "embedding")
    f = frame(spark, d, "v_fact").filter("extracted_flag = 0").withColumn("vec_id", F.col("id") % 997).join(e, "vec_id", "left")
    c = frame(spark, d, "v_cluster").withColumn("vec_id", F.col("id") % 499).join(e, "vec_id", "left")
    return facts.candidates(f, c).select("fact_id", "cluster_id", "rank")


@query("SELECT category, status, count(*) AS n, round(sum(score), 6) AS score FROM v_cluster GROUP BY category, status")
def cluster_states(spark, d):
    return frame(spark, d, "v_cluster").groupBy("category", "status").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


# -- people -----------------------------------------------------------------------------------------------------


@query("""SELECT user_id, category, cluster_id, rn FROM (SELECT p.user_id, p.category, p.cluster_id, row_number() OVER (PARTITION BY p.platform, p.user_id, p.category ORDER BY CASE WHEN p.category = 'recent' THEN c.occurred_at END DESC NULLS LAST, p.score DESC, p.updated_at DESC, p.id) AS rn
    FROM v_profile p LEFT JOIN v_cluster c ON c.id = p.cluster_id) WHERE rn <= 3""")
def profile_sections(spark, d):
    return people.sections(frame(spark, d, "v_profile"), frame(spark, d, "v_cluster"), 3).select("user_id", "category", "cluster_id", "rn")


@query("""WITH j AS (SELECT p.*, c.occurred_at FROM v_profile p LEFT JOIN v_cluster c ON c.id = p.cluster_id WHERE p.user_id IN ('7', '8', '9', '10', '11')),
    o AS (SELECT *, max(score) OVER (PARTITION BY category, statement) AS top, row_number() OVER (PARTITION BY category, statement ORDER BY occurred_at DESC NULLS LAST, score DESC, updated_at DESC, id) AS k FROM j)
    SELECT category, cluster_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category = 'recent' THEN occurred_at END DESC NULLS LAST, top DESC, updated_at DESC, id) AS rn FROM o WHERE k = 1) WHERE rn <= 2""")
def profile_sections_multi(spark, d):
    owners = spark.createDataFrame([("qq", str(i)) for i in range(7, 12)], "platform string, user_id string")
    return people.sections_multi(frame(spark, d, "v_profile"), frame(spark, d, "v_cluster"), owners, 2).select("category", "cluster_id", "rn")


@query("SELECT user_id, id, canonical_statement FROM v_cluster WHERE status IN ('pending_uncertain', 'replaced') QUALIFY row_number() OVER (PARTITION BY platform, user_id ORDER BY occurred_at DESC, score DESC, updated_at DESC, id) <= 5")
def profile_uncertain(spark, d):
    return people.uncertain(frame(spark, d, "v_cluster")).select("user_id", "id", "canonical_statement")


@query("SELECT user_id, arg_max(display_name, occurred_at) AS display_name FROM v_fact WHERE display_name <> '' GROUP BY platform, user_id")
def display_names(spark, d):
    return people.latest_names(frame(spark, d, "v_fact")).select("user_id", "display_name")


@query("""SELECT user_id, name FROM (SELECT user_id, name, row_number() OVER (PARTITION BY platform, user_id ORDER BY last_seen DESC, name) AS rn FROM v_alias WHERE NOT regexp_matches(lower(name), '^(unknown|undefined|[0-9]+)$') AND trim(name) <> '') WHERE rn = 1""")
def alias_canonical(spark, d):
    a = frame(spark, d, "v_alias")
    return people.names_by_owner(a, a.select("platform", "user_id")).select("user_id", "name")


@query("SELECT name, min(user_id) AS user_id FROM v_alias WHERE NOT regexp_matches(lower(name), '^(unknown|undefined|[0-9]+)$') GROUP BY name HAVING count(DISTINCT user_id) = 1")
def alias_directory(spark, d):
    return graph.directory(frame(spark, d, "v_alias")).select("name", "user_id")


@query("""WITH n AS (SELECT user_id, name, max(last_seen) AS last_seen, any_value('batch') AS source FROM v_alias WHERE id % 2 = 0 GROUP BY user_id, name), o AS (SELECT user_id, name, max(last_seen) AS last_seen FROM v_alias WHERE id % 2 = 1 GROUP BY user_id, name)
    SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.name, n.name) AS name, greatest(o.last_seen, n.last_seen) AS last_seen, CASE WHEN o.last_seen IS NULL OR n.last_seen > o.last_seen THEN 'new' ELSE 'old' END AS source FROM o FULL JOIN n ON n.user_id = o.user_id AND n.name = o.name""")
def alias_merge(spark, d):
    a = frame(spark, d, "v_alias")
    old = a.filter("id % 2 = 1").groupBy("platform", "user_id", "name").agg(F.min("id").alias("id"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).withColumn("source", F.lit("old"))
    return people.alias_upsert(old, a.filter("id % 2 = 0").withColumn("source", F.lit("new"))).select("user_id", "name", "last_seen", "source")


@query("""WITH n AS (SELECT DISTINCT platform, user_id, name, lower(name) AS key FROM v_alias WHERE length(name) >= 2), u AS (SELECT key FROM n GROUP BY key HAVING count(*) = 1),
    t AS (SELECT a.id AS text_id, lower(concat('Hello ', a.name, ', see ', coalesce(b.name, ''), '!')) AS t FROM v_alias a LEFT JOIN v_alias b ON b.id = a.id + 1)
    SELECT text_id, user_id, name FROM (SELECT t.text_id, n.user_id, n.name, row_number() OVER (PARTITION BY t.text_id ORDER BY length(n.key) DESC, n.key, n.platform, n.user_id) AS rn FROM t JOIN n ON contains(t.t, n.key) JOIN u ON u.key = n.key) WHERE rn <= 4""")
def alias_match(spark, d):
    a = frame(spark, d, "v_alias").select("id", "platform", "user_id", "name", "last_seen")
    after = a.select((F.col("id") - 1).alias("id"), F.col("name").alias("other"))
    text = F.concat(F.lit("Hello "), "name", F.lit(", see "), F.coalesce("other", F.lit("")), F.lit("!"))
    return people.matched(a.join(after, "id", "left").select(F.col("id").alias("text_id"), text.alias("text")), a).select("text_id", "user_id", "name")


# -- graph ------------------------------------------------------------------------------------------------------


PH = "regexp_matches(lower({0}), '^(unknown|undefined|[0-9]+)$')"
CANON = f"cn AS (SELECT platform, user_id, name FROM (SELECT *, row_number() OVER (PARTITION BY platform, user_id ORDER BY last_seen DESC, name) AS rn FROM v_alias WHERE NOT {PH.format('name')}) WHERE rn = 1)"
DEAD = "dd AS (SELECT id FROM v_cluster WHERE status IN ('dead', 'replaced'))"
KEYS = "ek AS (SELECT id, unnest(evidence_keys) AS k FROM v_edge WHERE status = 'active'), es AS (SELECT id, k, CASE WHEN regexp_matches(k, '^backfill\\|[0-9]+$') THEN CAST(substring(k, 10) AS BIGINT) END AS c FROM ek)"


@query(f"""WITH {CANON}, {DEAD}, {KEYS}, act AS (SELECT * FROM v_edge WHERE status = 'active')
    SELECT (SELECT count(*) FROM v_edge WHERE evidence_count <> len(evidence_keys)) AS evidence_mismatch, (SELECT count(*) FROM act a JOIN act b ON b.platform = a.platform AND b.subject_uid = a.object_uid AND b.object_uid = a.subject_uid AND b.id > a.id) AS mirror_active_pairs,
    (SELECT count(*) FROM act WHERE {PH.format('subject_name')} OR {PH.format('object_name')}) AS placeholder_names, (SELECT count(*) FROM act WHERE length(relation_label) NOT BETWEEN 2 AND 8) AS bad_labels,
    (SELECT count(*) FROM v_edge WHERE status = 'pending' AND last_seen < {{now}} - INTERVAL 14 DAYS) AS pending_stale,
    (SELECT count(*) FROM act a LEFT JOIN cn s ON s.platform = a.platform AND s.user_id = a.subject_uid LEFT JOIN cn o ON o.platform = a.platform AND o.user_id = a.object_uid WHERE s.name <> a.subject_name OR o.name <> a.object_name) AS stale_names,
    (SELECT count(DISTINCT id) FROM es WHERE c IN (SELECT id FROM dd)) AS edges_dead_source""")
def graph_integrity(spark, d):
    return graph.integrity(frame(spark, d, "v_edge"), frame(spark, d, "v_alias"), frame(spark, d, "v_cluster"), now())


@query(f"""WITH {DEAD}, k AS (SELECT id, unnest(list_transform(evidence_keys, lambda x: replace(x, 's|', 'backfill|'))) AS k FROM v_edge WHERE status = 'active')
    SELECT id FROM k GROUP BY id HAVING bool_and(CAST(substring(k, 10) AS BIGINT) IN (SELECT id FROM dd))""")
def graph_dead_sources(spark, d):
    e = frame(spark, d, "v_edge").withColumn("evidence_keys", F.transform("evidence_keys", lambda k: F.replace(k, F.lit("s|"), F.lit("backfill|"))))
    dead = frame(spark, d, "v_cluster").filter("status IN ('dead', 'replaced')").select(F.col("id").alias("cluster_id"))
    return graph.only_dead_sources(e, dead).select("id")


@query("SELECT id, evidence_count FROM v_edge WHERE status = 'active' AND (subject_uid IN ('1', '2', '3') OR object_uid IN ('1', '2', '3')) ORDER BY evidence_count DESC, last_seen DESC, id LIMIT 64")
def graph_active_edges(spark, d):
    return graph.active_edges(frame(spark, d, "v_edge"), ["qq:1", "qq:2", "qq:3"]).select("id", "evidence_count")


@query("""WITH c AS (SELECT *, CASE WHEN subject_uid IN ('1', '2', '3') THEN subject_uid WHEN object_uid IN ('1', '2', '3') THEN object_uid END AS a FROM v_edge WHERE status = 'active' AND contains('so 1-urgent and 2-high', relation_label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY evidence_count DESC, last_seen DESC, id) AS rn FROM c WHERE a IS NOT NULL) SELECT id, concat('qq:', a) AS anchor FROM r WHERE rn <= 2 ORDER BY evidence_count DESC, last_seen DESC, id LIMIT 5""")
def graph_selected(spark, d):
    out = graph.selected(frame(spark, d, "v_edge").filter("status = 'active'"), "so 1-urgent and 2-high", ["qq:1", "qq:2", "qq:3"], ["0"], "none", False, [], 2, 5)
    return out.select("id", "anchor")


@query("""WITH r AS (SELECT DISTINCT platform, CASE WHEN id % 3 = 2 THEN object_uid ELSE subject_uid END AS subject_uid, CASE WHEN id % 3 = 2 THEN subject_uid ELSE object_uid END AS object_uid,
        CASE WHEN id % 3 = 1 THEN concat(relation_label, 'x') ELSE relation_label END AS relation_label FROM v_edge),
    b AS (SELECT * FROM r UNION SELECT platform, object_uid, subject_uid, relation_label FROM r)
    SELECT e.subject_uid, e.object_uid, e.relation_label FROM v_edge e SEMI JOIN b ON b.subject_uid = e.subject_uid AND b.object_uid = e.object_uid AND b.relation_label = e.relation_label WHERE e.status <> 'superseded'""")
def graph_probe(spark, d):
    e = frame(spark, d, "v_edge")
    turned = F.col("id") % 3 == 2
    asked = e.select(
        "platform", F.when(turned, F.col("object_uid")).otherwise(F.col("subject_uid")).alias("subject_uid"), F.when(turned, F.col("subject_uid")).otherwise(F.col("object_uid")).alias("object_uid"),
        F.when(F.col("id") % 3 == 1, F.concat("relation_label", F.lit("x"))).otherwise(F.col("relation_label")).alias("relation_label"),
    )
    return graph.probe(e, asked).select("subject_uid", "object_uid", "relation_label")


@query("""WITH t AS (SELECT * FROM v_edge ORDER BY evidence_count DESC, last_seen DESC, id LIMIT 500) SELECT concat('qq:', u) AS node, count(*) AS degree FROM (SELECT subject_uid AS u FROM t UNION ALL SELECT object_uid FROM t) GROUP BY u""")
def graph_nodes(spark, d):
    return graph.graph(frame(spark, d, "v_edge"), frame(spark, d, "v_alias"))[0].select("node", "degree")


def _relations(spark, d):
    e = frame(spark, d, "v_edge")
    return e.select("platform", F.when(F.col("id") % 4 == 0, F.col("object_uid")).otherwise(F.col("subject_uid")).alias("subject_uid"), F.when(F.col("id") % 4 == 0, F.col("subject_uid")).otherwise(F.col("object_uid")).alias("object_uid"), "relation_label", F.col("object_name").alias("subject_name"), "object_name", "statement", "confidence", F.col("last_seen").alias("occurred_at"), F.concat(F.lit("n|"), (F.col("id") % 3).cast("string")).alias("evidence_key"), F.lit(False).alias("is_bot_edge"), F.lit(1).alias("min_evidence"), F.lit(True).alias("count_on_conflict"), F.col("id").alias("pos"))


@query("""WITH r AS (SELECT platform, CASE WHEN id % 4 = 0 THEN object_uid ELSE subject_uid END AS subject_uid, CASE WHEN id % 4 = 0 THEN subject_uid ELSE object_uid END AS object_uid, relation_label, confidence, concat('n|', id % 3) AS k, id AS pos
        FROM v_edge WHERE relation_label <> '5-low'),
    lv AS (SELECT subject_uid, object_uid, relation_label FROM v_edge WHERE status <> 'superseded'),
    j AS (SELECT r.*, own.subject_uid IS NOT NULL AS known, mir.subject_uid IS NOT NULL AS mirror,
        first_value(r.subject_uid) OVER (PARTITION BY r.platform, least(r.subject_uid, r.object_uid), greatest(r.subject_uid, r.object_uid), r.relation_label ORDER BY pos) AS fs FROM r
        LEFT JOIN lv own ON own.subject_uid = r.subject_uid AND own.object_uid = r.object_uid AND own.relation_label = r.relation_label
        LEFT JOIN lv mir ON mir.subject_uid = r.object_uid AND mir.object_uid = r.subject_uid AND mir.relation_label = r.relation_label),
    b AS (SELECT subject_uid, object_uid, relation_label, list(DISTINCT k) AS ks, bool_or(confidence = 'high') AS hi, arg_min(confidence, pos) AS c1 FROM j WHERE known OR NOT (mirror OR fs <> subject_uid) GROUP BY ALL),
    o AS (SELECT coalesce(e.subject_uid, b.subject_uid) AS subject_uid, coalesce(e.object_uid, b.object_uid) AS object_uid, coalesce(e.relation_label, b.relation_label) AS relation_label, coalesce(e.status, 'active') AS status,
        CASE WHEN b.hi THEN 'high' ELSE coalesce(e.confidence, b.c1) END AS confidence, coalesce(e.evidence_count, 0) AS n, coalesce(e.evidence_keys, CAST([] AS VARCHAR[])) AS old, coalesce(b.ks, CAST([] AS VARCHAR[])) AS ks
        FROM v_edge e FULL JOIN b ON b.subject_uid = e.subject_uid AND b.object_uid = e.object_uid AND b.relation_label = e.relation_label)
    SELECT subject_uid, object_uid, relation_label, status, confidence, CAST(n + len(list_filter(ks, lambda x: NOT list_contains(old, x))) AS INT) AS evidence_count,
        array_to_string(list_sort(list_concat(old, list_filter(ks, lambda x: NOT list_contains(old, x)))), ',') AS evidence_keys FROM o""")
def graph_upsert(spark, d):
    out = graph.upserted(frame(spark, d, "v_edge"), _relations(spark, d), now(), ["5-low"])
    return out.select("subject_uid", "object_uid", "relation_label", "status", "confidence", "evidence_count", F.array_join(F.array_sort("evidence_keys"), ",").alias("evidence_keys"))


@query("SELECT id FROM v_cluster WHERE status IN ('active', 'profiled') AND trim(canonical_statement) <> '' AND id > 100 AND user_id <> '3' ORDER BY id LIMIT 40")
def backfill_sources(spark, d):
    return graph.backfill_sources(frame(spark, d, "v_cluster"), 100, 40, "3").select("id")


# -- admin ------------------------------------------------------------------------------------------------------


@query("""SELECT (SELECT count(*) FROM v_summary) AS summaries, (SELECT count(*) FROM v_summary WHERE NOT summarized) AS unsummarized, (SELECT count(*) FROM v_summary WHERE archived) AS archived, (SELECT count(*) FROM v_fact) AS facts, (SELECT count(*) FROM v_fact WHERE extracted_flag = 0) AS pending_facts,
    (SELECT count(*) FROM v_cluster) AS clusters, (SELECT count(*) FROM v_cluster WHERE status = 'profiled') AS profiled, (SELECT count(*) FROM v_cluster WHERE status = 'pending_uncertain') AS uncertain, (SELECT count(DISTINCT (platform, user_id)) FROM v_cluster) AS users,
    (SELECT count(*) FROM v_profile) AS profiles, (SELECT count(*) FROM v_edge) AS edges, (SELECT count(*) FROM v_alias) AS aliases""")
def admin_overview(spark, d):
    return admin.overview(*[frame(spark, d, f"v_{t}") for t in ("summary", "fact", "cluster", "profile", "edge", "alias")])


@query("""WITH o AS (SELECT platform, user_id FROM v_cluster UNION SELECT platform, user_id FROM v_fact), l AS (SELECT user_id, max(t) AS latest FROM (SELECT user_id, updated_at AS t FROM v_cluster UNION ALL SELECT user_id, occurred_at FROM v_fact) GROUP BY user_id),
    c AS (SELECT user_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'profiled') AS profiled, count(*) FILTER (status = 'pending_uncertain') AS pending_uncertain, count(*) FILTER (status = 'dead') AS dead, max(score) AS max_score FROM v_cluster GROUP BY user_id),
    n AS (SELECT user_id, arg_max(display_name, occurred_at) AS name FROM v_fact WHERE display_name <> '' GROUP BY user_id) SELECT o.user_id, coalesce(active, 0) AS active, coalesce(profiled, 0) AS profiled, coalesce(pending_uncertain, 0) AS pending_uncertain, coalesce(dead, 0) AS dead, round(max_score, 6) AS max_score, latest, name FROM o LEFT JOIN c USING (user_id) LEFT JOIN l USING (user_id) LEFT JOIN n USING (user_id)""")
def admin_users(spark, d):
    return admin.users(frame(spark, d, "v_cluster"), frame(spark, d, "v_fact")).select("user_id", "active", "profiled", "pending_uncertain", "dead", F.round("max_score", 6).alias("max_score"), "latest", "name")


@query("SELECT id, statement FROM v_fact WHERE user_id = '7' AND confidence = 'high' AND contains(lower(statement), 'click') ORDER BY id DESC LIMIT 20 OFFSET 0")
def admin_facts(spark, d):
    rows = admin.browse_facts(frame(spark, d, "v_fact"), user_id="7", category="nonsense", confidence="high", q="CLICK")
    return admin.paged(rows, [F.desc("id")]).select("id", "statement")


@query("SELECT id, round(score, 6) AS score FROM v_cluster WHERE category = 'stable' AND len(list_filter(evidence_keys, lambda k: starts_with(k, 's7|'))) > 0 ORDER BY score DESC, updated_at DESC, id LIMIT 10 OFFSET 10")
def admin_clusters(spark, d):
    rows = admin.browse_clusters(frame(spark, d, "v_cluster"), category="stable", session_id="s7")
    return admin.paged(rows, [F.desc("score"), F.desc("updated_at"), F.col("id")], 2, 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id FROM v_summary WHERE session_id = '{SESSION}' AND kind = 'chat_summary' AND contains(lower(content), 'the') ORDER BY occurred_at DESC, id DESC LIMIT 20")
def admin_summaries(spark, d):
    return admin.paged(admin.browse_summaries(frame(spark, d, "v_summary"), SESSION, kind="chat_summary", q="THE"), [F.desc("occurred_at"), F.desc("id")]).select("id")


# -- scalars, ingest and streams ----------------------------------------------------------------------------------


@query("SELECT id, document_id, concat(session_id, '|', CAST(CAST(occurred_at AS DATE) AS VARCHAR)) AS evidence FROM v_summary")
def keys(spark, d):
    s = frame(spark, d, "v_summary")
    return s.select("id", X.summary_key(F.col("session_id"), F.col("content")).alias("document_id"), X.evidence_key(F.col("session_id"), F.col("occurred_at").cast("timestamp")).alias("evidence"))


@query(f"SELECT id, array_to_string({TOKENS}, ' ') AS search_text FROM v_summary")
def tokens(spark, d):
    return frame(spark, d, "v_summary").select("id", X.search_text(F.col("content")).alias("search_text"))


@query("""SELECT id, CASE WHEN dd <= 0 THEN '今天' WHEN dd = 1 THEN '昨天' WHEN dd < 7 THEN concat(dd, '天前') WHEN dd < 30 THEN concat('约', dd // 7, '周前') ELSE concat('约', dd // 30, '个月前') END AS label
    FROM (SELECT id, date_diff('day', CAST(occurred_at AS DATE), DATE '2024-01-31') AS dd FROM v_summary)""")
def time_labels(spark, d):
    return frame(spark, d, "v_summary").select("id", X.time_label(F.col("occurred_at").cast("timestamp"), now().cast("timestamp"), "UTC", "relative").alias("label"))


@query("SELECT id, content AS text FROM v_summary WHERE embedding IS NULL AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> '' ORDER BY id LIMIT 50")
def missing_embeddings(spark, d):
    return store.missing_embeddings("summary", frame(spark, d, "v_summary"), 50)


@query("""WITH o AS (SELECT document_id FROM v_summary WHERE id % 3 = 0), n AS (SELECT document_id, least(occurred_at, TIMESTAMP '2024-01-02 00:00:00') AS seen, row_number() OVER (PARTITION BY document_id ORDER BY occurred_at) AS k FROM v_summary WHERE id % 3 <> 0)
    SELECT n.document_id, seen AS occurred_at FROM n ANTI JOIN o ON o.document_id = n.document_id WHERE k = 1""")
def insert_summaries(spark, d):
    s = frame(spark, d, "v_summary")
    old = s.filter("id % 3 = 0").select("id", "document_id", "session_id", "content", "occurred_at")
    out = store.insert_summaries(old, s.filter("id % 3 <> 0").select("document_id", "session_id", "content", "occurred_at"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return out.join(old.select("id"), "id", "left_anti").select("document_id", "occurred_at")


LINES = """WITH l AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM v_line)
    SELECT session_key, CAST(done // CASE WHEN contains(session_key, ':gm:') THEN 1 ELSE 5 END AS BIGINT) AS batch_no, count(*) AS n_lines, count(*) FILTER (role = 'assistant') AS rounds, count(DISTINCT CASE WHEN role <> 'assistant' THEN uid END) AS n_people, sum(length(text)) AS chars FROM l GROUP BY 1, 2"""


@query(LINES)
def retain_batches(spark, d):
    return retain.offline(frame(spark, d, "v_line"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1800 SECONDS THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT CAST(user_id AS VARCHAR) AS session, min(ts) AS start, max(ts) + INTERVAL 1800 SECONDS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def retain_idle(spark, d):
    e = frame(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), "ts")
    return retain.idle_batches(e).select("session", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH c AS (SELECT session_key, conv_id, count(*) AS n, count(*) FILTER (role = 'user' AND trim(text) <> '') AS u FROM v_line GROUP BY session_key, conv_id)
    SELECT count(DISTINCT session_key) AS sessions, count(*) AS chunks_total, count(*) FILTER (u > 0) AS chunks, count(*) FILTER (u = 0) AS bot_only, CAST(coalesce(sum(CASE WHEN u > 0 THEN n END), 0) AS BIGINT) AS messages, CAST(0 AS BIGINT) AS notices FROM c""")
def import_preview(spark, d):
    m = F.struct("role", F.col("text").alias("content"), F.col("uid").alias("sender_id"), F.lit(None).cast("string").alias("sender_name"))
    chunks = frame(spark, d, "v_line").groupBy("session_key", F.col("conv_id").alias("chunk_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("chunk"))
    return importers.preview(chunks)


@query("""WITH t AS (SELECT id, user_id, category, CASE WHEN id % 2 = 0 THEN canonical_statement ELSE concat(canonical_statement, '|x') END AS canonical_statement FROM v_cluster), m AS (SELECT max(id) AS top FROM t),
    s AS (SELECT c.id AS old_id, t.id AS have FROM v_cluster c LEFT JOIN t ON t.user_id = c.user_id AND t.category = c.category AND t.canonical_statement = c.canonical_statement)
    SELECT old_id, coalesce(have, top + row_number() OVER (PARTITION BY have IS NULL ORDER BY old_id)) AS new_id FROM s, m""")
def migrate_ids(spark, d):
    c = frame(spark, d, "v_cluster")
    have = c.withColumn("canonical_statement", F.concat("canonical_statement", F.when(F.col("id") % 2 == 0, "").otherwise("|x")))
    return store.id_map(c, have, ["user_id", "category", "canonical_statement"])


from . import state_queries  # noqa: E402, F401 - registers the queries of state changes
