"""Registered queries of state changes, ingest and tools, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import admin, backfill, consolidation, facts, graph, ingest, lifecycle, people, recall, tools
from ..sources import encoders, store
from ..sources.scratch import saved
from ..streaming import retain
from .queries import BM25, CONFIG, LATE, PH, SCOPE, SESSION, TEXT, Q, now, query, scope, vector
from .views import frame

THRESHOLD = "CASE category WHEN 'recent' THEN 4.0 WHEN 'naming' THEN 3.0 ELSE 6.0 END"

# -- facts --------------------------------------------------------------------------------------------------------

TODO = """t AS (SELECT f.*, CASE WHEN f.confidence = 'high' THEN 3.0 ELSE 2.0 END AS points, k.cid, CASE WHEN k.cid IS NULL OR f.id % 5 > 2 THEN 'create' WHEN f.id % 5 = 0 THEN 'replace' ELSE 'merge' END AS action
        FROM v_fact f LEFT JOIN (SELECT user_id, category, min(id) AS cid FROM v_cluster GROUP BY user_id, category) k ON k.user_id = f.user_id AND k.category = f.category WHERE f.extracted_flag = 0),
    fx AS (SELECT cid, min(id) AS fix FROM t WHERE action = 'replace' GROUP BY cid),
    ok AS (SELECT t.* FROM t LEFT JOIN fx ON fx.cid = t.cid LEFT JOIN v_cluster c ON c.id = t.cid
        WHERE action = 'create' OR (c.status <> 'replaced' AND (fix IS NULL OR t.id < fix OR (t.id = fix AND action = 'replace'))))"""


#: Clusters of the fact's own claim, drift of the person's other claims, and facts of one claim that make one cluster.
CYCLE = """f AS (SELECT * FROM v_fact WHERE extracted_flag = 0),
    own AS (SELECT f.id, min(c.id) FILTER (c.status <> 'replaced') AS cid FROM f JOIN v_cluster c ON c.user_id = f.user_id AND c.category = f.category AND c.canonical_statement = f.event_type GROUP BY f.id),
    d AS (SELECT f.id, c.id AS cid FROM f JOIN v_cluster c ON c.user_id = f.user_id AND c.category = f.category AND c.canonical_statement <> f.event_type AND (f.id + c.id) % 5 = 0),
    a AS (SELECT f.id, own.cid, f.user_id, f.category, f.event_type, f.evidence_key, min(f.id) FILTER (own.cid IS NULL) OVER (PARTITION BY f.user_id, f.category, f.event_type) AS first FROM f LEFT JOIN own ON own.id = f.id)"""


def _cycle(spark, d):
    """Decisions on every pending fact: the same claim joins, another claim of the person is drift now and then, all else is unrelated."""
    f = frame(spark, d, "v_fact").withColumn("embedding", F.lit(None).cast("array<float>"))
    none = {n: F.lit(None).cast("timestamp") for n in ("demoted_at", "contradicted_at")}
    c = frame(spark, d, "v_cluster").withColumns({"embedding": F.lit(None).cast("array<float>"), "replaced_by": F.lit(None).cast("long"), "source_fact_ids": F.array("id"), "written_at": F.col("updated_at"), **none})
    batch = f.filter("extracted_flag = 0")
    pairs = facts.candidates(batch, c, 1 << 30)
    claim = batch.select(F.col("id").alias("fact_id"), F.col("user_id").alias("u"), F.col("event_type").alias("e"))
    on = pairs.join(claim, "fact_id").join(c.select(F.col("id").alias("cluster_id"), "user_id", "canonical_statement"), "cluster_id")
    mine, again = F.col("u") == F.col("user_id"), F.col("e") == F.col("canonical_statement")
    drift = mine & ((F.col("fact_id") + F.col("cluster_id")) % 5 == 0)
    old = on.select("fact_id", F.col("cluster_id").cast("string").alias("cluster_id"), F.lit(None).cast("long").alias("made_by"), F.when(mine & again, "same").when(drift, "drift").otherwise("unrelated").alias("verdict"))
    person = lambda x, n: x.select(F.col("id").alias(n), "category", F.explode(F.array_distinct(F.concat(F.array("user_id"), "related_user_ids"))).alias("p"))
    met = person(batch, "fact_id").join(person(batch, "made_by"), ["category", "p"]).filter("made_by < fact_id").select("fact_id", "made_by").distinct()
    met = met.join(claim, "fact_id").join(claim.toDF("made_by", "u2", "e2"), "made_by")
    new = met.select("fact_id", F.lit(None).cast("string").alias("cluster_id"), "made_by", F.when((F.col("u") == F.col("u2")) & (F.col("e") == F.col("e2")), "same").otherwise("unrelated").alias("verdict"))
    return f, c, saved(consolidation.decided(batch, c, old.unionByName(new), CONFIG, 1 << 30), "decisions")


@query(f"""WITH {CYCLE} SELECT a.id AS fact_id, CASE WHEN cid IS NOT NULL OR a.id > first THEN 'merge' ELSE 'create' END AS action, cid AS cluster_id, CASE WHEN cid IS NULL AND a.id > first THEN first END AS made_by,
    CAST(CASE WHEN cid IS NULL AND a.id > first THEN 1 ELSE 0 END AS INTEGER) AS level, CAST(coalesce(m.n, 0) AS BIGINT) AS n_marks FROM a LEFT JOIN (SELECT id, count(*) AS n FROM d GROUP BY id) m ON m.id = a.id""")
def fact_cycle(spark, d):
    return _cycle(spark, d)[2].select("fact_id", "action", "cluster_id", "made_by", "level", F.size("marks").cast("long").alias("n_marks"))


@query(f"""WITH {CYCLE}, g AS (SELECT cid, max(fid) AS grew FROM (SELECT a.cid, a.evidence_key, min(a.id) AS fid, any_value(c.evidence_keys) AS had FROM a JOIN v_cluster c ON c.id = a.cid GROUP BY a.cid, a.evidence_key) WHERE NOT list_contains(had, evidence_key) GROUP BY cid),
    m AS (SELECT cid, max(id) AS marked FROM d GROUP BY cid)
    SELECT canonical_statement, category, user_id, c.id AS old_id, m.marked IS NOT NULL AND (grew IS NULL OR grew <= marked) AS contradicted, 0 AS made FROM v_cluster c LEFT JOIN m ON m.cid = c.id LEFT JOIN g ON g.cid = c.id
    UNION ALL SELECT any_value(statement), a.category, a.user_id, NULL, false, 1 FROM a JOIN f ON f.id = a.id WHERE a.cid IS NULL AND a.id = first GROUP BY a.id, a.category, a.user_id""")
def fact_cycle_state(spark, d):
    """Every cluster after the decisions of fact_cycle: who is contradicted, and the clusters made, one for each new claim."""
    f, c, decisions = _cycle(spark, d)
    out = consolidation.consolidated(c, f, decisions, now(), CONFIG).clusters
    made = F.col("written_at") == now().cast("timestamp")
    return out.select("canonical_statement", "category", "user_id", F.when(~made, F.col("id")).alias("old_id"), F.col("contradicted_at").isNotNull().alias("contradicted"), made.cast("int").alias("made"))


def _applied(spark, d):
    f = frame(spark, d, "v_fact").withColumn("embedding", F.lit(None).cast("array<float>"))
    c = frame(spark, d, "v_cluster")
    first = c.groupBy("user_id", "category").agg(F.min("id").alias("cid"))
    kind = F.when(F.col("cid").isNull() | (F.col("id") % 5 > 2), "create").when(F.col("id") % 5 == 0, "replace").otherwise("merge")
    todo = f.filter("extracted_flag = 0").join(first, ["user_id", "category"], "left").select(F.col("id").alias("fact_id"), kind.alias("action"), F.col("cid").alias("cluster_id"))
    return facts.applied(c, f, todo, now(), CONFIG, profiles=frame(spark, d, "v_profile"))


@query(f"""WITH {TODO}, nw AS (SELECT ok.cid, ok.evidence_key, min_by(points, ok.id) AS p FROM ok JOIN v_cluster c ON c.id = ok.cid WHERE action = 'merge' AND NOT list_contains(c.evidence_keys, ok.evidence_key) GROUP BY 1, 2),
    g AS (SELECT cid, sum(p) AS p, count(*) AS n FROM nw GROUP BY cid),
    m AS (SELECT c.*, CASE WHEN g.n > 0 THEN least(10.0, c.score + g.p) ELSE c.score END AS s2, c.evidence_count + coalesce(g.n, 0) AS n2, CASE WHEN g.n > 0 AND c.status IN ('pending_uncertain', 'dead') THEN 'active' ELSE c.status END AS st2 FROM v_cluster c LEFT JOIN g ON g.cid = c.id),
    n AS (SELECT ok.*, (SELECT max(id) FROM v_cluster) + row_number() OVER (ORDER BY ok.id) AS nid FROM ok WHERE action <> 'merge'),
    w AS (SELECT n.nid AS id, n.category, CASE WHEN n.action = 'replace' THEN least(10.0, greatest(n.points, m.s2)) ELSE n.points END AS score FROM n LEFT JOIN m ON m.id = n.cid)
    SELECT m.id, round(CASE WHEN n.nid IS NULL THEN s2 ELSE s2 * 0.5 END, 6) AS score, CASE WHEN n.nid IS NULL THEN st2 ELSE 'replaced' END AS status, CAST(n2 AS INT) AS evidence_count, n.nid AS replaced_by FROM m LEFT JOIN n ON n.cid = m.id AND n.action = 'replace'
    UNION ALL SELECT id, round(score, 6), CASE WHEN score >= {THRESHOLD} THEN 'profiled' ELSE 'active' END, 1, NULL FROM w""")
def fact_apply(spark, d):
    out = _applied(spark, d).clusters
    return out.select("id", F.round("score", 6).alias("score"), "status", F.col("evidence_count").cast("int").alias("evidence_count"), "replaced_by")


@query(f"WITH {TODO} SELECT t.id FROM t WHERE id NOT IN (SELECT id FROM ok)")
def fact_deferred(spark, d):
    return _applied(spark, d).deferred


@query("""WITH v AS (SELECT f.id AS fact_id, c.replaced_by FROM v_fact f JOIN (SELECT id, user_id, category, status, id + 1 AS replaced_by FROM v_cluster) c ON c.user_id = f.user_id AND c.category = f.category
    WHERE f.extracted_flag = 0 AND (f.id + c.id) % 2 = 0 AND c.status = 'replaced') SELECT DISTINCT replaced_by AS cluster_id FROM v""")
def fact_successors(spark, d):
    c = frame(spark, d, "v_cluster").withColumn("replaced_by", F.col("id") + 1)
    pair = frame(spark, d, "v_fact").filter("extracted_flag = 0").select(F.col("id").alias("fact_id"), "user_id", "category").join(c.select(F.col("id").alias("cluster_id"), "user_id", "category"), ["user_id", "category"])
    verdict = F.when((F.col("fact_id") + F.col("cluster_id")) % 2 == 0, "same").otherwise("drift")
    return facts.successors(c, pair.select("fact_id", "cluster_id", verdict.alias("verdict")))


@query("""WITH g AS (SELECT id, user_id, category, CASE id % 4 WHEN 0 THEN concat(id, '.0') WHEN 1 THEN concat(id, '.9') WHEN 2 THEN 'true' ELSE CAST(id AS VARCHAR) END AS given, CASE WHEN id % 5 = 0 THEN 'maybe' ELSE 'same' END AS verdict FROM v_cluster)
    SELECT id AS cluster_id FROM g WHERE id % 4 IN (0, 3) AND verdict = 'same'""")
def fact_verdict_ids(spark, d):
    c = frame(spark, d, "v_cluster")
    m, text = F.col("id") % 4, F.col("id").cast("string")
    given = F.when(m == 0, F.concat(text, F.lit(".0"))).when(m == 1, F.concat(text, F.lit(".9"))).when(m == 2, "true").otherwise(text)
    v = c.select(F.lit(1).alias("fact_id"), given.alias("cluster_id"), F.when(F.col("id") % 5 == 0, "maybe").otherwise("same").alias("verdict"))
    return facts.valid_verdicts(v, c.select(F.lit(1).alias("fact_id"), F.col("id").alias("cluster_id"))).select("cluster_id")


@query("""WITH f AS (SELECT c.id AS cid, f.id, f.related_user_ids AS r FROM v_cluster c JOIN v_fact f ON f.platform = c.platform AND f.user_id = c.user_id AND f.category = c.category AND f.event_type = c.canonical_statement WHERE len(f.related_user_ids) > 0),
    m AS (SELECT cid, arg_min(r, id) AS r FROM f GROUP BY cid) SELECT c.id, array_to_string(CASE WHEN len(c.related_user_ids) = 0 THEN coalesce(m.r, c.related_user_ids) ELSE c.related_user_ids END, ',') AS related FROM v_cluster c LEFT JOIN m ON m.cid = c.id""")
def fact_related(spark, d):
    f = frame(spark, d, "v_fact")
    own = f.groupBy("platform", "user_id", "category", F.col("event_type").alias("canonical_statement")).agg(F.array_sort(F.collect_list("id")).alias("source_fact_ids"))
    c = frame(spark, d, "v_cluster").join(own, ["platform", "user_id", "category", "canonical_statement"])
    return facts.with_related(c, f).select("id", F.array_join("related_user_ids", ",").alias("related"))


COS_C = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"


@query(f"""WITH {Q}, c AS (SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS v FROM v_cluster c JOIN embeddings e ON e.vec_id = c.id % 499)
    SELECT id, status, round({COS_C}, 6) AS relevance FROM c, qv WHERE status IN ('replaced', 'dead', 'pending_uncertain') AND platform = 'qq' ORDER BY {COS_C} DESC, id LIMIT 25""")
def fact_search(spark, d):
    e = frame(spark, d, "embeddings").select("vec_id", "embedding")
    c = frame(spark, d, "v_cluster").withColumn("vec_id", F.col("id") % 499).join(e, "vec_id")
    return facts.search(c, vector(spark, d), 25, "qq", inactive="only").select("id", "status", F.round("relevance", 6).alias("relevance"))


@query("SELECT platform, user_id, status FROM v_cluster WHERE id = (SELECT max(id) FROM v_cluster)")
def fact_owner(spark, d):
    c = frame(spark, d, "v_cluster")
    return facts.owner_of(c, c.agg(F.max("id")).first()[0])


@query("""SELECT id, CASE WHEN user_id = '7' AND status IN ('active', 'profiled', 'pending_uncertain') AND id = (SELECT min(id) FROM v_cluster WHERE user_id = '7') THEN 'dead' ELSE status END AS status FROM v_cluster""")
def fact_drop(spark, d):
    c = frame(spark, d, "v_cluster")
    return facts.change_status(c, c.filter("user_id = '7'").agg(F.min("id")).first()[0], "drop", now(), "qq", "7").select("id", "status")


@query("SELECT p.id, p.cluster_id, round(p.score, 6) AS score FROM v_profile p JOIN v_cluster c ON c.id = p.cluster_id UNION ALL SELECT (SELECT max(id) FROM v_profile) + row_number() OVER (ORDER BY c.id), c.id, round(c.score, 6) FROM v_cluster c WHERE c.status = 'active' AND c.score >= 6.0 AND c.category NOT IN ('recent', 'naming')")
def profile_sync(spark, d):
    c = frame(spark, d, "v_cluster")
    up = F.when((F.col("status") == "active") & (F.col("score") >= 6.0) & ~F.col("category").isin("recent", "naming"), "profiled").otherwise(F.col("status"))
    return facts.synced_profiles(frame(spark, d, "v_profile"), c.withColumn("status", up), now()).select("id", "cluster_id", F.round("score", 6).alias("score"))


# -- graph --------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'superseded') AS superseded, least(count(*), 500) AS shown FROM v_edge")
def graph_stats(spark, d):
    return graph.graph_stats(frame(spark, d, "v_edge"))


@query("SELECT count(*) AS n FROM v_cluster WHERE status IN ('active', 'profiled') AND trim(canonical_statement) <> '' AND id > 50 AND user_id <> '3'")
def graph_confirmed(spark, d):
    return graph.confirmed(frame(spark, d, "v_cluster"), 50, "3")


@query("SELECT id, concat(CASE WHEN subject_uid = '5' THEN 'Robin' ELSE subject_name END, '(', subject_uid, ')的', relation_label, '是', CASE WHEN object_uid = '5' THEN 'Robin' ELSE object_name END, '(', object_uid, ')（', strftime(last_seen, '%Y-%m-%d'), '）') AS line FROM v_edge")
def graph_lines(spark, d):
    return graph.statement_lines(frame(spark, d, "v_edge"), ["5"], "qq", "Robin", F.date_format("last_seen", "yyyy-MM-dd")).select("id", "line")


@query("""WITH t AS (SELECT * FROM v_edge WHERE status = 'active' ORDER BY evidence_count DESC, last_seen DESC, id LIMIT 30), a AS (SELECT *, row_number() OVER (ORDER BY evidence_count DESC, last_seen DESC, id) AS k FROM t),
    e AS (SELECT k, 0 AS side, subject_uid AS uid, subject_name AS n FROM a UNION ALL SELECT k, 1, object_uid, object_name FROM a), f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY k, side) AS r FROM e WHERE uid NOT IN ('5', '1', '2'))
    SELECT uid, trim(n) AS name FROM f WHERE r = 1 ORDER BY k, side LIMIT 12""")
def graph_neighbours(spark, d):
    order = [F.desc("evidence_count"), F.desc("last_seen"), F.col("id")]
    top = frame(spark, d, "v_edge").filter("status = 'active'").orderBy(*order).limit(30)
    return graph.neighbours(top, order, ["qq:1", "qq:2"], ["5"], "qq", 12).select("uid", "name")


@query("""WITH b AS (SELECT id FROM v_edge WHERE status = 'active' AND id > 10 ORDER BY id LIMIT 60) SELECT id, CASE WHEN id IN (SELECT id FROM b) AND id % 7 = 0 THEN 'superseded' ELSE status END AS status FROM v_edge""")
def graph_audit(spark, d):
    e = frame(spark, d, "v_edge")
    v = e.select(F.concat(F.col("id").cast("string"), F.lit(".0")).alias("id"), F.when(F.col("id") % 7 == 0, "bad").otherwise("ok").alias("verdict"), F.lit("x").alias("reason"))
    return graph.audit_pass(e, v, now(), 10)[0].select("id", "status")


@query("""WITH b AS (SELECT * FROM v_cluster WHERE status IN ('active', 'profiled') AND id > 100 ORDER BY id LIMIT 40), dir AS (SELECT DISTINCT user_id FROM v_alias),
    x AS (SELECT b.user_id AS s, CAST(CAST(b.user_id AS INT) % 140 + 3 AS VARCHAR) AS o, substring(b.canonical_statement, 1, 4) AS label, b.id FROM b),
    ok AS (SELECT * FROM x WHERE s <> o AND o IN (SELECT user_id FROM dir)), r AS (SELECT *, first_value(s) OVER (PARTITION BY least(s, o), greatest(s, o), label ORDER BY id) AS fs FROM ok)
    SELECT s AS subject_uid, o AS object_uid, label AS relation_label, CAST(1 AS INT) AS evidence_count FROM r WHERE fs = s GROUP BY 1, 2, 3""")
def graph_backfill(spark, d):
    c, e = frame(spark, d, "v_cluster"), frame(spark, d, "v_edge")
    other = ((F.col("user_id").cast("int") % 140) + 3).cast("string")
    found = c.select(
        F.col("id").alias("cluster_id"), F.col("user_id").alias("subject_user_id"), other.alias("object_user_id"), F.lit("S").alias("subject_display_name"), F.lit("O").alias("object_display_name"),
        F.substring("canonical_statement", 1, 4).alias("label"), F.lit("seen").alias("statement"), F.lit("high").alias("confidence"),
    )
    after, _ = graph.backfill_pass(c, e, found, frame(spark, d, "v_alias").select("platform", "user_id").distinct(), now(), 100)
    return after.join(e.select("id"), "id", "left_anti").select("subject_uid", "object_uid", "relation_label", "evidence_count")


@query(f"""WITH dir AS (SELECT name AS nm, min(user_id) AS uid FROM v_alias WHERE NOT {PH.format('name')} GROUP BY name HAVING count(DISTINCT user_id) = 1),
    al AS (SELECT user_id, min(name) AS nm FROM v_alias WHERE NOT {PH.format('name')} GROUP BY user_id),
    c AS (SELECT v.id, v.status, v.user_id AS s, CAST((CAST(v.user_id AS INT) + 1) % 150 AS VARCHAR) AS o, substring(v.canonical_statement, 1, 4) AS label, concat(v.canonical_statement, ' with ', coalesce(al.nm, 'nobody')) AS st
        FROM v_cluster v LEFT JOIN al ON al.user_id = CAST((CAST(v.user_id AS INT) + 1) % 150 AS VARCHAR)),
    src AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 40 AS b FROM c WHERE status IN ('active', 'profiled') AND id > 100),
    named AS (SELECT DISTINCT b, uid FROM src JOIN dir ON contains(st, nm)),
    stop AS (SELECT min(b) AS b FROM src WHERE id >= (SELECT max(id) * 3 // 4 FROM v_cluster) AND b IN (SELECT b FROM named)),
    good AS (SELECT * FROM src WHERE b < (SELECT coalesce(b, 1 << 40) FROM stop)),
    ok AS (SELECT good.*, row_number() OVER (PARTITION BY good.b, s, o, label ORDER BY id) AS rn FROM good JOIN named ON named.b = good.b AND named.uid = o WHERE s <> o)
    SELECT s AS subject_uid, o AS object_uid, label AS relation_label, (SELECT min(nm) FROM dir WHERE uid = o) AS object_name, CAST(1 AS INT) AS evidence_count, concat('backfill|', CAST(min(id) AS VARCHAR)) AS first_key,
        concat('seen ', CAST(max(id) AS VARCHAR)) AS statement, (SELECT max(id) FROM good) AS mark FROM ok WHERE rn = 1 GROUP BY s, o, label""")
def graph_backfill_run(spark, d):
    """A run over all sources, in passes, whose outer model fails at three quarters of the ids: what came before stays."""
    a, e = frame(spark, d, "v_alias"), frame(spark, d, "v_edge")
    other = ((F.col("user_id").cast("int") + 1) % 150).cast("string")
    called = a.filter(~X.is_placeholder(F.col("name"))).groupBy(F.col("user_id").alias("o")).agg(F.min("name").alias("nm"))
    c = frame(spark, d, "v_cluster").withColumn("o", other).join(called, "o", "left").withColumn("canonical_statement", F.concat("canonical_statement", F.lit(" with "), F.coalesce("nm", F.lit("nobody"))))
    c = saved(c, "clusters")
    end = c.agg(F.floor(F.max("id") * 3 / 4)).first()[0]

    def relation(x):
        return F.struct(
            x["id"].alias("cluster_id"), x["user_id"].alias("subject_user_id"), ((x["user_id"].cast("int") + 1) % 150).cast("string").alias("object_user_id"), F.lit("S").alias("subject_display_name"),
            F.lit("unknown").alias("object_display_name"), F.substring(x["statement"], 1, 4).alias("label"), F.concat(F.lit("seen "), x["id"].cast("string")).alias("statement"), F.lit("high").alias("confidence"),
        )

    def ask(asked):
        lost = F.exists("items", lambda x: x["id"] >= end)
        return asked.select("batch", F.when(lost, "sorry").otherwise(F.to_json(F.struct(F.transform("items", relation).alias("relations")))).alias("answer"))

    kept = []
    done = backfill.backfill_run(c, e, a, ask, now(), lambda one: kept.append(saved(one.edges, "kept")) or kept[-1], 100)
    made = kept[-1].join(e.select("id"), "id", "left_anti").withColumn("first_key", F.col("evidence_keys")[0]).withColumn("mark", F.lit(done[-1].watermark).cast("long"))
    return made.select("subject_uid", "object_uid", "relation_label", "object_name", "evidence_count", "first_key", "statement", "mark")


# -- ingest and memory ---------------------------------------------------------------------------------------------

PEOPLE = "array_to_string(list_sort(list_distinct(list_append(related_user_ids, user_id))), '-')"


@query(f"""SELECT concat({PEOPLE}, '@', session_id, '|', CAST(CAST(occurred_at AS DATE) AS VARCHAR), '-', substring(md5(statement), 1, 12)) AS document_id, array_to_string(list_filter(related_user_ids, lambda x: x <> '7'), ',') AS related
    FROM (SELECT * REPLACE (list_filter(related_user_ids, lambda x: x <> '7') AS related_user_ids) FROM v_fact) WHERE user_id <> '7'""")
def retain_facts(spark, d):
    f = frame(spark, d, "v_fact")
    item = F.struct("user_id", "related_user_ids", "display_name", "category", "statement", "confidence")
    b = f.select("session_id", "platform", F.lit("").alias("group_id"), F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.array(item).alias("facts"))
    return ingest.fact_rows(b, ["7"]).select("document_id", F.array_join("related_user_ids", ",").alias("related"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY session_id, platform ORDER BY occurred_at DESC, id DESC) AS r FROM v_summary WHERE kind = 'chat_summary' AND summarized AND embedding IS NOT NULL), h AS (SELECT session_id, platform, CAST(embedding AS DOUBLE[]) AS v FROM o WHERE r <= 8),
    n AS (SELECT s.id, s.session_id, s.platform, s.summarized, CAST(e.embedding AS DOUBLE[]) AS w FROM v_summary s LEFT JOIN embeddings e ON e.vec_id = s.id + 1)
    SELECT id FROM n WHERE NOT (summarized AND coalesce((SELECT max(list_dot_product(n.w, h.v) / (sqrt(list_dot_product(n.w, n.w)) * sqrt(list_dot_product(h.v, h.v)))) FROM h WHERE h.session_id = n.session_id AND h.platform = n.platform), 0.0) >= 0.25)""")
def write_novel(spark, d):
    s = frame(spark, d, "v_summary")
    e = frame(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("v"))
    new = s.join(e, "id", "left").withColumn("embedding", F.col("v")).select("id", "session_id", "platform", "summarized", "embedding")
    return ingest.novel(s, new, 8, 0.25).select("id")


@query("SELECT 'alias' AS name, CAST(0 AS BIGINT) AS before, count(*) AS after, count(*) AS added FROM v_alias UNION ALL SELECT 'fact', count(*) FILTER (extracted_flag = 1), count(*), count(*) FILTER (extracted_flag <> 1) FROM v_fact")
def import_deltas(spark, d):
    f, a = frame(spark, d, "v_fact"), frame(spark, d, "v_alias")
    return ingest.table_deltas({"fact": f.filter("extracted_flag = 1"), "alias": a.limit(0)}, {"fact": f, "alias": a})


@query("""SELECT conv_id, turn, concat('<msg ts="', strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn), '%Y-%m-%d %H:%M:%S'), '" ', CASE WHEN role = 'assistant' THEN 'name="＜Robin＞" self="true"' ELSE concat('uid="', uid, '" name="n', uid, '"', CASE WHEN turn % 4 = 0 THEN ' at_bot="true"' ELSE '' END) END, '>', text, '</msg>') AS line FROM v_line""")
def message_lines(spark, d):
    rows = frame(spark, d, "v_line")
    own = F.col("role") == "assistant"
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    line = X.message_line(F.when(own, "<Robin>").otherwise(F.concat(F.lit("n"), "uid")), F.col("text"), ts, F.col("uid"), own, F.col("turn") % 4 == 0, F.lit(""))
    return rows.select("conv_id", "turn", line.alias("line"))


@query("SELECT id, CAST(regexp_matches(lower(canonical_statement), 'c.i[ck]|^view') AS INT) AS hit, 0 AS none FROM v_cluster")
def regexp_hits(spark, d):
    c = frame(spark, d, "v_cluster")
    return c.select("id", X.matches("C.i[ck]|^VIEW", F.col("canonical_statement")).alias("hit"), X.matches("(", F.col("canonical_statement")).alias("none"))


@query("""SELECT concat('qq:', CASE WHEN conv_id % 2 = 0 THEN 'gm' ELSE 'dm' END, ':', conv_id) AS session_key, concat(conv_id, '-', turn) AS msg_key, role = 'assistant' AS is_bot, length(text) AS n FROM v_line WHERE trim(text) <> ''""")
def hook_messages(spark, d):
    rows = frame(spark, d, "v_line")
    kind = F.when(F.col("conv_id") % 2 == 0, "gm").otherwise("dm")
    hook = F.when(F.col("role") == "assistant", "message_sent").otherwise("im_message")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    said = rows.select(hook.alias("hook"), F.lit("qq").alias("platform"), kind.alias("kind"), F.col("conv_id").cast("string").alias("peer"), key.alias("message_id"), F.col("uid").alias("user_id"), "text", F.lit(None).cast("timestamp").alias("ts"))
    asked = said.withColumn("hook", F.lit("llm_request"))
    out = retain.from_hooks(said.unionByName(asked))
    body = F.regexp_replace(F.regexp_replace("line", "^<msg [^>]*>", ""), "</msg>$", "")
    return out.select("session_key", "msg_key", "is_bot", F.length(body).cast("long").alias("n"))


@query("SELECT vec_id, replace(concat(vec_id, chr(0), label), chr(0), chr(65533)) AS text FROM embeddings")
def nul_text(spark, d):
    e = frame(spark, d, "embeddings")
    return e.select("vec_id", X.without_nul(F.concat(F.col("vec_id").cast("string"), F.lit("\0"), F.col("label").cast("string"))).alias("text"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY conv_id DESC, turn DESC) AS r FROM v_line), c AS (SELECT * FROM k WHERE r <= 30),
    q AS (SELECT m.conv_id, m.turn, c.turn AS t, substring(trim(c.text), 1, 200) AS l FROM v_line m JOIN c ON c.session_key = m.session_key AND c.conv_id = m.conv_id AND c.turn IN (m.turn - 1, m.turn - 2, m.turn - 3) WHERE trim(c.text) <> ''),
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY t) AS n FROM q), g AS (SELECT conv_id, turn, string_agg(l, ' ' ORDER BY n) AS l FROM b WHERE n <= 2 GROUP BY 1, 2)
    SELECT concat(m.conv_id, '-', m.turn) AS turn_id, substring(trim(CASE WHEN l IS NULL THEN trim(m.text) ELSE concat(trim(m.text), ' ', l) END), 1, 200) AS query FROM v_line m LEFT JOIN g ON g.conv_id = m.conv_id AND g.turn = m.turn""")
def quoted_query(spark, d):
    rows = frame(spark, d, "v_line")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    at = (F.col("conv_id") * 100_000 + F.col("turn")).alias("ts")
    cache = retain.latest_lines(rows.select("session_key", key.alias("msg_key"), F.col("text").alias("line"), "uid", F.lit(False).alias("is_bot"), at))
    quotes = F.array(*[F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - i).cast("string")) for i in (1, 2, 3)])
    return retain.quote_text(rows.select(key.alias("turn_id"), "session_key", "text", quotes.alias("quotes")), cache)


@query("SELECT session_key, max_by(text, conv_id * 100000 + turn) AS payload, max(conv_id * 100000 + turn) AS updated_at FROM v_line GROUP BY session_key HAVING max(conv_id * 100000 + turn) > 1000000")
def pending_rows(spark, d):
    rows = frame(spark, d, "v_line").select("session_key", F.col("text").alias("payload"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("updated_at"))
    kept = retain.stored(rows.limit(0), rows)
    return retain.cleared(kept, kept.select("session_key", F.lit(1_000_000).cast("long").alias("cutoff")))


@query("SELECT session_key, conv_id FROM (SELECT session_key, conv_id, row_number() OVER (PARTITION BY session_key ORDER BY min(turn) + conv_id * 1000 DESC, conv_id DESC) AS r FROM v_line WHERE role = 'assistant' GROUP BY session_key, conv_id) WHERE r <= 5")
def bot_messages(spark, d):
    sent = frame(spark, d, "v_line").filter("role = 'assistant'").select("session_key", F.col("conv_id").alias("message_id"), (F.col("turn") + F.col("conv_id") * 1000).alias("ts"))
    return retain.bot_messages(sent, 5).select("session_key", F.col("message_id").alias("conv_id"))


@query(f"""WITH l AS (SELECT id FROM v_summary WHERE session_id = '{SESSION}' ORDER BY occurred_at DESC, id DESC LIMIT 25) SELECT id, CASE WHEN id IN (SELECT id FROM l) AND NOT archived THEN {{now}} ELSE last_recall_at END AS last_recall_at, CAST(id IN (SELECT id FROM l) AND NOT archived AS INT) AS recall_count FROM v_summary""")
def lifecycle_reinforce(spark, d):
    s = frame(spark, d, "v_summary").withColumn("recall_count", F.lit(0))
    latest = s.filter(F.col("session_id") == SESSION).orderBy(F.desc("occurred_at"), F.desc("id")).limit(25)
    return lifecycle.reinforce(s, latest, now()).select("id", "last_recall_at", "recall_count")


@query("SELECT key, document_id FROM (SELECT session_id AS key, document_id, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, document_id) AS r FROM v_summary WHERE occurred_at >= {now} - INTERVAL 29 DAYS) WHERE r <= 6")
def memo_fresh(spark, d):
    m = frame(spark, d, "v_summary").select(F.col("session_id").alias("key"), "document_id", F.col("occurred_at").alias("at"))
    return lifecycle.fresh_memos(m, now(), 29 * 86400, 6).select("key", "document_id")


@query(f"WITH {Q}, {LATE}, {BM25} SELECT id, round(bm25, 6) AS bm25 FROM v_summary JOIN b USING (id), qv WHERE embedding IS NOT NULL AND {SCOPE} ORDER BY round(b.bm25, 9) DESC, id LIMIT 10")
def recall_unindexed(spark, d):
    """The lexical leg over rows that have no stored postings: their tokens are counted in the scan."""
    return recall.lexical_leg(frame(spark, d, "v_summary"), TEXT, vector(spark, d), scope(), 10).select("id", F.round("bm25", 6).alias("bm25"))


# -- admin and tools -----------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT min(id) AS id FROM v_cluster WHERE status = 'profiled') SELECT c.id, CASE WHEN c.id = k.id THEN 'dead' ELSE c.status END AS status, round(CASE WHEN c.id = k.id THEN 10.0 ELSE c.score END, 6) AS score, p.id IS NOT NULL AND c.id <> k.id AS shown FROM v_cluster c LEFT JOIN v_profile p ON p.cluster_id = c.id, k""")
def admin_edit(spark, d):
    c = frame(spark, d, "v_cluster")
    first = c.filter("status = 'profiled'").agg(F.min("id")).first()[0]
    out = admin.edit_cluster(c, first, now(), frame(spark, d, "v_profile"), frame(spark, d, "v_edge"), status="dead", score=42.0)
    shown = out.profiles.select(F.col("cluster_id").alias("id"), F.lit(True).alias("shown"))
    return out.clusters.join(shown, "id", "left").select("id", "status", F.round("score", 6).alias("score"), F.coalesce("shown", F.lit(False)).alias("shown"))


@query("""SELECT category, rn, cluster_id FROM (SELECT p.category, p.cluster_id, row_number() OVER (PARTITION BY p.category ORDER BY CASE WHEN p.category = 'recent' THEN c.occurred_at END DESC NULLS LAST, p.score DESC, p.updated_at DESC, p.id) AS rn
    FROM v_profile p LEFT JOIN v_cluster c ON c.id = p.cluster_id WHERE p.user_id = '7') WHERE rn <= 5""")
def profile_preview(spark, d):
    return admin.profile_preview(frame(spark, d, "v_profile"), frame(spark, d, "v_cluster"), "qq", "7").select("category", "rn", "cluster_id")


@query(f"""WITH {Q}, c AS (SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS v FROM v_cluster c JOIN embeddings e ON e.vec_id = c.id % 499 WHERE status IN ('active', 'profiled')), f AS (SELECT id, user_id FROM c, qv ORDER BY {COS_C} DESC, c.id LIMIT 10),
    r AS (SELECT DISTINCT e.id, u.user_id FROM (SELECT id, unnest([subject_uid, object_uid]) AS uid FROM v_edge WHERE status = 'active') e JOIN (SELECT DISTINCT user_id FROM f) u ON u.user_id = e.uid)
    SELECT 'fact' AS kind, id, user_id FROM f UNION ALL SELECT 'relation', id, user_id FROM r""")
def tool_lookup(spark, d):
    e = frame(spark, d, "embeddings").select("vec_id", "embedding")
    c = frame(spark, d, "v_cluster").withColumn("vec_id", F.col("id") % 499).join(e, "vec_id")
    return tools.lookup(c, frame(spark, d, "v_edge"), frame(spark, d, "v_alias"), vector(spark, d), 10).select("kind", "id", "user_id")


@query("""WITH u AS (SELECT name, min(user_id) AS user_id FROM v_alias WHERE NOT regexp_matches(lower(name), '^(unknown|undefined|[0-9]+)$') GROUP BY name HAVING count(DISTINCT user_id) = 1)
    SELECT user_id FROM u WHERE name = (SELECT min(name) FROM u)""")
def tool_resolve(spark, d):
    a = frame(spark, d, "v_alias")
    name = graph.directory(a).agg(F.min("name")).first()[0]  # one name
    return people.resolved(a, F.lower(F.lit(name))).select("user_id")


# -- the store's scans and writes, and smaller reads ----------------------------------------------------------------


@query("SELECT id FROM v_fact WHERE extracted_flag = 0 ORDER BY id LIMIT 50")
def store_pending(spark, d):
    return store.pending_facts(frame(spark, d, "v_fact"), 50).select("id")


def _lengths():
    """A client whose vectors are (length, length % 7); of texts whose length 5 divides they are too short."""
    return lambda texts: [[float(len(t)), float(len(t) % 7)][: 1 if len(t) % 5 == 0 else 2] for t in texts]


@query("""WITH x AS (SELECT 'summary' AS name, id, content AS t FROM v_summary UNION ALL SELECT 'fact', id, statement FROM v_fact UNION ALL SELECT 'cluster', id, canonical_statement FROM v_cluster)
    SELECT name, id, CASE WHEN length(t) % 5 > 0 THEN CAST(length(t) AS DOUBLE) END AS first, CASE WHEN length(t) % 5 > 0 THEN CAST(length(t) % 7 AS DOUBLE) END AS second FROM x WHERE trim(t) <> ''""")
def store_filled(spark, d):
    """Vectors of an outer model for all summaries, facts and clusters, none of which has one."""
    none = F.lit(None).cast("array<float>")
    tables = {"summary": frame(spark, d, "v_summary").withColumns({"embedding": none, "search_text": F.lit("")}), "fact": frame(spark, d, "v_fact").withColumn("embedding", none), "cluster": frame(spark, d, "v_cluster").withColumn("embedding", none)}
    after, _ = encoders.filled(tables, _lengths, 2, None)
    rows = [after[n].select(F.lit(n).alias("name"), "id", F.get("embedding", 0).cast("double").alias("first"), F.get("embedding", 1).cast("double").alias("second")) for n in tables]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT id FROM v_summary WHERE NOT summarized AND kind <> 'bot_self' ORDER BY id LIMIT 30")
def store_unsummarized(spark, d):
    return store.unsummarized(frame(spark, d, "v_summary"), 30).select("id")


@query("SELECT s.id, s.embedding IS NULL AND e.vec_id IS NOT NULL AND e.label < 5 AS filled, s.embedding IS NOT NULL OR (e.vec_id IS NOT NULL AND e.label < 5) AS known FROM v_summary s LEFT JOIN embeddings e ON e.vec_id = s.id - 300")
def store_embeddings(spark, d):
    s = frame(spark, d, "v_summary")
    e = frame(spark, d, "embeddings")
    short = F.slice("embedding", 1, F.when(F.col("label") < 5, 64).otherwise(10))  # others have a wrong length
    out = store.with_embeddings(s, e.select((F.col("vec_id") + 300).alias("id"), short.alias("vector")), 64)
    was = s.select("id", F.col("embedding").isNull().alias("lacked"))
    return out.join(was, "id").select("id", (F.col("lacked") & F.col("embedding").isNotNull()).alias("filled"), F.col("embedding").isNotNull().alias("known"))


@query("SELECT id, CASE WHEN NOT summarized AND kind <> 'bot_self' THEN concat('short ', id) ELSE content END AS content, summarized OR kind <> 'bot_self' AS summarized FROM v_summary")
def store_encoded(spark, d):
    s = frame(spark, d, "v_summary").withColumn("search_text", F.lit(None).cast("string"))
    done = s.filter("NOT summarized AND kind <> 'bot_self'").select("id", F.concat(F.lit("short "), F.col("id").cast("string")).alias("content"), "embedding")
    return store.encoded_back(s, done).select("id", "content", "summarized")


@query("""SELECT document_id, CASE WHEN extracted_flag = 1 AND value_name <> '' THEN value_name ELSE display_name END AS display_name, extracted_flag FROM (SELECT *, CASE WHEN id % 3 = 0 THEN '' ELSE concat('new', id) END AS value_name FROM v_fact) WHERE extracted_flag = 1
    UNION ALL SELECT document_id, CASE WHEN id % 3 = 0 THEN '' ELSE concat('new', id) END, 0 FROM v_fact WHERE extracted_flag = 0""")
def store_upsert_facts(spark, d):
    f = frame(spark, d, "v_fact")
    new = f.withColumn("display_name", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("new"), F.col("id").cast("string")))).drop("id")
    return store.upsert_facts(f.filter("extracted_flag = 1"), new).select("document_id", "display_name", "extracted_flag")


@query("SELECT row_number() OVER (ORDER BY occurred_at, document_id) + (SELECT max(id) FROM v_fact WHERE extracted_flag = 1) AS id, document_id, 0 AS extracted_flag FROM v_fact WHERE extracted_flag = 0")
def store_insert_facts(spark, d):
    f = frame(spark, d, "v_fact")
    old = f.filter("extracted_flag = 1")
    out = store.insert_facts(old, f.drop("id", "extracted_flag"), now())
    return out.join(old.select("id"), "id", "left_anti").select("id", "document_id", "extracted_flag")


@query("""WITH t AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'nonsense' ELSE category END AS c2, CASE WHEN id % 7 = 0 THEN '  ' ELSE concat(' ', statement, ' ') END AS s2, CASE WHEN id % 11 = 0 THEN 'low' ELSE confidence END AS k2 FROM v_fact)
    SELECT id, substring(trim(s2), 1, 20) AS statement FROM t WHERE c2 <> 'nonsense' AND trim(s2) <> '' AND k2 <> 'low'""")
def encoder_facts(spark, d):
    f = frame(spark, d, "v_fact")
    items = f.withColumns({
        "category": F.when(F.col("id") % 3 == 0, "nonsense").otherwise(F.col("category")), "statement": F.when(F.col("id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "statement", F.lit(" "))),
        "confidence": F.when(F.col("id") % 11 == 0, "low").otherwise(F.col("confidence")),
    })
    return facts.valid_facts(items, 20).select("id", "statement")


@query("""SELECT id FROM (SELECT *, CASE WHEN id % 5 = 0 THEN subject_uid ELSE object_uid END AS o2, CASE WHEN id % 3 = 0 THEN 'high' ELSE subject_name END AS n2 FROM v_edge)
    WHERE subject_uid <> o2 AND length(relation_label) BETWEEN 2 AND 8 AND NOT (length(n2) >= 2 AND contains(relation_label, n2))""")
def encoder_relations(spark, d):
    e = frame(spark, d, "v_edge")
    items = e.select(
        "id", F.col("subject_uid").alias("subject_user_id"), F.when(F.col("id") % 5 == 0, F.col("subject_uid")).otherwise(F.col("object_uid")).alias("object_user_id"),
        F.when(F.col("id") % 3 == 0, "high").otherwise(F.col("subject_name")).alias("subject_display_name"), F.lit("").alias("object_display_name"), F.col("relation_label").alias("label"), "statement", "confidence",
    )
    return graph.valid_relations(items).select("id")


@query("SELECT id FROM v_edge WHERE relation_label NOT IN ('5-low', '2-high')")
def graph_stopwords(spark, d):
    return graph.without_stopwords(frame(spark, d, "v_edge"), ["5-low", "2-high"]).select("id")


@query("""WITH o AS (SELECT canonical_statement FROM v_cluster WHERE status IN ('pending_uncertain', 'replaced') AND user_id IN ('7', '8', '9', '10', '11') ORDER BY occurred_at DESC, score DESC, updated_at DESC, id LIMIT 20) SELECT DISTINCT canonical_statement FROM o""")
def profile_uncertain_multi(spark, d):
    owners = spark.createDataFrame([("qq", str(i)) for i in range(7, 12)], "platform string, user_id string")
    return people.uncertain(frame(spark, d, "v_cluster"), owners, 20).select("canonical_statement")


@query("SELECT user_id, arg_max(display_name, occurred_at) AS display_name FROM v_fact WHERE display_name <> '' AND user_id IN ('7', '8', '9') GROUP BY user_id")
def display_names_multi(spark, d):
    owners = spark.createDataFrame([("qq", str(i)) for i in (7, 8, 9, 9)], "platform string, user_id string")
    return people.latest_names(frame(spark, d, "v_fact"), owners).select("user_id", "display_name")


@query("SELECT user_id, string_agg(name, '|' ORDER BY last_seen DESC, name) AS names FROM v_alias WHERE user_id IN ('3', '4', '5') GROUP BY user_id")
def alias_variants(spark, d):
    return people.variants_of(frame(spark, d, "v_alias"), ["qq", "wx"], ["3", "4", "5"]).select("user_id", F.array_join("names", "|").alias("names"))


@query("SELECT platform FROM v_summary GROUP BY platform ORDER BY count(*) DESC, min(id) LIMIT 1")
def import_platform(spark, d):
    return admin.top_platform(frame(spark, d, "v_summary").select("platform", F.col("id").alias("pos")))


@query("SELECT conv_id, turn FROM v_line WHERE (uid IN ('3', '5') OR concat('qq:', uid) IN ('3', '5')) AND (session_key LIKE 'qq:gm:%' AND CAST(conv_id % 20 AS VARCHAR) IN ('2', '4'))")
def event_whitelist(spark, d):
    e = frame(spark, d, "v_line").select("conv_id", "turn", F.lit("qq").alias("platform"), F.col("uid").alias("user_id"), F.concat(F.lit("gm:"), (F.col("conv_id") % 20).cast("string")).alias("raw_session"), F.col("session_key").alias("session_id"))
    group = e.filter(F.startswith("session_id", F.lit("qq:gm:")))
    return admin.allowed(group, ["3", "5"], ["gm:2", "qq:gm:4"]).select("conv_id", "turn")


@query("SELECT 'cluster' AS name, count(*) AS n FROM v_cluster WHERE user_id <> '7' UNION ALL SELECT 'edge', count(*) FROM v_edge WHERE subject_uid <> '7' AND object_uid <> '7' UNION ALL SELECT 'fact', count(*) FROM v_fact WHERE user_id <> '7' UNION ALL SELECT 'summary', count(*) FROM v_summary")
def admin_erase(spark, d):
    left = admin.erase_user({n: frame(spark, d, f"v_{n}") for n in ("cluster", "edge", "fact", "summary")}, "qq", "7")
    rows = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in sorted(left)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT count(*) FILTER (category = 'recent' AND e) AS expired_recent, count(*) FILTER (category = 'commitment' AND e) AS expired_commitment FROM (SELECT *, status IN ('active', 'profiled') AND ((category = 'recent' AND occurred_at < {now} - INTERVAL 10 DAYS) OR (category = 'commitment' AND last_evidence_at < {now} - INTERVAL 15 DAYS)) AS e FROM v_cluster)")
def fact_decay_stats(spark, d):
    after = facts.decay(frame(spark, d, "v_cluster"), frame(spark, d, "v_profile"), None, now(), CONFIG)
    return facts.decay_stats(after).select("expired_recent", "expired_commitment")


@query(f"SELECT id, archived AND id <> coalesce((SELECT min(id) FROM v_summary WHERE archived AND session_id = '{SESSION}'), -1) AS archived FROM v_summary")
def lifecycle_restore(spark, d):
    """The session's first archived summary comes back; every other row stays as it is."""
    s = frame(spark, d, "v_summary").withColumn("archived_at", F.lit(None).cast("timestamp"))
    first = s.filter(F.col("archived") & (F.col("session_id") == SESSION)).agg(F.min("id")).first()[0]
    return lifecycle.restore(s, -1 if first is None else first, SESSION).select("id", "archived")
