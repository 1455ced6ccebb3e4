"""The relation graph: batch merge of edges, tombstones, integrity, audit, backfill sources and injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_placeholder
from ..functions.numbering import hash_order, numbered
from ..sources.scratch import saved

KEY = ["platform", "subject_uid", "object_uid", "relation_label"]
#: The columns of edges after a merge.
UPSERTED = ["id", *KEY, "subject_name", "object_name", "statement", "status", "confidence", "evidence_count", "evidence_keys", "first_seen", "last_seen", "occurred_at", "updated_at"]


def valid_relations(items: DataFrame, max_chars: int = 200) -> DataFrame:
    """Encoder output that is a relation: two people, a label of 2 to 8 characters without either's name, a statement."""
    names = ("subject_user_id", "object_user_id", "subject_display_name", "object_display_name", "label", "statement", "confidence")
    out = items.withColumns({n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names}).withColumn("confidence", F.when(F.col("confidence") == "", "medium").otherwise(F.col("confidence")))

    def named(n: str) -> Column:
        return (F.length(n) >= 2) & F.contains(F.col("label"), F.col(n))

    return out.filter(
        (F.col("subject_user_id") != "") & (F.col("object_user_id") != "") & (F.col("subject_user_id") != F.col("object_user_id")) & F.length("label").between(2, 8)
        & ~named("subject_display_name") & ~named("object_display_name") & F.length("statement").between(1, max_chars) & F.col("confidence").isin("high", "medium")
    )


def without_stopwords(rows: DataFrame, stopwords: list[str]) -> DataFrame:
    return rows.filter(~F.col("relation_label").isin(*stopwords)) if stopwords else rows


def without_echoes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (with a position pos) but for those whose mirror exists, or came first in the batch, while they do not exist."""
    live = edges.filter("status <> 'superseded'").select(*KEY)
    own = live.withColumn("_own", F.lit(True))
    mirror = live.select("platform", F.col("object_uid").alias("subject_uid"), F.col("subject_uid").alias("object_uid"), "relation_label").withColumn("_mirror", F.lit(True))
    lo, hi = F.least("subject_uid", "object_uid"), F.greatest("subject_uid", "object_uid")
    j = rows.join(own, KEY, "left").join(mirror, KEY, "left")
    # of a pair that exists neither way, the direction that comes first in the batch holds
    pair = Window.partitionBy("platform", lo, hi, "relation_label").orderBy("pos")
    j = j.withColumn("_first", F.first("subject_uid").over(pair))
    known = F.coalesce("_own", F.lit(False))
    echo = ~known & (F.coalesce("_mirror", F.lit(False)) | (F.col("_first") != F.col("subject_uid")))
    return j.filter(~echo).select(*rows.columns)


def upserted(edges: DataFrame, rows: DataFrame, now: Column, stopwords: list[str] | None = None) -> DataFrame:
    """edges after a batch of rows in the order of pos, merged by their structural key.

    Within a key: names take the last real one, the statement the last one; times the latest; confidence only rises;
    a new evidence key counts once, unless count_on_conflict is false and the edge exists by then; a bot edge
    starts pending below min_evidence and turns active at it; a superseded edge stays so.
    """
    rows = without_echoes(without_stopwords(rows, stopwords or []), edges)
    at = F.col("pos")
    real = lambda n: F.max(F.when(~is_placeholder(F.col(n)), F.struct(at, F.col(n).alias("v"))))
    first = lambda n: F.min(F.struct(at, F.col(n).alias("v")))["v"]
    w = Window.partitionBy(*KEY).orderBy("pos")
    rows = rows.withColumn("_i", F.row_number().over(w))
    batch = rows.groupBy(*KEY).agg(
        real("subject_name").alias("_sn"), real("object_name").alias("_on"), first("subject_name").alias("_sn1"), first("object_name").alias("_on1"),
        F.max(F.struct(at, F.col("statement").alias("v")))["v"].alias("_st"), F.max("occurred_at").alias("_at"), F.min(F.struct(at, "occurred_at"))["occurred_at"].alias("_at1"),
        first("confidence").alias("_c1"), F.max(F.when(F.col("confidence") == "high", 1).otherwise(0)).alias("_high"), first("evidence_key").alias("_k1"),
        F.array_sort(F.collect_list(F.struct(at, F.col("evidence_key").alias("k"), "count_on_conflict", "is_bot_edge", "min_evidence"))).alias("_rows"),
    )
    j = edges.join(batch, KEY, "full_outer")
    old, new = F.col("evidence_count").isNotNull(), F.col("_rows").isNotNull()
    start = F.struct(
        F.when(old, F.col("evidence_keys")).otherwise(F.array("_k1")).alias("keys"), F.when(old, F.col("evidence_count")).otherwise(F.lit(1)).alias("n"),
        F.when(old, F.col("status")).when(F.col("_rows")[0]["is_bot_edge"] & (F.col("_rows")[0]["min_evidence"] > 1), "pending").otherwise("active").alias("status"),
    )
    # the first row of a new edge is its insert
    steps = F.when(old, F.col("_rows")).otherwise(F.slice("_rows", 2, F.greatest(F.lit(1), F.size("_rows"))))

    def step(s: Column, x: Column) -> Column:
        adds = x["count_on_conflict"] & ~F.array_contains(s["keys"], x["k"])
        n = s["n"] + F.when(adds, 1).otherwise(0)
        return F.struct(
            F.when(adds, F.array_append(s["keys"], x["k"])).otherwise(s["keys"]).alias("keys"), n.alias("n"),
            F.when(x["is_bot_edge"] & (s["status"] != "superseded") & (n >= x["min_evidence"]), "active").otherwise(s["status"]).alias("status"),
        )

    j = j.withColumn("_end", F.when(new, F.aggregate(steps, start, step)))
    out = j.select(
        "id", *KEY,
        F.coalesce("_sn.v", "subject_name", "_sn1").alias("subject_name"), F.coalesce("_on.v", "object_name", "_on1").alias("object_name"),
        F.coalesce("_st", "statement").alias("statement"), F.coalesce("_end.status", "status").alias("status"),
        F.when(F.col("_high") == 1, "high").otherwise(F.coalesce("confidence", "_c1")).alias("confidence"),
        F.coalesce("_end.n", "evidence_count").cast("int").alias("evidence_count"), F.coalesce("_end.keys", "evidence_keys").alias("evidence_keys"),
        F.coalesce("first_seen", "_at1").alias("first_seen"), F.greatest("last_seen", "_at").alias("last_seen"), F.greatest("occurred_at", "_at").alias("occurred_at"),
        F.when(new, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    # only new edges are numbered, in the order of a hash of their key; the merge is written once, as it is read twice
    out = saved(out, "edges")
    top = edges.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    fresh = out.filter(F.col("id").isNull()).drop("id").crossJoin(F.broadcast(top))
    fresh = numbered(fresh, hash_order(*KEY), KEY, "id", F.col("_top")).drop("_top")
    return out.filter(F.col("id").isNotNull()).unionByName(fresh)


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def superseded(edges: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """edges after (id, reason[, expected_updated_at]) are put down; a changed or superseded edge is left alone, an empty reason keeps the old."""
    if "expected_updated_at" not in ids.columns:
        ids = ids.withColumn("expected_updated_at", F.lit(None).cast("timestamp"))
    j = edges.join(ids.select("id", F.substring("reason", 1, 200).alias("_r"), "expected_updated_at", F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") != "superseded") & (F.col("expected_updated_at").isNull() | F.col("expected_updated_at").eqNullSafe(F.col("updated_at")))
    return j.withColumns({
        "status": F.when(hit, "superseded").otherwise(F.col("status")),
        "supersede_reason": F.when(hit & (F.coalesce("_r", F.lit("")) != ""), F.col("_r")).otherwise(_or_null(edges, "supersede_reason", "string")),
        "superseded_at": F.when(hit, now).otherwise(_or_null(edges, "superseded_at", "timestamp")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(*edges.columns)


def _sources(key: Column) -> Column:
    return F.when(key.rlike(r"^backfill\|[0-9]+$"), F.substring(key, 10, 20).cast("long"))


def only_dead_sources(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """Active edges all of whose evidence is a backfill of clusters in dead: (cluster_id).

    Any other evidence protects an edge; a backfill key without a number says nothing. Keys are exploded and joined.
    """
    backfill = F.startswith(F.col("k"), F.lit("backfill|"))
    keys = edges.filter("status = 'active'").select("id", F.explode("evidence_keys").alias("k")).withColumn("cluster_id", _sources(F.col("k")))
    keys = keys.filter(~backfill | F.col("cluster_id").isNotNull())
    known = keys.join(dead.select("cluster_id").distinct().withColumn("_dead", F.lit(True)), "cluster_id", "left")
    doomed = known.groupBy("id").agg(F.every(F.coalesce("_dead", F.lit(False))).alias("_all")).filter("_all").select("id")
    return edges.join(doomed, "id", "left_semi")


def retired(edges: DataFrame, dead: DataFrame, now: Column, reason: str = "source cluster removed") -> DataFrame:
    """edges after the clusters (cluster_id) were replaced, killed or deleted: those that rest on them alone are put down."""
    doomed = only_dead_sources(edges, dead).select("id").withColumn("reason", F.lit(reason))
    return superseded(edges, doomed, now)


def canonical_names(aliases: DataFrame) -> DataFrame:
    """(platform, user_id, canon): the latest real name of each owner."""
    w = Window.partitionBy("platform", "user_id").orderBy(F.desc("last_seen"), "name")
    return aliases.filter(~is_placeholder(F.col("name"))).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("platform", "user_id", F.col("name").alias("canon"))


def integrity(edges: DataFrame, aliases: DataFrame, clusters: DataFrame, now: Column, stale_days: int = 14) -> DataFrame:
    """One row of seven counters."""
    act = edges.filter("status = 'active'")
    e = edges.agg(
        F.count_if(F.col("evidence_count") != F.size("evidence_keys")).alias("evidence_mismatch"),
        F.count_if((F.col("status") == "active") & (is_placeholder(F.col("subject_name")) | is_placeholder(F.col("object_name")))).alias("placeholder_names"),
        F.count_if((F.col("status") == "active") & (~F.length("relation_label").between(2, 8) | ((F.length("subject_name") >= 2) & F.contains("relation_label", "subject_name")) | ((F.length("object_name") >= 2) & F.contains("relation_label", "object_name")))).alias("bad_labels"),
        F.count_if((F.col("status") == "pending") & (F.col("last_seen") < now - F.expr(f"INTERVAL {stale_days} DAYS"))).alias("pending_stale"),
    )
    m = act.select("platform", F.col("subject_uid").alias("object_uid"), F.col("object_uid").alias("subject_uid"), F.col("id").alias("other"))
    mirror = act.join(m, ["platform", "subject_uid", "object_uid"]).filter("other > id").agg(F.count("*").alias("mirror_active_pairs"))
    canon = canonical_names(aliases)
    s = canon.select("platform", F.col("user_id").alias("subject_uid"), F.col("canon").alias("s_canon"))
    o = canon.select("platform", F.col("user_id").alias("object_uid"), F.col("canon").alias("o_canon"))
    named = act.join(s, ["platform", "subject_uid"], "left").join(o, ["platform", "object_uid"], "left")
    stale = named.agg(F.count_if(F.coalesce(F.col("s_canon") != F.col("subject_name"), F.lit(False)) | F.coalesce(F.col("o_canon") != F.col("object_name"), F.lit(False))).alias("stale_names"))
    dead = clusters.filter("status IN ('dead', 'replaced')").select(F.col("id").alias("cluster_id"))
    keys = act.select("id", F.explode("evidence_keys").alias("k")).withColumn("cluster_id", _sources(F.col("k")))
    gone = keys.join(dead, "cluster_id", "left_semi").select("id").distinct().agg(F.count("*").alias("edges_dead_source"))
    out = e.crossJoin(mirror).crossJoin(stale).crossJoin(gone)  # one row each
    return out.select("evidence_mismatch", "mirror_active_pairs", "placeholder_names", "bad_labels", "pending_stale", "stale_names", "edges_dead_source")


def active_edges(edges: DataFrame, nodes: list[str], limit: int = 64) -> DataFrame:
    """Active edges that touch a node (platform:uid), best evidenced first."""
    own = F.concat("platform", F.lit(":"), "subject_uid").isin(*nodes) | F.concat("platform", F.lit(":"), "object_uid").isin(*nodes)
    return edges.filter((F.col("status") == "active") & (own if nodes else F.lit(False))).orderBy(F.desc("evidence_count"), F.desc("last_seen"), "id").limit(limit)


def for_audit(edges: DataFrame, after_id: int, limit: int) -> DataFrame:
    return edges.filter((F.col("status") == "active") & (F.col("id") > after_id)).orderBy("id").limit(limit)


def verdict_ids(verdicts: DataFrame) -> DataFrame:
    """verdicts (id as given, verdict, ...) with whole-number ids and known verdicts: 1.0 counts as 1, 1.9 and true do not."""
    text = F.trim(F.col("id").cast("string"))
    ok = text.rlike(r"^[0-9]+([.]0+)?$") & F.lower("verdict").isin("ok", "bad")
    return verdicts.filter(F.coalesce(ok, F.lit(False))).withColumn("id", F.regexp_replace(text, "[.]0+$", "").cast("long")).withColumn("verdict", F.lower("verdict"))


def audited(edges: DataFrame, batch: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """edges after an audit: (id, verdict, reason); a batch not fully judged changes nothing."""
    open_ = batch.join(verdicts, "id", "left_anti").agg((F.count("*") == 0).alias("_whole"))  # one row
    bad = batch.select("id", F.col("updated_at").alias("expected_updated_at")).join(verdicts.filter("verdict = 'bad'"), "id")
    return superseded(edges, bad.crossJoin(F.broadcast(open_)).filter("_whole").select("id", "reason", "expected_updated_at"), now)


#: Edges of an audit batch, batches of a cycle, and failures after which a batch is skipped.
AUDIT_BATCH, AUDIT_CALLS, AUDIT_FAILURES = 20, 3, 3


def audit_pass(edges: DataFrame, verdicts: DataFrame, now: Column, after_id: int = 0, failures: int = 0) -> tuple[DataFrame, int, int]:
    """(edges, watermark, failures) after a cycle's audit: batches in id order past the watermark, as far as they are judged.

    verdicts: (id, verdict, reason) as given. The first batch not fully judged ends the pass and counts a failure; after
    AUDIT_FAILURES of them it is passed over. Past the last edge the watermark starts anew.
    """
    given = verdict_ids(verdicts)
    batch = for_audit(edges, after_id, AUDIT_BATCH * AUDIT_CALLS)
    judged = given.select("id").distinct().withColumn("_judged", F.lit(True))
    ids = [(r["id"], bool(r["_judged"])) for r in batch.select("id").join(judged, "id", "left").orderBy("id").collect()]  # at most AUDIT_BATCH * AUDIT_CALLS
    done: list[int] = []
    for at in range(0, len(ids), AUDIT_BATCH):
        part = ids[at : at + AUDIT_BATCH]
        if all(ok for _, ok in part):
            done += [i for i, _ in part]
            after_id, failures = part[-1][0], 0
            continue
        failures += 1
        if failures >= AUDIT_FAILURES:
            after_id, failures = part[-1][0], 0
        break
    if len(ids) < AUDIT_BATCH * AUDIT_CALLS and len(done) == len(ids):
        after_id = 0
    own = batch.filter(F.col("id").isin(*done) if done else F.lit(False))
    return audited(edges, own, given, now), after_id, failures


def probe(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys that exist, forward or mirrored, and are not superseded."""
    back = rows.select("platform", F.col("object_uid").alias("subject_uid"), F.col("subject_uid").alias("object_uid"), "relation_label")
    return edges.filter("status <> 'superseded'").select(*KEY).join(rows.select(*KEY).unionByName(back).distinct(), KEY, "left_semi").distinct()


def confirmed(clusters: DataFrame, after_id: int = 0, bot: str = "") -> DataFrame:
    """(n): how many confirmed clusters with a statement lie past a watermark."""
    return backfill_sources(clusters, after_id, None, bot).agg(F.count("*").alias("n"))


def backfill_pass(clusters: DataFrame, edges: DataFrame, extracted: DataFrame, known: DataFrame, now: Column, after_id: int = 0, revived: DataFrame | None = None, limit: int = 40, cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """(edges, clusters read) after one batch: the next `limit` sources past the watermark and up to `cap` revived ones (cluster_id).

    extracted: relations found in their statements; they make edges, and refresh those that exist without counting.
    """
    batch = backfill_sources(clusters, after_id, limit)
    if revived is not None:
        again = clusters.join(revived.select(F.col("cluster_id").alias("id")).distinct().orderBy("id").limit(cap), "id", "left_semi")
        batch = batch.unionByName(backfill_sources(again, 0, None)).dropDuplicates(["id"])
    rows = backfill_rows(extracted, batch, known).select(
        "platform", F.col("subject_user_id").alias("subject_uid"), F.col("object_user_id").alias("object_uid"), F.col("label").alias("relation_label"),
        F.col("subject_display_name").alias("subject_name"), F.col("object_display_name").alias("object_name"), "statement", "confidence", "occurred_at",
        "evidence_key", F.col("cluster_id").alias("pos"), F.lit(False).alias("count_on_conflict"), F.lit(False).alias("is_bot_edge"), F.lit(1).alias("min_evidence"),
    )
    return upserted(edges, rows, now), batch.select(F.col("id").alias("cluster_id"))


def backfill_sources(clusters: DataFrame, after_id: int, limit: int | None, bot: str = "") -> DataFrame:
    """Confirmed clusters with a statement, in id order past a watermark."""
    out = clusters.filter(F.col("status").isin("active", "profiled") & (F.trim("canonical_statement") != "") & (F.col("id") > after_id) & (F.col("user_id") != bot)).orderBy("id")
    return out.limit(limit) if limit else out


def directory(aliases: DataFrame) -> DataFrame:
    """(name, platform, user_id) of names that mean one person."""
    one = aliases.filter(~is_placeholder(F.col("name"))).groupBy("name").agg(F.min(F.struct("platform", "user_id")).alias("a"), F.max(F.struct("platform", "user_id")).alias("b"))
    return one.filter(F.col("a") == F.col("b")).select("name", "a.platform", "a.user_id")


def backfill_rows(items: DataFrame, clusters: DataFrame, known: DataFrame) -> DataFrame:
    """Extracted relations that hold: the cluster exists and is the subject's, the object is in the directory on that platform, the label stands in the statement."""
    c = clusters.select(F.col("id").alias("cluster_id"), "platform", F.col("user_id").alias("subject_user_id"), "canonical_statement", "occurred_at")
    o = known.select("platform", F.col("user_id").alias("object_user_id")).distinct()
    return valid_relations(items).join(c, ["cluster_id", "subject_user_id"]).join(o, ["platform", "object_user_id"]).filter(F.contains("canonical_statement", "label")).withColumn("evidence_key", F.concat(F.lit("backfill|"), F.col("cluster_id").cast("string")))


def selected(edges: DataFrame, text: str, nodes: list[str], bots: list[str], platform: str, addressed: bool, stopwords: list[str], per_anchor: int, total: int) -> DataFrame:
    """Edges to inject: the label stands in the text; people anchor by a named node (A), a bot edge by its named peer (A) or by being addressed (C)."""
    bot = F.array(*map(F.lit, bots)).cast("array<string>")
    node = F.array(*map(F.lit, nodes)).cast("array<string>")
    s, o = F.concat("platform", F.lit(":"), "subject_uid"), F.concat("platform", F.lit(":"), "object_uid")
    s_bot, o_bot = (F.col("platform") == platform) & F.array_contains(bot, F.col("subject_uid")), (F.col("platform") == platform) & F.array_contains(bot, F.col("object_uid"))
    peer = F.when(s_bot, o).otherwise(s)
    anchor = F.when(s_bot & o_bot, None).when(s_bot | o_bot, F.when(F.array_contains(node, peer), peer).when(F.lit(addressed), F.lit("bot"))).when(F.array_contains(node, s), s).when(F.array_contains(node, o), o)
    out = edges.withColumn("anchor", anchor).filter(F.col("anchor").isNotNull() & F.contains(F.lit(text), F.col("relation_label")))
    out = out.filter(~F.col("relation_label").isin(*stopwords)) if stopwords else out
    out = out.withColumn("scenario", F.when(F.col("anchor") == "bot", "C").otherwise("A"))
    w = Window.partitionBy("anchor").orderBy(F.desc("evidence_count"), F.desc("last_seen"), "id")
    return out.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_anchor).orderBy(F.desc("evidence_count"), F.desc("last_seen"), "id").limit(total).drop("rn")


#: How a relation reads as a sentence.
IS_OF, IS = "的", "是"


def statement_lines(edges: DataFrame, bots: list[str], platform: str, nickname: str, qualifier: Column | None = None) -> DataFrame:
    """edges with line: who is whose what, by name and number, bots by their nickname, the qualifier in brackets behind it."""
    bot = F.array(*map(F.lit, bots)).cast("array<string>")

    def end(uid: str, name: str) -> Column:
        own = F.trim(F.coalesce(F.col(name), F.lit("")))
        named = F.when((F.col("platform") == platform) & F.array_contains(bot, F.col(uid)) & (F.lit(nickname) != ""), F.lit(nickname)).otherwise(own)
        shown = F.concat(F.when(named == "", F.col(uid)).otherwise(named), F.lit("("), F.col(uid), F.lit(")"))
        return F.when(F.coalesce(F.col(uid), F.lit("")) == "", F.when(own == "", F.lit("?")).otherwise(own)).otherwise(shown)

    line = F.concat(end("subject_uid", "subject_name"), F.lit(IS_OF), F.coalesce("relation_label", F.lit("")), F.lit(IS), end("object_uid", "object_name"))
    if qualifier is not None:
        line = F.when(F.coalesce(qualifier, F.lit("")) == "", line).otherwise(F.concat(line, F.lit("（"), qualifier, F.lit("）")))
    return edges.withColumn("line", line)


def neighbours(selected_edges: DataFrame, order: list[Column], nodes: list[str], bots: list[str], platform: str, limit: int) -> DataFrame:
    """(platform, uid, name): endpoints of the selected edges that are no node and no bot, each once, in the edges' order.

    selected_edges: a bounded number of rows, as `selected` gives.
    """
    at = selected_edges.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("subject_uid").alias("uid"), F.col("subject_name").alias("n")), F.struct(F.lit(1).alias("side"), F.col("object_uid").alias("uid"), F.col("object_name").alias("n")))
    rows = at.select("platform", "_at", F.explode(ends).alias("e")).select("platform", "_at", "e.*").filter(F.coalesce("uid", F.lit("")) != "")
    if bots:
        rows = rows.filter(~((F.col("platform") == platform) & F.col("uid").isin(*bots)))
    if nodes:
        rows = rows.filter(~F.concat("platform", F.lit(":"), "uid").isin(*nodes))
    one = rows.groupBy("platform", "uid").agg(F.min(F.struct("_at", "side", F.trim(F.coalesce("n", F.lit(""))).alias("name"))).alias("m"))
    return one.orderBy("m").limit(limit).select("platform", "uid", F.col("m.name").alias("name"))


def delete_edge(edges: DataFrame, row_id: int) -> DataFrame:
    return edges.filter(F.col("id") != row_id)


def graph_stats(edges: DataFrame, limit: int = 500) -> DataFrame:
    """One row: edges in all and by status, and how many of them are shown."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("active", "pending", "superseded")]
    return edges.agg(F.count("*").alias("total"), *counts).withColumn("shown", F.least(F.col("total"), F.lit(limit)))


def graph(edges: DataFrame, aliases: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to show: the best edges, their endpoints with degree and the name to display."""
    top = edges.orderBy(F.desc("evidence_count"), F.desc("last_seen"), "id").limit(limit)
    ends = top.select("platform", F.explode(F.array(F.struct(F.col("subject_uid").alias("uid"), F.col("subject_name").alias("n")), F.struct(F.col("object_uid").alias("uid"), F.col("object_name").alias("n")))).alias("e")).select("platform", "e.uid", "e.n")
    nodes = ends.groupBy("platform", "uid").agg(F.count("*").alias("degree"), F.min(F.when(~is_placeholder(F.col("n")), F.col("n"))).alias("edge_name"))
    nodes = nodes.join(canonical_names(aliases).withColumnRenamed("user_id", "uid"), ["platform", "uid"], "left")
    return nodes.select(F.concat("platform", F.lit(":"), "uid").alias("node"), F.coalesce("canon", "edge_name", "uid").alias("name"), "degree"), top
