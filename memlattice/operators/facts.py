"""The fact state machine as state -> state transformations: merge, create, replace, decay, promote, status changes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cosine
from ..functions.numbering import numbered
from ..schemas import CATEGORIES, CONFIDENCES, Config
from ..sources.scratch import saved
from . import graph


def threshold(category: Column, c: Config) -> Column:
    return F.when(category == "recent", c.recent_promote).when(category == "naming", c.naming_promote).otherwise(c.promote)


def start_score(confidence: Column, c: Config) -> Column:
    return F.when(confidence == "high", c.start_high).otherwise(c.start_medium)


def valid_facts(items: DataFrame, max_chars: int = 200) -> DataFrame:
    """Encoder output that is a fact: known category and confidence, non-blank user and statement, trimmed and cut."""
    t = lambda n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))
    out = items.withColumns({n: t(n) for n in ("user_id", "statement", "category", "confidence", "display_name")})
    related = F.array_distinct(F.filter(F.transform(F.coalesce("related_user_ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    return out.filter((F.col("user_id") != "") & (F.col("statement") != "") & F.col("category").isin(*CATEGORIES) & F.col("confidence").isin(*CONFIDENCES)).withColumns({"statement": F.substring("statement", 1, max_chars), "related_user_ids": related})


def without_bot(facts: DataFrame, bots: list[str]) -> DataFrame:
    """No facts about the bot, and no bot among the related users."""
    ids = F.array(*map(F.lit, bots)).cast("array<string>")
    return facts.filter(~F.array_contains(ids, F.col("user_id"))).withColumn("related_user_ids", F.array_except("related_user_ids", ids))


def profile_of(clusters: DataFrame, now: Column) -> DataFrame:
    """Projection: a row for each profiled cluster."""
    return clusters.filter("status = 'profiled'").select(F.col("id").alias("cluster_id"), "platform", "user_id", "category", F.col("canonical_statement").alias("statement"), "score", "related_user_ids", now.alias("updated_at"))


# -- candidates and verdicts ------------------------------------------------------------------------------------


def candidates(facts: DataFrame, clusters: DataFrame, k: int = 20) -> DataFrame:
    """(fact_id, cluster_id, rank): per fact its k nearest clusters of its platform and category that share a person, dead and replaced ones included.

    Owner pairs are an equi-join on (platform, category, person), so no pair of all facts and clusters is made.
    A fact without a vector takes the latest clusters.
    """
    people = lambda d: F.array_distinct(F.concat(F.array("user_id"), F.coalesce("related_user_ids", F.array().cast("array<string>"))))
    f = facts.select(F.col("id").alias("fact_id"), "platform", "category", F.explode(people(facts)).alias("person"), F.col("embedding").alias("fv"))
    c = clusters.select(F.col("id").alias("cluster_id"), "platform", "category", F.explode(people(clusters)).alias("person"), F.col("embedding").alias("cv"), "updated_at")
    pairs = f.join(c, ["platform", "category", "person"]).dropDuplicates(["fact_id", "cluster_id"])
    near = pairs.withColumn("near", cosine(F.col("fv"), F.col("cv"))).filter(F.col("fv").isNull() | F.col("near").isNotNull())
    order = Window.partitionBy("fact_id").orderBy(F.col("near").desc_nulls_last(), F.desc("updated_at"), "cluster_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("fact_id", "cluster_id", "rank", "near")


#: What an adjudication may say of a fact and a candidate.
VERDICTS = ("same", "drift", "correction", "unrelated")


def valid_verdicts(given: DataFrame, candidates_: DataFrame) -> DataFrame:
    """given (fact_id, cluster_id as given, verdict) of known candidates: 1.0 counts as 1; 1.9, true and unknown verdicts go."""
    text = F.trim(F.col("cluster_id").cast("string"))
    ok = text.rlike(r"^[0-9]+([.]0+)?$") & F.col("verdict").isin(*VERDICTS)
    typed = given.filter(F.coalesce(ok, F.lit(False))).withColumn("cluster_id", F.regexp_replace(text, "[.]0+$", "").cast("long"))
    return typed.join(candidates_.select("fact_id", "cluster_id"), ["fact_id", "cluster_id"], "left_semi")


def actions(facts: DataFrame, clusters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(fact_id, action, cluster_id) from (fact_id, cluster_id, verdict, rank): the first valid correction replaces, else the first same merges, else create."""
    v = verdicts.join(clusters.select(F.col("id").alias("cluster_id"), "status", F.col("occurred_at").alias("c_at")), "cluster_id").filter("status <> 'replaced'")
    v = v.join(facts.select(F.col("id").alias("fact_id"), "confidence", F.col("occurred_at").alias("f_at")), "fact_id")
    fix = F.min(F.when((F.col("verdict") == "correction") & (F.col("confidence") == "high") & (F.col("f_at") >= F.col("c_at")), F.struct("rank", "cluster_id")))
    same = F.min(F.when(F.col("verdict") == "same", F.struct("rank", "cluster_id")))
    chosen = v.groupBy("fact_id").agg(fix.alias("fix"), same.alias("same"))
    out = facts.select(F.col("id").alias("fact_id")).join(chosen, "fact_id", "left")
    action = F.when(F.col("fix").isNotNull(), "replace").when(F.col("same").isNotNull(), "merge").otherwise("create")
    return out.select("fact_id", action.alias("action"), F.coalesce("fix.cluster_id", "same.cluster_id").alias("cluster_id"))


def successors(clusters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(cluster_id): what replaced a cluster that a new fact says again. The claim that took its place is contradicted."""
    old = clusters.filter("status = 'replaced' AND replaced_by IS NOT NULL").select(F.col("id").alias("cluster_id"), "replaced_by")
    return verdicts.filter("verdict = 'same'").join(old, "cluster_id").select(F.col("replaced_by").alias("cluster_id")).distinct()


# -- applying ---------------------------------------------------------------------------------------------------


def merged(clusters: DataFrame, facts: DataFrame, now: Column, c: Config = Config()) -> DataFrame:
    """clusters after the facts (with cluster_id) join them, in id order.

    A known evidence key adds nothing; a new one adds the start score up to the cap, revives and clears marks. As
    the score only rises and keys only grow, the fold is the sum over the first fact of each new key, in SQL.
    """
    f = facts.withColumn("points", start_score(F.col("confidence"), c))
    first = f.withColumn("_n", F.row_number().over(Window.partitionBy("cluster_id", "evidence_key").orderBy("id")))
    per = first.groupBy("cluster_id").agg(
        F.max("occurred_at").alias("_at"), F.count("*").alias("_facts"),
        F.sort_array(F.collect_list(F.when(F.col("_n") == 1, F.struct("id", F.col("evidence_key").alias("key"), "points")))).alias("_new"),
    )
    j = clusters.join(per, clusters["id"] == per["cluster_id"], "left")
    fresh = F.filter(F.coalesce("_new", F.array().cast("array<struct<id:bigint,key:string,points:double>>")), lambda x: ~F.array_contains(F.col("evidence_keys"), x["key"]))
    j = j.withColumn("_fresh", fresh)
    hit, grown = F.col("_facts").isNotNull(), F.size("_fresh") > 0
    out = j.withColumns({
        "score": F.when(grown, F.least(F.lit(c.cap), F.col("score") + F.aggregate("_fresh", F.lit(0.0), lambda a, x: a + x["points"]))).otherwise(F.col("score")),
        "evidence_count": F.col("evidence_count") + F.size("_fresh"),
        "evidence_keys": F.concat("evidence_keys", F.transform("_fresh", lambda x: x["key"])),
        "last_evidence_at": F.when(hit, F.greatest(F.coalesce("last_evidence_at", "occurred_at"), "_at")).otherwise(F.col("last_evidence_at")),
        "occurred_at": F.when(hit & (F.col("category") == "recent"), F.greatest("occurred_at", "_at")).otherwise(F.col("occurred_at")),
        "status": F.when(grown & F.col("status").isin("pending_uncertain", "dead"), "active").otherwise(F.col("status")),
        "demoted_at": F.when(~grown, F.col("demoted_at")), "contradicted_at": F.when(~grown, F.col("contradicted_at")),
        "updated_at": F.when(hit, now.cast(clusters.schema["updated_at"].dataType)).otherwise(F.col("updated_at")),
    })
    return out.select(*clusters.columns)


def created(facts: DataFrame, now: Column, c: Config = Config()) -> DataFrame:
    """A cluster for each fact; facts bring the cluster's id as cluster_new."""
    s = start_score(F.col("confidence"), c)
    none = F.lit(None).cast("timestamp")
    return facts.select(
        F.col("cluster_new").alias("id"), "platform", "user_id", "category", F.col("statement").alias("canonical_statement"), s.cast("double").alias("score"),
        F.when(s >= threshold(F.col("category"), c), "profiled").otherwise("active").alias("status"), F.lit(1).alias("evidence_count"),
        F.array("evidence_key").alias("evidence_keys"), F.array("id").alias("source_fact_ids"), F.col("occurred_at").alias("last_evidence_at"), "occurred_at",
        F.lit(None).cast("long").alias("replaced_by"), now.alias("written_at"), now.alias("updated_at"), "embedding", none.alias("demoted_at"),
        none.alias("contradicted_at"), "related_user_ids",
    )


def replaced(clusters: DataFrame, facts: DataFrame, now: Column, c: Config = Config()) -> DataFrame:
    """clusters after each fact (with cluster_id, cluster_new) replaces one: the old one is halved and points to its successor.

    facts: one for each cluster, of clusters that exist and are not replaced.
    """
    old = clusters.select(F.col("id").alias("cluster_id"), F.col("score").alias("old_score"))
    link = facts.select(F.col("cluster_new").alias("id"), "cluster_id").join(old, "cluster_id").select("id", "old_score")
    s = F.least(F.lit(c.cap), F.greatest("score", "old_score"))
    fresh = created(facts, now, c).join(link, "id").withColumn("score", s).withColumn("status", F.when(F.col("score") >= threshold(F.col("category"), c), "profiled").otherwise("active"))
    to = facts.select("cluster_id", F.col("cluster_new").alias("_next"))
    hit = F.col("_next").isNotNull()
    stamp = now.cast(clusters.schema["updated_at"].dataType)
    gone = clusters.join(to, clusters["id"] == to["cluster_id"], "left").withColumns({
        "status": F.when(hit, "replaced").otherwise(F.col("status")), "score": F.when(hit, F.col("score") * 0.5).otherwise(F.col("score")),
        "replaced_by": F.coalesce("_next", F.col("replaced_by") if "replaced_by" in clusters.columns else F.lit(None).cast("long")),
        "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
    })
    keep = clusters.columns if "replaced_by" in clusters.columns else [*clusters.columns, "replaced_by"]
    return gone.select(*keep).unionByName(fresh.select(*[x for x in keep if x in fresh.columns]), allowMissingColumns=True)


class Applied(NamedTuple):
    """The state after a batch of actions, and the facts (id) that wait for the next cycle."""

    clusters: DataFrame
    facts: DataFrame
    profiles: DataFrame | None
    edges: DataFrame | None
    deferred: DataFrame


def settled(todo: DataFrame, clusters: DataFrame) -> DataFrame:
    """todo (id, action, cluster_id, ...) with ok: whether the action holds when facts act in the order of their ids.

    The first fact that replaces a cluster does so; facts before it may join the cluster, facts after it find a replaced
    one and wait, as do those whose cluster is missing or was replaced before.
    """
    live = clusters.filter("status <> 'replaced'").select(F.col("id").alias("cluster_id"), F.lit(True).alias("_live"))
    fixes = todo.filter("action = 'replace'").groupBy("cluster_id").agg(F.min("id").alias("_fix"))
    j = todo.join(live, "cluster_id", "left").join(fixes, "cluster_id", "left")
    in_time = F.col("_fix").isNull() | (F.col("id") < F.col("_fix")) | ((F.col("id") == F.col("_fix")) & (F.col("action") == "replace"))
    ok = (F.col("action") == "create") | (F.coalesce("_live", F.lit(False)) & in_time)
    return j.withColumn("ok", ok).drop("_live", "_fix")


def synced_profiles(profiles: DataFrame, clusters: DataFrame, now: Column, rescored: DataFrame | None = None) -> DataFrame:
    """profiles with a row for each profiled cluster and no other. Rows keep id and creation.

    rescored: (cluster_id) whose rows take the cluster's score; a row's updated_at moves only if the score differs.
    """
    on = clusters.filter("status = 'profiled'").select(F.col("id").alias("cluster_id"), F.col("score").alias("_s"), "platform", "user_id", "category", F.col("canonical_statement").alias("statement"), "related_user_ids")
    stamp = now.cast(profiles.schema["updated_at"].dataType)
    kept = profiles.join(on.select("cluster_id", "_s"), "cluster_id")
    if rescored is not None:
        kept = kept.join(rescored.select("cluster_id", F.lit(True).alias("_hit")).distinct(), "cluster_id", "left")
        moved = F.coalesce("_hit", F.lit(False)) & (F.col("_s") != F.col("score"))
        kept = kept.withColumn("updated_at", F.when(moved, stamp).otherwise(F.col("updated_at"))).withColumn("score", F.when(moved, F.col("_s")).otherwise(F.col("score")))
    top = profiles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    new = on.join(profiles.select("cluster_id"), "cluster_id", "left_anti").withColumnRenamed("_s", "score").crossJoin(F.broadcast(top))
    new = numbered(new, F.col("cluster_id"), [], "id", F.col("_top")).withColumns({"created_at": stamp, "updated_at": stamp})
    return kept.select(*profiles.columns).unionByName(new.select(*[x for x in profiles.columns if x in new.columns]), allowMissingColumns=True)


def applied(clusters: DataFrame, facts: DataFrame, chosen: DataFrame, now: Column, c: Config = Config(), contradicted: DataFrame | None = None, profiles: DataFrame | None = None, edges: DataFrame | None = None) -> Applied:
    """State after every pending fact's action (fact_id, action, cluster_id), in the order of the facts' ids; done facts are skipped.

    contradicted: (cluster_id) to mark. A replaced cluster takes its profile row and the edges that rest on it alone with
    it. New clusters are numbered in the order of their facts.
    """
    if contradicted is not None:
        mark = contradicted.select(F.col("cluster_id").alias("id")).distinct().withColumn("_mark", F.lit(True))
        stamp = now.cast(clusters.schema["contradicted_at"].dataType)
        clusters = clusters.join(mark, "id", "left").withColumn("contradicted_at", F.when(F.col("_mark"), stamp).otherwise(F.col("contradicted_at"))).select(*clusters.columns)
    asked = facts.filter("extracted_flag = 0").join(chosen.withColumnRenamed("fact_id", "id"), "id")
    todo = saved(settled(asked, clusters), "todo")
    ok = todo.filter("ok").drop("ok")
    top = clusters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    fresh = numbered(ok.filter("action <> 'merge'").crossJoin(F.broadcast(top)), F.col("id"), [], "cluster_new", F.col("_top")).drop("_top")
    fresh = saved(fresh, "fresh")
    joins = ok.filter("action = 'merge'")
    state = replaced(merged(clusters, joins, now, c), fresh.filter("action = 'replace'"), now, c)
    new = created(fresh.filter("action = 'create'"), now, c)
    state = saved(state.unionByName(new.select(*[x for x in state.columns if x in new.columns]), allowMissingColumns=True), "clusters")
    done = facts.join(ok.select("id", F.lit(1).alias("_done")), "id", "left")
    done = done.withColumn("extracted_flag", F.when(F.col("_done") == 1, 1).otherwise(F.col("extracted_flag"))).select(*facts.columns)
    done = saved(done, "facts")
    after = None if profiles is None else saved(synced_profiles(profiles, state, now, joins.select("cluster_id")), "profiles")
    left = None if edges is None else saved(graph.retired(edges, fresh.filter("action = 'replace'").select("cluster_id"), now), "edges")
    return Applied(state, done, after, left, todo.filter("NOT ok").select("id"))


def apply(clusters: DataFrame, facts: DataFrame, chosen: DataFrame, now: Column, c: Config = Config(), contradicted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, facts) of applied()."""
    out = applied(clusters, facts, chosen, now, c, contradicted)
    return out.clusters, out.facts


# -- passes -----------------------------------------------------------------------------------------------------


def active_pairs(summaries: DataFrame, since: Column) -> DataFrame:
    """(platform, user_id) seen since then: trigger users and participants; what follows a second colon of a key is lost."""
    recent = summaries.filter((F.col("kind") != "bot_self") & (F.col("occurred_at") > since))
    people = recent.select(F.explode("participants").alias("p")).select(F.split_part("p", F.lit(":"), F.lit(1)).alias("platform"), F.split_part("p", F.lit(":"), F.lit(2)).alias("user_id"))
    return recent.select("platform", "user_id").unionByName(people).filter("user_id <> ''").distinct()


def anchors(profiles: DataFrame, clusters: DataFrame, n: int) -> DataFrame:
    """(cluster_id): the top n profile rows of each user and category, but for recent and contradicted ones."""
    w = Window.partitionBy("platform", "user_id", "category").orderBy(F.desc("score"), F.desc("updated_at"), "id")
    ok = clusters.filter("contradicted_at IS NULL").select(F.col("id").alias("cluster_id"))
    return profiles.filter("category <> 'recent'").join(ok, "cluster_id").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("cluster_id")


def decay(clusters: DataFrame, profiles: DataFrame, summaries: DataFrame | None, now: Column, c: Config = Config(), since: Column | None = None) -> DataFrame:
    """clusters after one pass: expiry, decay, demotion, death, in this order; anchors and activity are those before it.

    Each row's steps depend on the row and on those two sets alone, so the pass is two joins and one projection.
    Without `since` every pair counts as active.
    """
    keep = anchors(profiles, clusters, c.anchors).withColumnRenamed("cluster_id", "id").withColumn("_anchor", F.lit(True)) if c.anchors > 0 else None
    j = clusters.join(keep, "id", "left").withColumn("_anchor", F.coalesce("_anchor", F.lit(False))) if keep is not None else clusters.withColumn("_anchor", F.lit(False))
    if since is not None:
        j = j.join(active_pairs(summaries, since).withColumn("_live", F.lit(True)), ["platform", "user_id"], "left").withColumn("_live", F.coalesce("_live", F.lit(False)))
    else:
        j = j.withColumn("_live", F.lit(True))

    def before(col: Column, days: int) -> Column:
        return F.coalesce(col < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))

    on = F.col("status").isin("active", "profiled")
    j = j.withColumn("_expired", on & (((F.col("category") == "recent") & before(F.col("occurred_at"), c.recent_expire_days)) | ((F.col("category") == "commitment") & before(F.coalesce("last_evidence_at", "occurred_at"), c.commitment_expire_days))))
    falls = on & ~F.col("_expired") & (F.col("category") != "recent") & F.col("_live") & ~F.col("_anchor")
    lower = F.col("score") * c.decay
    if c.sticky > 0:
        lower = F.when((F.col("evidence_count") >= c.sticky) & F.col("contradicted_at").isNull() & (lower < c.demote), F.lit(c.demote)).otherwise(lower)
    j = j.withColumn("_fell", falls).withColumn("score", F.when(falls, lower).otherwise(F.col("score")))
    j = j.withColumn("_demoted", (F.col("status") == "profiled") & ~F.col("_expired") & (F.col("score") < c.demote) & F.col("_live") & ~F.col("_anchor"))
    down = F.col("_expired") | F.col("_demoted")
    stamp = now.cast(clusters.schema["updated_at"].dataType)
    j = j.withColumn("demoted_at", F.when(down, stamp).otherwise(F.col("demoted_at"))).withColumn("status", F.when(down, "pending_uncertain").otherwise(F.col("status")))
    dead = (F.col("status") == "pending_uncertain") & F.col("_live") & before(F.coalesce("demoted_at", "last_evidence_at", "occurred_at"), c.pending_dead_days)
    j = j.withColumn("_dead", dead).withColumn("status", F.when(dead, "dead").otherwise(F.col("status")))
    j = j.withColumn("updated_at", F.when(F.col("_expired") | F.col("_fell") | F.col("_demoted") | F.col("_dead"), stamp).otherwise(F.col("updated_at")))
    return j.select(*clusters.columns, F.col("_expired").alias("expired"), F.col("_demoted").alias("demoted"), F.col("_dead").alias("deaded"))


def decay_stats(after: DataFrame) -> DataFrame:
    """Counts of a decayed state."""
    return after.agg(
        F.count_if((F.col("category") == "recent") & F.col("expired")).alias("expired_recent"), F.count_if((F.col("category") == "commitment") & F.col("expired")).alias("expired_commitment"),
        F.count_if("demoted").alias("demoted"), F.count_if("deaded").alias("deaded"),
    )


def promote(clusters: DataFrame, now: Column, c: Config = Config()) -> DataFrame:
    up = (F.col("status") == "active") & (F.col("score") >= threshold(F.col("category"), c))
    stamp = now.cast(clusters.schema["updated_at"].dataType)
    return clusters.withColumn("updated_at", F.when(up, stamp).otherwise(F.col("updated_at"))).withColumn("status", F.when(up, "profiled").otherwise(F.col("status")))


def change_status(clusters: DataFrame, cluster_id: int, action: str, now: Column, platform: str = "", user_id: str = "") -> DataFrame:
    """drop, dispute or reactivate one cluster of that owner; another owner's cluster stays as it is."""
    own = F.col("id") == cluster_id
    if platform:
        own = own & (F.col("platform") == platform)
    if user_id:
        own = own & (F.col("user_id") == user_id)
    on = F.col("status").isin("active", "profiled")
    if action == "drop":
        hit = own & F.col("status").isin("active", "profiled", "pending_uncertain")
        return clusters.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(hit, "dead").otherwise(F.col("status")))
    if action == "dispute":
        return clusters.withColumn("contradicted_at", F.when(own & on & F.col("contradicted_at").isNull(), now).otherwise(F.col("contradicted_at")))
    if action == "reactivate":
        hit = own & F.col("status").isin("dead", "pending_uncertain")
        return clusters.withColumns({"demoted_at": F.when(~hit, F.col("demoted_at")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.when(hit, "active").otherwise(F.col("status"))})
    raise ValueError(f"unknown action: {action}")


def search(clusters: DataFrame, query: list[float], limit: int, platform: str = "", user_ids: list[str] | None = None, category: str = "", inactive: str = "no") -> DataFrame:
    """Nearest clusters; inactive: no | include | only. A list of users that is all blank finds nothing."""
    live, dead = ("active", "profiled"), ("replaced", "dead", "pending_uncertain")
    out = clusters.filter(F.col("status").isin(*{"no": live, "include": live + dead, "only": dead}[inactive]))
    if user_ids is not None:
        ids = [u for u in user_ids if u and u.strip()]
        out = out.filter(F.col("user_id").isin(*ids) if ids else F.lit(False))
    out = out.filter(F.col("platform") == platform) if platform else out
    out = out.filter(F.col("category") == category) if category else out
    q = F.array(*[F.lit(float(x)) for x in query])
    return out.withColumn("relevance", cosine(F.col("embedding"), q)).filter("relevance IS NOT NULL").orderBy(F.desc("relevance"), "id").limit(limit)


def owner_of(clusters: DataFrame, cluster_id: int) -> DataFrame:
    """(platform, user_id, status) of one cluster, for the guard of a correction."""
    return clusters.filter(F.col("id") == cluster_id).select("platform", "user_id", "status")


def with_related(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """clusters whose related users are unknown take the first known set among their source facts, by fact id."""
    lacks = clusters.filter(F.size("related_user_ids") == 0).select(F.col("id").alias("_c"), F.explode("source_fact_ids").alias("_f"))
    known = facts.filter(F.size("related_user_ids") > 0).select(F.col("id").alias("_f"), F.col("related_user_ids").alias("_r"))
    first = lacks.join(known, "_f").groupBy("_c").agg(F.min_by("_r", "_f").alias("_r"))
    return clusters.join(first, F.col("id") == F.col("_c"), "left").withColumn("related_user_ids", F.coalesce("_r", "related_user_ids")).select(*clusters.columns)


#: Failures after which a row is passed over, and rows of the list that remembers them.
ATTEMPTS, REMEMBERED = 5, 500


def skip_list(skips: DataFrame, failed: DataFrame, done: DataFrame) -> DataFrame:
    """(id, n, pos) of rows that failed n times in a row: failed (id) count on, done (id) leave; above REMEMBERED rows the older half goes."""
    last = skips.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))  # one row
    kept = skips.join(done.select("id"), "id", "left_anti")
    j = kept.join(failed.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "full_outer").crossJoin(F.broadcast(last))
    j = j.select("id", (F.coalesce("n", F.lit(0)) + F.coalesce("_hit", F.lit(0))).alias("n"), "pos", "_last")
    new = numbered(j.filter(F.col("pos").isNull()), F.col("id"), [], "_k", 0).withColumn("pos", F.col("_last") + F.col("_k"))
    out = j.filter(F.col("pos").isNotNull()).select("id", "n", "pos").unionByName(new.select("id", "n", "pos"))
    # the list holds REMEMBERED rows and a batch at most
    rank = F.row_number().over(Window.orderBy("pos"))
    size = F.count("*").over(Window.partitionBy())
    out = out.withColumn("_r", rank).withColumn("_n", size)
    return out.filter((F.col("_n") <= REMEMBERED) | (F.col("_r") > REMEMBERED // 2)).select("id", "n", "pos")


def pending(facts: DataFrame, batch: int = 200, skips: DataFrame | None = None) -> DataFrame:
    """Facts to adjudicate in id order: out of three times the batch those not passed over, then the batch."""
    rows = facts.filter("extracted_flag = 0").orderBy("id").limit(3 * batch)
    if skips is not None:
        rows = rows.join(skips.filter(F.col("n") >= ATTEMPTS).select("id"), "id", "left_anti")
    return rows.orderBy("id").limit(batch)
