"""A consolidation cycle in the order of its facts.

A fact sees what the facts before it did: the clusters they made, and those they replaced. So decisions are an ordered fold over
the facts of a platform and category (no cluster of another one is a candidate), and over each person's alone where none of
them is about two persons or corrects anything. A fold reads its facts one by one and holds the clusters it made, no more. It decides and nothing else; it gets each fact's nearest clusters with their similarity from an equi-join. What the decisions do
to scores, keys, profiles and edges is applied set by set: first what acts on clusters that were there, then, level by level, what
acts on clusters that the level before made (a level for each correction of a correction, rarely over one).

A verdict names a fact and either a cluster or, in ``made_by``, the fact whose cluster it is on. A fact with a candidate that has no
verdict waits; it makes no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Config
from ..sources.scratch import saved
from . import facts as rules
from . import graph, lifecycle, people

DECISION = "fact_id long, action string, cluster_id long, made_by long, level int, marks array<struct<cluster_id:bigint,made_by:bigint>>"


def similarity(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    if a is None or b is None or len(a) != len(b):
        return None
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else None


class Fold:
    """Decisions on facts that come in the order of their ids, all of one platform and category."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.made: dict[int, dict] = {}  # by the fact that made it
        self.of_person: dict[str, list[int]] = {}
        self.replaced: dict[tuple, tuple] = {}  # clusters replaced in this cycle, and what took their place

    def decide(self, f) -> tuple:
        """A row of DECISION; f: a fact's row, its candidates and verdicts in lists."""
        made, replaced = self.made, self.replaced
        vector = None if f.embedding is None else np.asarray(f.embedding, dtype=np.float64)
        said = {(v["cluster_id"], v["made_by"]): v["verdict"] for v in map(_dict, f.verdicts)}
        found = [(c["near"], 0, c["rank"], (c["cluster_id"], None), c) for c in map(_dict, f.candidates)]
        for n in dict.fromkeys(n for p in f.people for n in self.of_person.get(p, ())):
            m = made[n]
            near = similarity(vector, m["vector"])
            if vector is None or near is not None:
                found.append((near, -1, n, (None, n), m))  # of equal ones those of this cycle come first, as changed last
        found.sort(key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1], x[2]))
        found = found[: self.k]
        if any(key not in said for *_, key, _ in found):
            return f.id, "wait", None, None, 0, []
        is_replaced = lambda key, c: key in replaced or c["status"] == "replaced"
        live = [(said[key], key, c) for *_, key, c in found if not is_replaced(key, c)]
        fix = next((x for x in live if x[0] == "correction" and f.confidence == "high" and f.occurred_at >= pd.Timestamp(x[2]["occurred_at"])), None)
        same = next((x for x in live if x[0] == "same"), None)
        action, (_, key, target) = ("replace", fix) if fix else ("merge", same) if same else ("create", (None, (None, None), None))
        marks = [key for *_, key, _ in found if said[key] in ("correction", "drift")]
        for *_, hit, c in found:  # what took the place of a claim that is made again is contradicted
            if said[hit] == "same" and is_replaced(hit, c):
                marks.append(replaced.get(hit) or (c["replaced_by"], None))
        level = 0 if key[1] is None else made[key[1]]["level"] + 1
        if action == "merge" and key[1] is not None and f.category == "recent":
            target["occurred_at"] = max(target["occurred_at"], f.occurred_at)
        if action != "merge":
            for p in f.people:
                self.of_person.setdefault(p, []).append(f.id)
            made[f.id] = {"vector": vector, "occurred_at": f.occurred_at, "status": "active", "replaced_by": None, "level": level}
        if action == "replace":
            replaced[key] = (None, f.id)
        marks = [{"cluster_id": c, "made_by": m} for c, m in dict.fromkeys(marks) if c is not None or m is not None]
        return f.id, action, key[0], key[1], level, marks


def _dict(x: object) -> dict:
    return x.asDict() if hasattr(x, "asDict") else x


def parts(batch: DataFrame, said: DataFrame) -> DataFrame:
    """batch with `part`: facts that may see what another one made or replaced are of one part."""
    fixes = said.filter("verdict = 'correction'").select("fact_id").distinct().withColumn("fix", F.lit(1))
    of = batch.withColumn("group", F.to_json(F.struct("platform", "category")))
    alone = of.join(fixes, of["id"] == fixes["fact_id"], "left").groupBy("group").agg((F.max(F.size("people")) <= 1).alias("one"), (F.count("fix") == 0).alias("kept"))
    own = F.when(F.col("one") & F.col("kept"), F.coalesce(F.get("people", F.lit(0)), F.lit(""))).otherwise("")
    return of.join(alone, "group").withColumn("part", F.concat("group", own)).drop("group", "one", "kept")


def people_of(facts: DataFrame) -> Column:
    return F.array_distinct(F.concat(F.array("user_id"), F.coalesce("related_user_ids", F.array().cast("array<string>"))))


def decided(batch: DataFrame, clusters: DataFrame, verdicts: DataFrame, c: Config = Config(), k: int = 20) -> DataFrame:
    """DECISION for every fact of batch, in the order of their ids; verdicts: (fact_id, cluster_id, verdict[, made_by]). Runs jobs: candidates are stored."""
    cand = saved(rules.candidates(batch, clusters, k), "candidates")
    state = clusters.select(F.col("id").alias("cluster_id"), "status", "replaced_by", "occurred_at")
    near = F.struct("cluster_id", "rank", "near", "status", "replaced_by", "occurred_at")
    listed = cand.join(state, "cluster_id").groupBy("fact_id").agg(F.collect_list(near).alias("candidates"))  # k at most
    on_made = F.col("made_by").cast("long") if "made_by" in verdicts.columns else F.lit(None).cast("long")
    given = verdicts.withColumn("made_by", on_made)
    old = rules.valid_verdicts(given.filter("made_by IS NULL").drop("made_by"), cand).withColumn("made_by", F.lit(None).cast("long"))
    new = given.filter(F.col("made_by").isNotNull() & F.col("verdict").isin(*rules.VERDICTS)).withColumn("cluster_id", F.lit(None).cast("long"))
    said = old.select("fact_id", "cluster_id", "made_by", "verdict").unionByName(new.select("fact_id", "cluster_id", "made_by", "verdict"))
    said = said.join(batch.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    rows = batch.select(F.col("id").alias("fact_id"), "id", "platform", "category", "confidence", F.col("occurred_at").cast("timestamp").alias("occurred_at"), "embedding", people_of(batch).alias("people"))
    rows = parts(rows, said)
    listed_said = said.groupBy("fact_id").agg(F.collect_list(F.struct("cluster_id", "made_by", "verdict")).alias("verdicts"))
    rows = rows.join(listed, "fact_id", "left").join(listed_said, "fact_id", "left").drop("fact_id", "platform")
    none = lambda n, kind: F.coalesce(n, F.array().cast(kind))
    kinds = dict(rows.dtypes)
    rows = rows.withColumns({n: none(n, kinds[n]) for n in ("candidates", "verdicts")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, one = None, None
        for frame in frames:
            out = []
            for f in frame.itertuples(index=False):
                if one is None or f.part != at:
                    at, one = f.part, Fold(k)
                out.append(one.decide(f))
            yield pd.DataFrame(out, columns=["fact_id", "action", "cluster_id", "made_by", "level", "marks"]).astype({"cluster_id": "Int64", "made_by": "Int64"})

    return rows.repartition("part").sortWithinPartitions("part", "id").mapInPandas(run, DECISION)


def growth(state: DataFrame, joins: DataFrame, facts: DataFrame) -> DataFrame:
    """(cluster_id, grew): the last of the facts that joined a cluster and brought it a new evidence key; such a fact clears marks."""
    keyed = joins.join(facts.select(F.col("id").alias("fact_id"), "evidence_key"), "fact_id").groupBy("cluster_id", "evidence_key").agg(F.min("fact_id").alias("fact_id"))
    had = state.select(F.col("id").alias("cluster_id"), F.explode("evidence_keys").alias("evidence_key"))
    return keyed.join(had, ["cluster_id", "evidence_key"], "left_anti").groupBy("cluster_id").agg(F.max("fact_id").alias("grew"))


def consolidated(clusters: DataFrame, facts: DataFrame, decisions: DataFrame, now: Column, c: Config = Config(), profiles: DataFrame | None = None, edges: DataFrame | None = None) -> rules.Applied:
    """State after the decisions. Runs jobs: each level's state is stored."""
    known = decisions.filter("action <> 'wait'")
    top = clusters.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    levels = known.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0] + 1
    state, done, grown = clusters, facts, []
    out = rules.Applied(clusters, facts, profiles, edges, decisions.filter("action = 'wait'").select(F.col("fact_id").alias("id")))

    def owners() -> DataFrame:
        """(made_by, own): the clusters made so far; the first source of a cluster is the fact that made it."""
        return out.clusters.filter(F.col("id") > top).select(F.element_at("source_fact_ids", 1).alias("made_by"), F.col("id").alias("own"))

    for level in range(levels):
        own = known.filter(F.col("level") == level).join(owners(), "made_by", "left")
        chosen = own.select("fact_id", "action", F.coalesce("cluster_id", "own").alias("cluster_id"))
        chosen = saved(chosen, "level")
        grown.append(saved(growth(out.clusters, chosen.filter("action = 'merge'"), facts), "growth"))
        made = rules.applied(out.clusters, out.facts, chosen, now, c, profiles=out.profiles, edges=out.edges)
        out = made._replace(deferred=out.deferred.unionByName(made.deferred))
    marks = known.select("fact_id", F.explode("marks").alias("m")).select("fact_id", "m.cluster_id", "m.made_by").join(owners(), "made_by", "left")
    last = marks.select(F.coalesce("cluster_id", "own").alias("cluster_id"), "fact_id").groupBy("cluster_id").agg(F.max("fact_id").alias("marked"))
    for g in grown:
        last = last.join(g, "cluster_id", "left").filter(F.col("grew").isNull() | (F.col("grew") <= F.col("marked"))).drop("grew")
    stamp = now.cast(clusters.schema["contradicted_at"].dataType)
    hit = F.when(F.col("marked").isNotNull(), stamp).otherwise(F.col("contradicted_at"))
    names = out.clusters.columns
    state = out.clusters.join(last, out.clusters["id"] == last["cluster_id"], "left").withColumn("contradicted_at", hit).select(*names)
    return out._replace(clusters=saved(state, "marked"))


class Cycle(NamedTuple):
    """The state after a cycle, the facts (id) that wait, and what the cycle did."""

    clusters: DataFrame
    facts: DataFrame
    profiles: DataFrame
    summaries: DataFrame
    edges: DataFrame | None
    aliases: DataFrame | None
    deferred: DataFrame
    decisions: DataFrame


def reserved(budget: int, backlog: bool) -> tuple[int, int]:
    """(calls for facts, calls kept for encoding anew): a quarter, one at least, while rows wait for it, and never all."""
    keep = min(max(1, budget // 4), max(0, budget - 1)) if backlog else 0
    return budget - keep, keep


def cycle(
    clusters: DataFrame, facts: DataFrame, verdicts: DataFrame, profiles: DataFrame, summaries: DataFrame, now: Column, c: Config = Config(), since: Column | None = None, budget: int = 200,
    edges: DataFrame | None = None, aliases: DataFrame | None = None, edge_verdicts: DataFrame | None = None, skips: DataFrame | None = None, archive_on: bool = True, k: int = 20,
) -> Cycle:
    """Facts, decay, promotion, archive, names in facts, audit of edges, in this order; verdicts are given as tables.

    Facts go in id order up to the budget, of which a quarter stays for encoding anew (``ingest.reencoded``) while summaries wait
    for it. Runs jobs: the decisions and the state between passes are stored.
    """
    waits = not summaries.filter("NOT summarized").limit(1).isEmpty() if "summarized" in summaries.columns else False
    batch = saved(rules.pending(facts, reserved(budget, waits)[0], skips), "batch")
    decisions = saved(decided(batch, clusters, verdicts, c, k), "decisions")
    state = consolidated(clusters, facts, decisions, now, c, profiles, edges)
    rows = state.profiles
    after = saved(rules.decay(state.clusters, rows, summaries, now, c, since).drop("expired", "demoted", "deaded"), "decayed")
    left = saved(rules.synced_profiles(rows, after, now), "profiles")
    after = saved(rules.promote(after, now, c), "promoted")
    archived = lifecycle.archive(summaries, now, c.archive_days(), c.reinforce_days).drop("archived_now") if archive_on else summaries
    named = aliases
    if aliases is not None:
        seen = batch.select("platform", "id", "statement", F.col("occurred_at").alias("last_seen"))
        named = people.alias_upsert(aliases, people.fact_code_aliases(seen))
    audited = state.edges
    if audited is not None and edge_verdicts is not None:
        audited = graph.audit_pass(audited, edge_verdicts, now)[0]
    return Cycle(after, state.facts, rules.synced_profiles(left, after, now), archived, audited, named, state.deferred, decisions)
