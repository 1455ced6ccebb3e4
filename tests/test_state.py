"""State changes on small tables: facts, edges, store, imports, batches."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlattice.functions import exprs
from memlattice.functions.numbering import numbered
from memlattice.operators import admin, consolidation, facts, graph, ingest, lifecycle, names, people, recall, tools
from memlattice.schemas import ALIAS, CLUSTER, EDGE, FACT, KV, PROFILE, SUMMARY, Config
from memlattice.sources import importers, postings, store
from memlattice.streaming import retain

T0 = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def table(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def cluster(i, **k):
    return {"id": i, "platform": "qq", "user_id": "u", "category": "stable", "canonical_statement": "s", "score": 3.0, "status": "active", "evidence_count": 1, "evidence_keys": ["a"], "source_fact_ids": [], "last_evidence_at": T0, "occurred_at": T0, "updated_at": T0, "related_user_ids": []} | k


def fact(i, **k):
    return {"id": i, "document_id": f"d{i}", "platform": "qq", "user_id": "u", "related_user_ids": [], "display_name": "n", "category": "stable", "statement": "t", "confidence": "high", "session_id": "s", "group_id": "", "evidence_key": "b", "occurred_at": T0, "extracted_flag": 0} | k


def test_merge_scores_new_evidence_once(spark):
    c = table(spark, CLUSTER, [cluster(1)])
    step = lambda d, key: facts.merged(d, table(spark, FACT, [fact(9, evidence_key=key)]).withColumn("cluster_id", F.lit(1).cast("long")), now())
    assert step(c, "b").first()["score"] == 6.0
    assert step(c, "a").first()["score"] == 3.0
    both = facts.merged(c, table(spark, FACT, [fact(9), fact(10), fact(11, evidence_key="c"), fact(12, evidence_key="d")]).withColumn("cluster_id", F.lit(1).cast("long")), now()).first()
    assert (both["score"], both["evidence_count"], both["evidence_keys"]) == (10.0, 4, ["a", "b", "c", "d"])
    dead = table(spark, CLUSTER, [cluster(1, status="dead", demoted_at=T0)])
    assert facts.merged(dead, table(spark, FACT, [fact(9)]).withColumn("cluster_id", F.lit(1).cast("long")), now()).first()["status"] == "active"


def test_apply_creates_replaces_and_skips(spark):
    c = table(spark, CLUSTER, [cluster(1), cluster(2, score=8.0)])
    f = table(spark, FACT, [fact(1), fact(2), fact(3, category="naming"), fact(4, extracted_flag=1)])
    todo = spark.createDataFrame([(1, "merge", 1), (2, "replace", 2), (3, "create", None), (4, "create", None)], "fact_id long, action string, cluster_id long")
    state, done = facts.apply(c, f, todo, now())
    got = {r["id"]: r for r in state.collect()}
    assert len(got) == 4 and got[1]["score"] == 6.0
    assert (got[2]["status"], got[2]["score"], got[2]["replaced_by"]) == ("replaced", 4.0, 3)
    assert (got[3]["score"], got[3]["status"]) == (8.0, "profiled")
    assert (got[4]["category"], got[4]["status"]) == ("naming", "profiled")
    assert {r["id"]: r["extracted_flag"] for r in done.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    again, _ = facts.apply(state, done, todo, now())
    assert again.count() == 4


def profile(i, c, **k):
    return {"id": i, "platform": "qq", "user_id": "u", "category": "stable", "cluster_id": c, "statement": "s", "score": 3.0, "created_at": T0, "updated_at": T0, "related_user_ids": []} | k


def test_facts_act_in_the_order_of_their_ids(spark):
    c = table(spark, CLUSTER, [cluster(1), cluster(2, status="profiled", score=6.0), cluster(3, status="replaced", replaced_by=2), cluster(4, status="profiled", score=7.0)])
    f = table(spark, FACT, [fact(i, evidence_key=f"k{i}") for i in range(1, 9)])
    todo = spark.createDataFrame(
        [(1, "merge", 2), (2, "replace", 2), (3, "replace", 2), (4, "merge", 2), (5, "merge", 3), (6, "create", None), (7, "merge", 99), (8, "merge", 4)], "fact_id long, action string, cluster_id long"
    )
    edges = table(spark, EDGE, [edge(1, "a", "b", evidence_keys=["backfill|2", "backfill|x"]), edge(2, "a", "c", evidence_keys=["backfill|2", "s|1"]), edge(3, "a", "d", evidence_keys=["backfill|2", "backfill|1"]), edge(4, "a", "e", evidence_keys=["backfill|x"])])
    p = table(spark, PROFILE, [profile(1, 2, score=6.0), profile(2, 4, score=7.0), profile(3, 77)])
    mark = facts.successors(c, spark.createDataFrame([(5, 3, "same"), (6, 1, "same"), (6, 3, "drift")], "fact_id long, cluster_id long, verdict string"))
    assert [r["cluster_id"] for r in mark.collect()] == [2]
    out = facts.applied(c, f, todo, now(), contradicted=spark.createDataFrame([(1,)], "cluster_id long"), profiles=p, edges=edges)
    got = {r["id"]: r for r in out.clusters.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]  # each id once
    assert (got[2]["status"], got[2]["score"], got[2]["replaced_by"], got[2]["evidence_count"]) == ("replaced", 4.5, 5, 2)  # fact 1 joined before fact 2 replaced
    assert (got[5]["score"], got[5]["status"], got[5]["source_fact_ids"]) == (9.0, "profiled", [2]) and got[6]["source_fact_ids"] == [6]
    assert got[1]["contradicted_at"] is not None and got[3]["score"] == 3.0
    assert sorted(r["id"] for r in out.deferred.collect()) == [3, 4, 5, 7]
    assert {r["id"] for r in out.facts.filter("extracted_flag = 1").collect()} == {1, 2, 6, 8}
    assert {r["id"]: r["status"] for r in out.edges.collect()} == {1: "superseded", 2: "active", 3: "active", 4: "active"}
    rows = {r["cluster_id"]: r for r in out.profiles.collect()}
    assert set(rows) == {4, 5} and (rows[4]["id"], rows[4]["score"]) == (2, 10.0) and rows[5]["id"] == 4 and rows[4]["created_at"] == T0


def test_cycle(spark):
    c = table(spark, CLUSTER, [cluster(1, score=5.0, embedding=[1.0, 0.0]), cluster(2, user_id="w")])
    f = table(spark, FACT, [fact(1, embedding=[1.0, 0.0]), fact(2, user_id="nobody"), fact(3, embedding=[0.0, 1.0])])
    given = spark.createDataFrame([(1, "1.0", "same"), (3, "1.5", "same"), (3, "true", "same")], "fact_id long, cluster_id string, verdict string")
    out = consolidation.cycle(c, f, given, table(spark, PROFILE, []), table(spark, SUMMARY, []), now())
    got = {r["id"]: r for r in out.clusters.collect()}
    assert got[1]["status"] == "profiled" and len(got) == 3  # joined, then promoted; fact 2 made a cluster
    assert [r["id"] for r in out.deferred.collect()] == [3]  # its candidate has no valid verdict
    assert [r["cluster_id"] for r in out.profiles.collect()] == [1]
    assert consolidation.reserved(200, True) == (150, 50) and consolidation.reserved(1, True) == (1, 0) and consolidation.reserved(3, True) == (2, 1) and consolidation.reserved(9, False) == (9, 0)
    skips = facts.skip_list(spark.createDataFrame([(9, 4, 0), (8, 1, 1)], "id long, n int, pos long"), spark.createDataFrame([(9,), (7,)], "id long"), spark.createDataFrame([(8,)], "id long"))
    assert sorted((r["id"], r["n"]) for r in skips.collect()) == [(7, 1), (9, 5)]
    assert [r["id"] for r in facts.pending(f, 2, spark.createDataFrame([(1, 5, 0)], "id long, n int, pos long")).collect()] == [2, 3]


def test_facts_of_a_cycle_act_in_sequence(spark):
    """A fact sees the clusters that earlier ones of its cycle made and replaced; corrections and drift mark, later evidence clears."""
    v, w = [1.0, 0.0], [0.0, 1.0]
    t = lambda h: T0 + dt.timedelta(hours=h)
    c = table(spark, CLUSTER, [cluster(7, embedding=v, evidence_keys=["k0"]), cluster(8, user_id="w", embedding=v), cluster(9, user_id="w", status="replaced", replaced_by=8, embedding=w)])
    f = table(spark, FACT, [
        fact(1, user_id="n", embedding=v, evidence_key="a"), fact(2, user_id="n", embedding=v, evidence_key="b"),  # equal new facts: one cluster
        fact(3, user_id="n", embedding=v, evidence_key="c", occurred_at=t(1)), fact(4, user_id="n", embedding=v, evidence_key="d", occurred_at=t(1)),  # 3 replaces it, 4 says the new one again
        fact(5, embedding=v, evidence_key="e"), fact(6, embedding=v, evidence_key="f"),  # drift marks 7, then new evidence for 7
        fact(10, user_id="w", embedding=w, evidence_key="g"),  # says a replaced claim again: its successor is marked
        fact(11, user_id="n", embedding=v, evidence_key="h"),  # no verdict on what 3 made
    ])
    said = [(2, None, 1, "same"), (3, None, 1, "correction"), (4, None, 1, "unrelated"), (4, None, 3, "same"), (5, "7", None, "drift"), (6, "7", None, "same"), (6, None, 5, "unrelated"), (10, "8", None, "unrelated"), (10, "9", None, "same"), (11, None, 1, "same")]
    given = spark.createDataFrame(said, "fact_id long, cluster_id string, made_by long, verdict string")
    out = consolidation.cycle(c, f, given, table(spark, PROFILE, []), table(spark, SUMMARY, []), now(), archive_on=False)
    acts = {r["fact_id"]: (r["action"], r["cluster_id"], r["made_by"], r["level"]) for r in out.decisions.collect()}
    assert acts == {1: ("create", None, None, 0), 2: ("merge", None, 1, 1), 3: ("replace", None, 1, 1), 4: ("merge", None, 3, 2), 5: ("create", None, None, 0), 6: ("merge", 7, None, 0), 10: ("create", None, None, 0), 11: ("wait", None, None, 0)}
    got = {r["source_fact_ids"][0] if r["id"] > 9 else -r["id"]: r for r in out.clusters.collect()}
    assert len(got) == 7 and len({r["id"] for r in got.values()}) == 7
    assert got[1]["status"] == "replaced" and got[1]["replaced_by"] == got[3]["id"] and got[1]["evidence_count"] == 2 and got[3]["evidence_count"] == 2
    assert got[1]["contradicted_at"] is not None and got[-7]["contradicted_at"] is None and got[-8]["contradicted_at"] is not None and got[3]["contradicted_at"] is None
    assert [r["id"] for r in out.deferred.collect()] == [11] and {r["id"] for r in out.facts.filter("extracted_flag = 0").collect()} == {11}


def test_a_fold_reads_its_facts_one_by_one(spark, monkeypatch):
    """Facts of persons that share nothing are folded apart, and what a fold gets at once is no whole group."""
    f = table(spark, FACT, [fact(i, user_id=f"u{i % 3}", category="stable" if i < 9 else "naming", related_user_ids=["u0"] if i == 11 else [], embedding=[1.0, 0.0]) for i in range(1, 15)])
    pairs = [(j, None, i, "same") for i in range(1, 15) for j in range(i + 1, 15)]
    given = spark.createDataFrame(pairs, "fact_id long, cluster_id string, made_by long, verdict string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r["fact_id"]: (r["action"], r["made_by"]) for r in consolidation.decided(f, table(spark, CLUSTER, []), given).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    makers = {i: [j for j in range(1, 9) if j % 3 == i % 3][0] for i in range(1, 9)} | {9: 9, 10: 10, 11: 9, 12: 9, 13: 10, 14: 14}
    assert {i: m for i, (a, m) in got.items() if a == "merge"} == {i: m for i, m in makers.items() if i != m}
    rows = f.select("id", "platform", "category", consolidation.people_of(f).alias("people"))
    by = {r["id"]: r["part"] for r in consolidation.parts(rows, given.limit(0)).collect()}
    assert len({by[i] for i in range(1, 9)}) == 3 and len({by[i] for i in range(9, 15)}) == 1  # of the others, one is about two persons


def test_related_users_come_from_the_first_known_source(spark):
    c = table(spark, CLUSTER, [cluster(1, source_fact_ids=[3, 2, 1]), cluster(2, related_user_ids=["z"], source_fact_ids=[2]), cluster(3)])
    f = table(spark, FACT, [fact(1), fact(2, related_user_ids=["b"]), fact(3, related_user_ids=["c"])])
    assert {r["id"]: r["related_user_ids"] for r in facts.with_related(c, f).collect()} == {1: ["b"], 2: ["z"], 3: []}


def test_tools(spark):
    c, f, p = table(spark, CLUSTER, [cluster(1, score=6.0, status="profiled", embedding=[1.0, 0.0])]), table(spark, FACT, []), table(spark, PROFILE, [profile(1, 1, score=6.0)])
    item = spark.createDataFrame([("qq", "s", "", "u", "Ann", "stable", "likes tea", "high", dt.datetime(2030, 1, 1), [1.0, 0.0])], "platform string, session_id string, group_id string, user_id string, display_name string, category string, statement string, confidence string, occurred_at timestamp, embedding array<float>")
    one = tools.write(c, f, p, item, now())
    assert one.summary.first().asDict() == {"action": "create", "cluster_id": 2}
    assert one.facts.first()["occurred_at"] == dt.datetime(2024, 2, 1) and "2030-01-01" in one.facts.first()["document_id"]
    two = tools.write(one.clusters, one.facts, one.profiles, item, now())
    assert two.summary.first()["action"] == "skipped" and two.clusters.count() == 2
    fix = tools.correct(two.clusters, two.facts, two.profiles, item, 1, now())
    assert fix.summary.first().asDict() == {"action": "replace", "cluster_id": 3} and "#" not in fix.facts.first()["document_id"]
    assert {r["id"]: r["status"] for r in fix.clusters.collect()} == {1: "replaced", 2: "active", 3: "profiled"}
    other = item.withColumn("user_id", F.lit("w"))
    assert tools.correct(c, f, p, other, 1, now()).summary.first()["action"] == "skipped"  # not the owner's
    gone, left = tools.remove(c, p, 1, "drop", now(), "qq", "u")
    assert gone.first()["status"] == "dead" and left.count() == 0
    a = table(spark, ALIAS, [{"id": 1, "platform": "qq", "user_id": "u", "name": "Ann", "first_seen": T0, "last_seen": T0, "source": "x"}])
    assert "## stable\n- s" in tools.profile(p, c, a, "qq", "u").first()["text"]
    e = table(spark, EDGE, [edge(1, "u", "v"), edge(2, "x", "y")])
    assert [(r["kind"], r["id"], r["name"]) for r in tools.lookup(c, e, a, [1.0, 0.0], 5).orderBy("kind").collect()] == [("fact", 1, "Ann"), ("relation", 1, "Ann")]
    assert people.resolved(a, "ａｎｎ").count() == 1 and people.resolved(a.unionByName(a.withColumn("user_id", F.lit("z"))), "Ann").count() == 0
    section = tools.relation_section(e, "my friend", ["qq:u"], ["bot"], "qq", "Robin", False, now())
    assert section.first()["line"] == "S(u)的friend是O(v)（2024-01-01）"
    assert [tuple(r) for r in graph.neighbours(e, [F.col("id")], ["qq:u"], [], "qq", 2).collect()] == [("qq", "v", "O"), ("qq", "x", "S")]


def test_encoded_batches(spark):
    none = dict(bot="b")
    made = [("u", ["b", "v"], "Ann", "stable", "用户12345（Bob）likes tea", "high"), (none["bot"], [], "", "stable", "bot fact", "high"), ("u", [], "", "odd", "x", "high")]
    rel = [("u", "v", "unknown", "Vic", "friend", "u and v", "high"), ("u", "b", "Ann", "Robin", "friend", "u and bot", "medium")]
    schema = f"session_id string, platform string, group_id string, user_id string, occurred_at timestamp, participants array<string>, text string, summary string, ok boolean, embedding array<float>, facts {ingest.FACTS}, relations {ingest.RELATIONS}"
    b = spark.createDataFrame([("s", "qq", "", "u", T0, ["qq:u"], "raw", "short", True, [1.0, 0.0], made, rel), ("s", "qq", "", "u", T0, ["qq:u"], "lost\0", None, False, None, [], [])], schema)
    tables = [table(spark, t, []) for t in (FACT, ALIAS, EDGE, SUMMARY)]
    out = ingest.retained(b, *tables, now(), ["b"])
    f = out.facts.collect()
    assert [(r["user_id"], r["related_user_ids"], r["evidence_key"]) for r in f] == [("u", ["v"], "s|2024-01-01")] and f[0]["document_id"].startswith("u-v@s|2024-01-01-")
    assert [(r["user_id"], r["name"]) for r in out.aliases.collect()] == [("12345", "Bob")]
    assert {(r["object_uid"], r["status"], r["subject_name"]) for r in out.edges.collect()} == {("v", "active", "unknown"), ("b", "pending", "Ann")} or {(r["object_uid"], r["status"]) for r in out.edges.collect()} == {("v", "active"), ("b", "pending")}
    s = {r["content"]: r for r in out.summaries.collect()}
    assert s["short"]["summarized"] and not s["lost\ufffd"]["summarized"] and s["short"]["document_id"].startswith("s-")
    twice = ingest.retained(b, *out, now(), ["b"])
    assert [t.count() for t in twice] == [1, 1, 2, 2] and twice.edges.agg(F.max("evidence_count")).first()[0] == 1
    near = b.filter("ok").withColumn("summary", F.lit("other words"))
    assert ingest.retained(near, *out, now(), ["b"]).summaries.count() == 2  # as near as the latest summary
    row = out.summaries.filter("NOT summarized").first()["id"]
    enc = spark.createDataFrame([(row, True, "found", [0.0, 1.0], made[:1], [])], f"id long, ok boolean, summary string, embedding array<float>, facts {ingest.FACTS}, relations {ingest.RELATIONS}")
    again = ingest.reencoded(out.summaries, enc, *out[:3], now(), ["b"])
    assert again.summaries.filter("summarized AND content = 'found'").count() == 1 and again.facts.count() == 1


def test_admin_edits(spark):
    c, p = table(spark, CLUSTER, [cluster(1, status="profiled", score=7.0), cluster(2, status="dead"), cluster(3, status="replaced")]), table(spark, PROFILE, [profile(1, 1, score=7.0)])
    e = table(spark, EDGE, [edge(1, "a", "b", evidence_keys=["backfill|1"])])
    out = admin.edit_cluster(c, 1, now(), p, e, status="dead")
    assert out.profiles.count() == 0 and out.edges.first()["status"] == "superseded" and out.revived.count() == 0
    back = admin.edit_cluster(c, 2, now(), p, e, status="profiled", score=99.0, statement="new")
    assert [r["cluster_id"] for r in back.revived.collect()] == [2] and {r["cluster_id"]: (r["statement"], r["score"]) for r in back.profiles.collect()} == {1: ("s", 7.0), 2: ("new", 10.0)}
    assert admin.update_cluster(c, 3, now(), status="active", score=5.0).filter("id = 3").first()["status"] == "replaced"
    for bad in ({"statement": " "}, {"status": "x"}):
        with pytest.raises(ValueError):
            admin.update_cluster(c, 1, now(), **bad)
    assert admin.update_edge(e, 1, "superseded", now()).first()["supersede_reason"] == "manual" and graph.delete_edge(e, 1).count() == 0


def test_audit_pass(spark):
    e = table(spark, EDGE, [edge(i, f"a{i}", "b") for i in range(1, 46)])
    v = spark.createDataFrame([(str(i), "bad" if i == 3 else "ok", "why") for i in range(1, 41)] + [("41.5", "bad", "")], "id string, verdict string, reason string")
    state, at, failed = graph.audit_pass(e, v, now())
    assert (at, failed) == (40, 1) and [r["id"] for r in state.filter("status = 'superseded'").collect()] == [3]
    assert graph.audit_pass(e, v, now(), 40, 2)[1:] == (45, 0)  # passed over after three failures


def test_copying_a_store(spark):
    src = {"summary": table(spark, SUMMARY, [row(1, None), row(2, None)]), "fact": table(spark, FACT, [fact(1), fact(2)]), "cluster": table(spark, CLUSTER, [cluster(1, source_fact_ids=[2, 1]), cluster(2, canonical_statement="b", status="replaced", replaced_by=1)]),
        "alias": table(spark, ALIAS, []), "edge": table(spark, EDGE, [edge(1, "a", "b", evidence_keys=["backfill|1", "k"])]), "kv": spark.createDataFrame([("x", "1", T0)], KV), "profile": table(spark, PROFILE, [profile(1, 1)])}
    dst = {"summary": table(spark, SUMMARY, [row(9, None, document_id="d1")]), "fact": table(spark, FACT, [fact(5, document_id="z")]), "cluster": table(spark, CLUSTER, [cluster(7, canonical_statement="q")]), "alias": table(spark, ALIAS, []), "edge": table(spark, EDGE, []), "kv": spark.createDataFrame([], KV), "profile": table(spark, PROFILE, [])}
    out, report = store.copied(src, dst)
    got = {r["name"]: tuple(r)[1:] for r in report.collect()}
    assert got["summary"] == (2, 1, 1, 0) and got["fact"] == (2, 0, 2, 0) and all(x[3] == 0 for x in got.values())
    c = {r["canonical_statement"]: r for r in out["cluster"].collect()}
    assert (c["s"]["id"], c["b"]["id"], c["b"]["replaced_by"], c["s"]["source_fact_ids"]) == (8, 9, 8, [7, 6])
    assert out["edge"].first()["evidence_keys"] == ["backfill|8", "k"] and out["profile"].first()["cluster_id"] == 8


def test_numbers_without_gaps(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 1000 - 500).alias("x"), "id")
    got = sorted((r["n"], r["x"], r["id"]) for r in numbered(df, F.col("x"), ["id"], "n", 10).collect())
    assert [g[0] for g in got] == list(range(11, 3011)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert numbered(df.limit(0), F.col("x"), ["id"]).count() == 0


def test_memos_in_flight(spark):
    at = lambda s: dt.datetime(2024, 2, 1) - dt.timedelta(seconds=s)
    m = spark.createDataFrame([("k", "a", at(100), True), ("k", "b", at(4000), True), ("k", "c", at(100), False), ("k", "d", at(400), False)], "key string, document_id string, at timestamp, committed boolean")
    assert sorted(r["document_id"] for r in lifecycle.fresh_memos(m, now()).collect()) == ["a", "c"]
    more = lifecycle.committed(lifecycle.staged(m, "q", spark.createDataFrame([("z",)], "document_id string"), now()), "q")
    assert more.filter("key = 'q'").first()["committed"]


def test_status_changes(spark):
    c = table(spark, CLUSTER, [cluster(1)])
    gone = facts.change_status(c, 1, "drop", now(), "qq", "u")
    assert gone.first()["status"] == "dead"
    assert facts.change_status(gone, 1, "reactivate", now()).first()["status"] == "active"
    assert facts.change_status(c, 1, "drop", now(), "qq", "other").first()["status"] == "active"
    assert facts.change_status(c, 1, "dispute", now()).first()["contradicted_at"] is not None
    with pytest.raises(ValueError):
        facts.change_status(c, 1, "x", now())


def test_fact_search_fails_closed(spark):
    c = table(spark, CLUSTER, [cluster(1, embedding=[1.0, 0.0]), cluster(2, status="dead", embedding=[1.0, 0.0])])
    assert [r["id"] for r in facts.search(c, [1.0, 0.0], 5).collect()] == [1]
    assert facts.search(c, [1.0, 0.0], 5, user_ids=[" "]).count() == 0
    assert [r["id"] for r in facts.search(c, [1.0, 0.0], 5, inactive="only").collect()] == [2]


def row(i, vec, **k):
    return {"id": i, "document_id": f"d{i}", "kind": "chat_summary", "platform": "qq", "session_id": "s", "group_id": "", "user_id": "u", "participants": ["qq:u"], "content": f"c{i}", "occurred_at": T0 + dt.timedelta(hours=i), "written_at": T0, "embedding": vec, "summarized": True, "archived": False} | k


def test_distinct_vectors_is_greedy(spark):
    rows = table(spark, SUMMARY, [row(1, [1.0, 0.0]), row(2, [1.0, 0.0]), row(3, [0.0, 1.0]), row(4, [0.71, 0.71]), row(5, None), row(6, [0.0, 0.0]), row(7, [1.0])])
    keep = lambda t: [r["id"] for r in recall.distinct_vectors(rows, [("id", True)], t).orderBy("id").collect()]
    assert keep(0.85) == [1, 3, 4, 5, 6, 7]
    assert keep(0.7) == [1, 3, 5, 6, 7]


def test_quota(spark):
    rows = table(spark, SUMMARY, [row(1, None, user_id="a"), row(2, None, user_id="a"), row(3, None, user_id="x", participants=["qq:b"]), row(4, None, user_id="z", participants=[]), row(5, None, user_id="z", participants=[]), row(6, None, user_id="a", participants=["qq:b"])])
    got = recall.within_quota(rows, ["a", "b"], "qq", 1, [("id", True)])
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4]


def test_scope_rejects_and_defaults():
    with pytest.raises(ValueError):
        recall.predicate(recall.Scope("nowhere"))


def edge(i, s, o, **k):
    return {"id": i, "platform": "qq", "subject_uid": s, "object_uid": o, "subject_name": "S", "object_name": "O", "relation_label": "friend", "statement": "x", "status": "active", "confidence": "medium", "evidence_count": 1, "evidence_keys": ["k0"], "first_seen": T0, "last_seen": T0, "occurred_at": T0, "updated_at": T0} | k


ROW = "platform string, subject_uid string, object_uid string, relation_label string, subject_name string, object_name string, statement string, confidence string, occurred_at timestamp, evidence_key string, is_bot_edge boolean, min_evidence int, count_on_conflict boolean, pos int"


def test_edge_upsert(spark):
    old = table(spark, EDGE, [edge(1, "a", "b"), edge(2, "c", "d", status="superseded")])
    t1 = T0 + dt.timedelta(days=1)

    def r(s, o, pos, key="k1", name="N", bot=False, need=1, count=True, conf="medium"):
        return ("qq", s, o, "friend", name, name, f"st{pos}", conf, t1, key, bot, need, count, pos)

    rows = spark.createDataFrame([
        r("a", "b", 1, conf="high"), r("a", "b", 2, name="unknown"), r("a", "b", 3, key="k2", count=False), r("b", "a", 4), r("c", "d", 5, bot=True), r("x", "y", 6, bot=True, need=2), r("x", "y", 7, key="k2", bot=True, need=2), r("y", "x", 8),
    ], ROW)
    got = {(e["subject_uid"], e["object_uid"]): e for e in graph.upserted(old, rows, now()).collect()}
    assert set(got) == {("a", "b"), ("c", "d"), ("x", "y")}
    ab = got["a", "b"]
    assert (ab["id"], ab["evidence_count"], ab["evidence_keys"], ab["subject_name"], ab["statement"], ab["confidence"]) == (1, 2, ["k0", "k1"], "N", "st3", "high")
    assert got["c", "d"]["status"] == "superseded" and got["x", "y"]["status"] == "active" and got["x", "y"]["evidence_count"] == 2
    assert graph.upserted(old, rows, now(), ["friend"]).filter("evidence_count > 1").count() == 0


def test_edge_selection(spark):
    e = table(spark, EDGE, [edge(1, "a", "b"), edge(2, "bot", "c"), edge(3, "a", "d"), edge(4, "a", "f")])
    pick = lambda nodes, addressed, stop=(), per=9, total=9: sorted((r["id"], r["scenario"]) for r in graph.selected(e, "my friend", nodes, ["bot"], "qq", addressed, list(stop), per, total).collect())
    assert pick(["qq:a"], False) == [(1, "A"), (3, "A"), (4, "A")]
    assert pick(["wx:a"], False) == [] and pick([], False) == []
    assert pick([], True) == [(2, "C")] and pick(["qq:c"], False) == [(2, "A")]
    assert pick(["qq:a"], False, ("friend",)) == [] and len(pick(["qq:a"], False, (), 2)) == 2 and len(pick(["qq:a"], False, (), 9, 2)) == 2


def test_supersede_is_optimistic(spark):
    e = table(spark, EDGE, [edge(1, "a", "b"), edge(2, "c", "d")])
    ids = spark.createDataFrame([(1, "why", T0), (2, "", T0 + dt.timedelta(1))], "id long, reason string, expected_updated_at timestamp")
    assert {r["id"]: r["status"] for r in graph.superseded(e, ids, now()).collect()} == {1: "superseded", 2: "active"}


def test_aliases(spark):
    seen = spark.createDataFrame([("qq", "1", "Ann (cat)", T0), ("qq", "1", "Ann", T0 + dt.timedelta(1)), ("qq", "", "x", T0)], "platform string, uid string, name string, last_seen timestamp")
    rows = people.alias_rows(seen, "batch", 2)
    assert {r["name"] for r in rows.collect()} == {"Ann", "Ann (cat)"}
    codes = people.fact_code_aliases(spark.createDataFrame([("qq", 1, "用户12345（Bob）是朋友", T0)], "platform string, id long, statement string, last_seen timestamp"))
    assert [(r["user_id"], r["name"]) for r in codes.collect()] == [("12345", "Bob")]
    a = spark.createDataFrame([("qq", "1", "Ann", T0), ("qq", "2", "Bob", T0), ("qq", "3", "Bob", T0)], "platform string, user_id string, name string, last_seen timestamp")
    text = spark.createDataFrame([(1, "ask ＡＮＮ and bob")], "text_id int, text string")
    assert [r["user_id"] for r in people.matched(text, a).collect()] == ["1"]
    window = spark.createDataFrame([("qq", "3")], "platform string, user_id string")
    assert {r["user_id"] for r in people.matched(text, a, window).collect()} == {"1", "3"}


@pytest.mark.parametrize("many", [names.MANY, 0])
def test_names_in_texts_as_by_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(names, "MANY", many)  # 0: by grams, as where names do not fit
    own = [("qq", "1", "Ann"), ("qq", "1", "ann"), ("wx", "2", "Anna"), ("qq", "3", "nab"), ("qq", "4", "Bob"), ("qq", "5", "BOB"), ("qq", "6", "猫"), ("qq", "7", "\U0001d4d0\U0001d4d1\U0001d4d2d"), ("qq", "8", "hello"), ("qq", "9", "小猫咪")]
    a = spark.createDataFrame([(*r, T0 + dt.timedelta(i)) for i, r in enumerate(own)], "platform string, user_id string, name string, last_seen timestamp")
    said = ["", None, "annab bob", "ANNABANNA", "小猫咪 hello", "abcd", "x", "nab" * 5000 + "ann", "ann", "ann"]
    texts = spark.createDataFrame(list(enumerate(said)), "text_id int, text string")
    keys = {}
    for p, u, n in own:
        if len(k := exprs.normalize_alias(n)) >= 2 and k != "hello":
            keys.setdefault(k, {})[(p, u)] = n
    for backed in (None, [("qq", "4")], [("qq", "4"), ("qq", "5")]):
        window = None if backed is None else spark.createDataFrame(backed, "platform string, user_id string")
        clear = sorted([(-len(k), k, p, u, n) for k, who in keys.items() for (p, u), n in who.items() if len(who) == 1 or (p, u) in (backed or [])])
        for cap in (1, 2, 4):
            want = sorted((i, p, u, n) for i, t in enumerate(said) for _, _, p, u, n in [c for c in clear if c[1] in exprs.normalize_alias(t)][:cap])
            got = people.matched(texts, a, window, cap, stopwords=("Hello",))
            assert sorted(map(tuple, got.collect())) == want
        vague = people.skipped(texts, a, window, stopwords=("hello",))
        assert sorted(map(tuple, vague.collect())) == ([] if backed else [(2, "BOB")])
    assert people.matched(texts, a.limit(0)).count() == 0 and people.matched(texts.limit(0), a).count() == 0


def test_names_leave_texts_where_they_are(spark):
    a = spark.createDataFrame([("qq", "1", "Ann")], "platform string, user_id string, name string")
    texts = spark.range(100).select(F.col("id").alias("text_id"), F.lit("ann and bob").alias("text"))
    plan = people.matched(texts, a)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("ArrowEvalPython") == 1
    assert people.matched(texts, a).count() == 100


def test_people_of_the_window_come_first(spark):
    kind = "text_id int, platform string, user_id string, name string"
    directory = spark.createDataFrame([(1, "qq", "1", "Annabel"), (1, "qq", "2", "Bo"), (1, "qq", "3", "Caroline"), (2, "qq", "1", "Annabel")], kind)
    window = spark.createDataFrame([(1, "qq", "1", "Ann"), (1, "qq", "4", "Di"), (3, "qq", "5", "Ed"), (3, "qq", "5", "Eddie")], kind)
    got = lambda cap: sorted((r["text_id"], r["user_id"], r["name"]) for r in people.with_window(directory, window, cap).collect())
    assert got(4) == [(1, "1", "Ann"), (1, "2", "Bo"), (1, "3", "Caroline"), (1, "4", "Di"), (2, "1", "Annabel"), (3, "5", "Eddie")]
    assert got(3) == [(1, "1", "Ann"), (1, "3", "Caroline"), (1, "4", "Di"), (2, "1", "Annabel"), (3, "5", "Eddie")]


def test_whitelist_denies_by_default(spark):
    e = spark.createDataFrame([("qq", "1", "9", "qq:gm:9")], "platform string, user_id string, raw_session string, session_id string")
    assert admin.allowed(e, [], []).count() == 0
    assert admin.allowed(e, ["qq:1"], []).count() == 1 and admin.allowed(e, ["1"], ["8"]).count() == 0 and admin.allowed(e, [], ["qq:9"]).count() == 1


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/m")
    assert s.read("summary").count() == 0
    new = table(spark, SUMMARY, [row(1, None), row(2, None, occurred_at=dt.datetime(2030, 1, 1)), row(3, None, document_id="d1")]).drop("id")
    first = store.insert_summaries(s.read("summary"), new, now())
    s.write("summary", first)
    again = store.insert_summaries(s.read("summary"), new, now())
    assert again.count() == s.read("summary").count() == 2
    assert again.filter("document_id = 'd2'").first()["occurred_at"] == dt.datetime(2024, 2, 1)
    s.put("k", "v1", now()), s.put("k", "v2", now())
    assert s.get("k") == "v2" and s.get("x") is None
    assert s.migrate([(1, "init"), (2, "more")], now()) == [1, 2] and s.migrate([(2, "more"), (3, "x")], now()) == [3]
    up = store.upsert_facts(table(spark, FACT, [fact(1)]), table(spark, FACT, [fact(7, document_id="d1", display_name=""), fact(8)]))
    assert {r["document_id"]: r["display_name"] for r in up.collect()} == {"d1": "n", "d8": "n"}
    with pytest.raises(ValueError):
        store.missing_embeddings("kv", new, 1)
    with pytest.raises(ValueError):
        store.backend("oracle")


def test_import(spark, tmp_path):
    (tmp_path / "chat_memory.json").write_text(
        '{"qq:gm:77": {"title": "t", "memory": [[{"role": "user", "content": "[Sep 10 2026 18:44 Thu] hi", "sender_id": "5", "sender_name": "Ann"}, {"role": "assistant", "content": "yo"}],'
        ' [{"role": "assistant", "content": "alone"}], [{"role": "user", "content": "[x] Notice [user_id: system_task] go"}]]}, "bad": {"memory": [[{"role": "user", "content": "x"}]]}}'
    )
    chunks = importers.read_sessions(spark, str(tmp_path / "chat_memory.json"))
    p = importers.preview(chunks).first()
    assert (p["sessions"], p["chunks_total"], p["chunks"], p["bot_only"], p["notices"]) == (2, 4, 2, 2, 1)
    r = importers.summary_rows(chunks, now(), "Robin").collect()
    assert len(r) == 1 and r[0]["participants"] == ["qq:5"] and r[0]["occurred_at"] == dt.datetime(2026, 9, 10, 18, 44) and r[0]["content"] == "Ann: [Sep 10 2026 18:44 Thu] hi\nRobin: yo"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.toml").write_text('id = "1"\ntype = "fact"\ntext = " likes tea "\nimportance = 8\n[source]\nsession = "qq:dm:5"\ntime = 2026-09-01T10:00:00\n')
    (tmp_path / "f" / "b.toml").write_text("broken = ")
    f = importers.fact_rows(importers.read_facts(spark, str(tmp_path / "f")), "qq", "5").collect()
    assert len(f) == 1 and (f[0]["statement"], f[0]["confidence"], f[0]["session_id"]) == ("likes tea", "high", "5")


def lines(*rows):
    return pd.DataFrame([{"msg_key": k, "line": t, "uid": u, "is_bot": u == "bot", "ts": pd.Timestamp(T0) + pd.Timedelta(seconds=s)} for k, t, u, s in rows], columns=["msg_key", "line", "uid", "is_bot", "ts"])


def test_retain_step():
    s, due = retain.step(None, "qq:dm:1", lines(("1", "a", "u", 0), ("1", "a2", "u", 1), ("2", "b", "bot", 2)), 1)
    assert [(d["lines"], d["bot_lines"], d["rounds"], d["participants"], d["history"]) for d in due] == [(["a2"], ["b"], 1, ["u"], [])]
    s, due = retain.step(s, "qq:dm:1", lines(("3", "alone", "bot", 3), ("4", "c", "w", 4)), 1)
    assert not due and not s["rounds"]  # the bot alone is no round
    s, due = retain.step(s, "qq:dm:1", lines(("5", "d", "bot", 5)), 1)
    assert due[0]["lines"] == ["c"] and due[0]["bot_lines"] == ["alone", "d"] and due[0]["history"] == ["a2", "b"]
    s, due = retain.step(s, "x", lines(*[(f"m{i}", f"t{i}", "u", 10 + i) for i in range(50)], ("e", "z", "bot", 90)), 2)
    assert not due and len(s["cache"]) == retain.LINES and s["lines"] == [f"t{i}" for i in range(21, 50)]
    s, due = retain.step(s, "x", lines(("f", "y", "v", 91), ("g", "z2", "bot", 92)), 2)
    assert due[0]["rounds"] == 2 and due[0]["lines"][-1] == "y" and due[0]["participants"] == ["u", "v"]


def test_waiting_batches(spark):
    kind = "session_key string, first_ts timestamp, last_ts timestamp, lines array<string>, bot_lines array<string>, history array<string>, participants array<string>, rounds int, failed boolean, user_id string, generation int"
    t = lambda h: T0 + dt.timedelta(hours=h)
    b = spark.createDataFrame([
        ("s", t(2), t(3), ["c"], ["d"], ["x"], ["u", "v"], 1, False, "u", 1), ("s", t(0), t(1), ["a"], ["b"], [], ["u"], 2, False, "u", 1), ("s", t(-1), t(0), ["f"], [], [], ["w"], 1, True, "w", 1),
    ], kind)
    got = {r["failed"]: r for r in retain.merged(b).collect()}
    assert (got[False]["lines"], got[False]["bot_lines"], got[False]["history"], got[False]["participants"], got[False]["rounds"], got[False]["last_ts"]) == (["a", "c"], ["b", "d"], [], ["u", "v"], 3, t(3))
    assert got[True]["lines"] == ["f"]  # flushed alone
    assert retain.reseated(b.limit(0), b).filter("failed").count() == 3
    assert retain.not_erased(b, spark.createDataFrame([("u", 2)], "user_id string, generation int")).count() == 1
    rows = spark.createDataFrame([("s", "old", t(1)), ("k", "kept", t(5))], "session_key string, payload string, updated_at timestamp")
    new = retain.stored(rows, spark.createDataFrame([("s", "new", t(2)), ("k", "late", t(3))], rows.schema))
    assert {r["session_key"]: r["payload"] for r in new.collect()} == {"s": "new", "k": "kept"}
    assert [r["session_key"] for r in retain.cleared(new, spark.createDataFrame([("s", t(2)), ("k", t(4))], "session_key string, cutoff timestamp")).collect()] == ["k"]
    sent = spark.createDataFrame([("s", f"m{i}", t(i)) for i in range(5)] + [("s", "m0", t(9))], "session_key string, message_id string, ts timestamp")
    assert sorted(r["message_id"] for r in retain.bot_messages(sent, 3).collect()) == ["m2", "m3", "m4"]
    runs = spark.createDataFrame([("cycle", dt.datetime(2024, 1, 31, 23)), ("decay", T0)], "name string, last_run timestamp")
    assert sorted(r["name"] for r in retain.due(runs, now()).collect()) == ["archive", "decay", "embeddings"]
    m = spark.createDataFrame([(1, "s", "why", ["k1", "k2", "k3", "zz"]), (2, "s", "alone", [])], "turn_id int, session_key string, text string, quotes array<string>")
    cache = spark.createDataFrame([("s", f"k{i}", f" line {i} ", t(i)) for i in (1, 2, 3)], "session_key string, msg_key string, line string, ts timestamp")
    assert {r["turn_id"]: r["query"] for r in retain.quote_text(m, cache).collect()} == {1: "why line 1 line 2", 2: "alone"}


def test_decay_needs_activity(spark):
    c = table(spark, CLUSTER, [cluster(1), cluster(2, user_id="w"), cluster(3, category="recent", occurred_at=dt.datetime(2023, 1, 1))])
    s = table(spark, SUMMARY, [row(1, None)])
    p = facts.profile_of(c, now()).withColumn("id", F.lit(1))
    got = {r["id"]: r for r in facts.decay(c, p, s, now(), Config(), F.lit("2023-12-01").cast("timestamp")).collect()}
    assert got[1]["score"] == pytest.approx(2.7) and got[2]["score"] == 3.0 and got[3]["status"] in ("pending_uncertain", "dead")


def test_postings_are_made_without_an_exchange(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Tea tea 茶道茶 x"), (2, ""), (3, None), (4, "x y")], "id long, content string")
    got = {(r["token"], r["id"]): (r["tf"], r["len"], r["bucket"]) for r in postings.postings(rows).collect()}
    assert got == {(t, i): (n, size, postings.bucket_of(t)) for t, i, n, size in [("tea", 1, 2, 5), ("茶道", 1, 1, 5), ("道茶", 1, 1, 5), ("x", 1, 1, 5), ("x", 4, 1, 2), ("y", 4, 1, 2)]}
    assert "Exchange" not in postings.postings(rows)._jdf.queryExecution().executedPlan().toString()
    postings.write(rows, str(tmp_path))
    read, stats = postings.read(spark, str(tmp_path))
    assert read.count() == 6 and stats.first().asDict() == {"n": 4, "avg": 7 / 4}
