"""Backfill of relations: windows, names before asking, the first failed batch, revived clusters, a run that goes on."""

import json

import pytest
from pyspark.sql import functions as F
from test_state import T0, cluster, now, table

from memlattice.operators import backfill, graph
from memlattice.schemas import CLUSTER, EDGE
from memlattice.sources.scratch import saved

ALIASES = [("qq", "a", "Ann"), ("qq", "b", "Bob"), ("wx", "c", "Cleo"), ("qq", "d", "Twin"), ("qq", "e", "Twin"), ("qq", "f", "unknown")]


@pytest.fixture
def aliases(spark):
    return spark.createDataFrame(ALIASES, "platform string, user_id string, name string")


def rel(cid, s, o, label="friend", **k):
    return {"cluster_id": cid, "subject_user_id": s, "object_user_id": o, "subject_display_name": "S", "object_display_name": "O", "label": label, "statement": f"{s} {label} {o}", "confidence": "high"} | k


def teller(spark, answers, seen=None):
    """An outer model: the answer of a batch by the id of its first item."""

    def ask(asked):
        got = asked.select("batch", F.col("items")[0]["id"].alias("id"), "names.name").collect()
        if seen is not None:
            seen.extend((r["id"], r["name"]) for r in got)
        return spark.createDataFrame([(r["batch"], answers.get(r["id"])) for r in got], "batch long, answer string")

    return ask


def told(*rels):
    return json.dumps({"relations": list(rels)})


def test_directory_drops_names_of_several_and_knows_the_bot(spark, aliases):
    assert {r["key"] for r in backfill.known_names(aliases).collect()} == {"Ann", "Bob", "Cleo"}
    got = {r["key"]: (r["platform"], r["user_id"]) for r in backfill.known_names(aliases, "9", " Bob ").collect()}
    assert got == {"Ann": ("qq", "a"), "Cleo": ("wx", "c"), "Bob": ("", "9")}


def test_batches_hold_windows_and_names(spark, aliases):
    c = table(spark, CLUSTER, [cluster(i, user_id="bot" if i == 3 else "u", canonical_statement="Ann and Twin" if i == 2 else "nobody", status="dead" if i == 4 else "active") for i in range(1, 8)])
    revived = spark.createDataFrame([(1,), (4,), (99,)], "cluster_id long")
    got = {r["batch"]: ([i["id"] for i in r["items"]], [n["name"] for n in r["names"]], r["last_id"]) for r in backfill.batches(c, backfill.known_names(aliases), 0, revived, 3, 10, 6, "bot").collect()}
    assert got == {-2: ([1], [], 1), 0: ([1, 2], ["Ann"], 3), 1: ([5, 6, 7], [], 7)}
    few = backfill.batches(c, backfill.known_names(aliases), 2, None, 2, 1, 6, "bot").collect()
    assert [(r["batch"], [i["id"] for i in r["items"]], r["last_id"]) for r in few] == [(0, [5], 5)]
    assert backfill.batches(c.limit(0), backfill.known_names(aliases)).count() == 0


def test_answers_are_read_part_by_part(spark):
    asked = spark.createDataFrame([(0, ["x"]), (1, ["x"]), (2, ["x"]), (3, ["x"]), (4, []), (5, ["x"])], "batch long, names array<string>")
    said = [(0, '```json\n{"relations": [{"cluster_id": "7", "label": 5}, 3, null]}\n```'), (1, '{"relations": "none"}'), (2, "sorry"), (3, None), (5, '{"relations": []}')]
    got = {r["batch"]: r for r in backfill.read(asked, spark.createDataFrame(said, "batch long, answer string")).selectExpr("batch", "ok", "size(relations) n", "try_variant_get(get(relations, 0), '$.cluster_id', 'bigint') id").collect()}
    assert {b: r["ok"] for b, r in got.items()} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: True}
    assert (got[0]["n"], got[0]["id"], got[5]["n"]) == (3, 7, 0)


def test_relations_that_hold(spark, aliases):
    c = table(spark, CLUSTER, [cluster(1, user_id="u", canonical_statement="Ann is a friend"), cluster(2, user_id="u", canonical_statement="Cleo is a friend", occurred_at=None), cluster(3, user_id="v", canonical_statement="Momo is a friend")])
    e = table(spark, EDGE, [])
    answer = told(
        rel(1, "u", "a", object_display_name="unknown"), rel(1, "u", "a", statement="again"), rel(1, "x", "a"), rel(1, "u", "b"), rel(1, "u", "a", "enemy"), rel(2, "u", "c"), rel(77, "u", "a"),
        rel("3", "v", "9"), 5, rel(1, "u", None), rel(1, "u", "u"),
    )
    one = backfill.backfill_wave(c, e, aliases, teller(spark, {1: answer}), now(), bots=("9",), nickname="Momo")
    got = {(r["subject_uid"], r["object_uid"]): r for r in one.edges.collect()}
    # a friend of Cleo is on another platform, Bob is not named in the batch
    assert set(got) == {("u", "a"), ("v", "9")} and (one.written, one.discarded, one.failed, one.watermark, one.more) == (2, 9, 0, 3, False)
    assert got["u", "a"]["object_name"] == "Ann" and got["u", "a"]["statement"] == "u friend a" and got["u", "a"]["evidence_keys"] == ["backfill|1"]
    assert got["v", "9"]["status"] == "pending" and got["u", "a"]["status"] == "active"


def test_no_names_no_question(spark, aliases):
    c = table(spark, CLUSTER, [cluster(i, canonical_statement="with Ann" if i == 3 else "alone") for i in range(1, 7)])
    seen = []
    one = backfill.backfill_wave(c, table(spark, EDGE, []), aliases, teller(spark, {3: told()}, seen), now(), size=2)
    assert seen == [(3, ["Ann"])] and (one.batches, one.failed, one.watermark, one.clusters) == (3, 0, 6, 6)


def test_stops_at_the_first_failed_batch(spark, aliases):
    c = table(spark, CLUSTER, [cluster(i, canonical_statement="Ann, a friend") for i in range(1, 7)])
    e = table(spark, EDGE, [])
    ok = {1: told(rel(1, "u", "a")), 3: "no json", 5: told(rel(5, "u", "a", statement="later"))}
    one = backfill.backfill_wave(c, e, aliases, teller(spark, ok), now(), size=2)
    assert (one.watermark, one.failed, one.written) == (2, 1, 1) and one.edges.first()["statement"] == "u friend a"
    two = backfill.backfill_wave(c, saved(one.edges, "e"), aliases, teller(spark, ok | {3: told()}), now(), one.watermark, size=2)
    row = two.edges.first()
    # an edge that exists is refreshed and not counted again
    assert (two.watermark, two.failed, row["evidence_count"], row["statement"]) == (6, 0, 1, "later")


def test_a_revived_batch_that_fails_stops_all(spark, aliases):
    c = table(spark, CLUSTER, [cluster(i, canonical_statement="Ann, a friend") for i in range(1, 9)])
    revived = spark.createDataFrame([(1,), (2,), (3,), (4,)], "cluster_id long")
    seen = []
    ask = teller(spark, {1: told(rel(1, "u", "a")), 3: "", 5: told(rel(5, "u", "a")), 7: told()}, seen)
    one = backfill.backfill_wave(c, table(spark, EDGE, []), aliases, ask, now(), 4, revived, size=2)
    assert (one.watermark, one.failed, one.written) == (4, 1, 1)
    assert sorted(r["cluster_id"] for r in one.again.collect()) == [3, 4] and len(seen) == 4


def test_a_run_goes_on_where_it_stopped(spark, aliases):
    c = table(spark, CLUSTER, [cluster(i, user_id=f"u{i}", canonical_statement="Ann, a friend") for i in range(1, 11)])
    answers = {i: told(rel(i, f"u{i}", "a"), rel(i + 1, f"u{i + 1}", "a")) for i in range(1, 10, 2)}
    kept = {}

    def commit(one):
        kept.update(edges=saved(one.edges, "kept"), mark=one.watermark)
        return kept["edges"]

    def broken(one):
        if one.watermark > 4:
            raise RuntimeError("killed")
        return commit(one)

    args = {"size": 2, "count": 2}
    with pytest.raises(RuntimeError):
        backfill.backfill_run(c, table(spark, EDGE, []), aliases, teller(spark, answers), now(), broken, **args)
    assert kept["mark"] == 4 and kept["edges"].count() == 4
    seen = []
    done = backfill.backfill_run(c, kept["edges"], aliases, teller(spark, answers, seen), now(), commit, kept["mark"], **args)
    assert [p.watermark for p in done] == [8, 10] and sorted(i for i, _ in seen) == [5, 7, 9]
    assert sorted(r["subject_uid"] for r in kept["edges"].collect()) == sorted(f"u{i}" for i in range(1, 11))
    again = backfill.backfill_run(c, kept["edges"], aliases, teller(spark, answers), now(), commit, 0, **args)
    assert len(again) == 3 and {r["evidence_count"] for r in kept["edges"].collect()} == {1}
    assert graph.confirmed(c, kept["mark"]).first()["n"] == 0


def test_a_long_run_takes_few_passes(spark, aliases, monkeypatch):
    """Passes grow, sources are put in order once, and passes without relations leave the edges alone."""
    c = table(spark, CLUSTER, [cluster(i, canonical_statement="alone") for i in range(1, 13)])
    numbered, calls = backfill.numbered, []
    monkeypatch.setattr(backfill, "numbered", lambda *a: calls.append(1) or numbered(*a))
    monkeypatch.setattr(backfill, "upserted", None)
    e = table(spark, EDGE, [])
    done = backfill.backfill_run(c, e, aliases, teller(spark, {}), now(), lambda one: one.edges, size=1, count=1)
    assert [p.watermark for p in done] == [1, 2, 4, 6, 10, 12] and len(calls) == 1 and done[-1].edges.columns == graph.UPSERTED
