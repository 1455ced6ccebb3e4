"""Relations from statements that were stored before there was a graph: windows of clusters, an outer model's answers, edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import backfill_key, is_placeholder, repaired_json
from ..functions.numbering import numbered
from ..sources.scratch import saved
from .graph import UPSERTED, backfill_sources, directory, upserted, valid_relations
from .names import found

#: What an answer's relation holds, besides the cluster it was read from.
PARTS = ("subject_user_id", "object_user_id", "subject_display_name", "object_display_name", "label", "statement", "confidence")


def known_names(aliases: DataFrame, bot: str = "", nickname: str = "") -> DataFrame:
    """(key, platform, user_id) of names that mean one person, and of the bot on every platform (''), whose nickname is its own."""
    known = directory(aliases).select(F.col("name").alias("key"), "platform", "user_id")
    if not (bot.strip() and nickname.strip()):
        return known
    own = known.sparkSession.createDataFrame([(nickname.strip(), "", bot.strip())], "key string, platform string, user_id string")
    return known.filter(F.col("key") != nickname.strip()).unionByName(own)


def ordered(clusters: DataFrame, after_id: int = 0) -> DataFrame:
    """The sources past the watermark with their place n from 1, stored: passes of a run read their own part of it."""
    return saved(numbered(backfill_sources(clusters, after_id, None), F.col("id"), [], "n", 0), "sources")


def batches(
    clusters: DataFrame, known: DataFrame, after_id: int = 0, revived: DataFrame | None = None, size: int = 40, count: int = 256, cap: int = 500, bot: str = "",
    sources: DataFrame | None = None, done: int = 0,
) -> DataFrame:
    """(batch, last_id, items, names): up to `cap` revived clusters (cluster_id) in batches before 0, then the next `count` batches past the watermark.

    items: up to `size` (id, platform, user_id, statement, occurred_at) in the order of ids; the bot's own clusters belong to a
    window, but are not asked about. names: (name, platform, user_id) that stand in one of its statements, by name. Where
    there are none, nothing need be asked. sources: what `ordered` gave, of which the first `done` are behind the watermark; without
    it the next ones are looked up. Runs jobs; the result is a stored table.
    """
    if sources is None:
        rows = numbered(backfill_sources(clusters, after_id, size * count), F.col("id"), [], "n", 0)
    else:
        rows = sources.filter((F.col("n") > done) & (F.col("n") <= done + size * count)).withColumn("n", F.col("n") - done)
    rows = rows.withColumn("batch", F.floor((F.col("n") - 1) / size))
    rows = rows.withColumn("asked", F.col("user_id") != bot)
    if revived is not None:
        ids = revived.select(F.col("cluster_id").alias("id")).distinct().orderBy("id").limit(cap)
        again = numbered(backfill_sources(clusters.join(F.broadcast(ids), "id", "left_semi"), 0, None), F.col("id"), [], "n", 0)
        first = -(-cap // size)
        rows = rows.unionByName(again.withColumn("batch", F.floor((F.col("n") - 1) / size) - first).withColumn("asked", F.lit(True)))
    rows = saved(rows.select("batch", "asked", "id", "platform", "user_id", F.col("canonical_statement").alias("statement"), "occurred_at"), "windows")
    said = rows.filter("asked").select(F.struct("batch", "id").alias("text_id"), F.col("statement").alias("text"))
    named = found(said, known, False).groupBy("text_id.batch").agg(F.sort_array(F.collect_set(F.struct(F.col("key").alias("name"), "platform", "user_id"))).alias("names"))
    one = F.when(F.col("asked"), F.struct("id", "platform", "user_id", "statement", "occurred_at"))
    made = rows.groupBy("batch").agg(F.max("id").alias("last_id"), F.array_sort(F.collect_list(one)).alias("items"))
    return saved(made.join(named, "batch", "left").withColumn("names", F.coalesce("names", F.filter(F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("platform"), F.lit("").alias("user_id"))), lambda n: F.lit(False)))), "batches")


def read(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """asked with ok and relations: what answers (batch, answer) say; ok is false where an answer is missing or holds no list of relations.

    An element, or a part of one, of the wrong type is null; the others stay. A batch without names is ok and empty.
    """
    parsed = F.try_parse_json(repaired_json(F.col("answer")))
    told = answers.groupBy("batch").agg(F.min("answer").alias("answer")).select("batch", F.try_variant_get(parsed, "$.relations", "array<variant>").alias("relations"))
    out = asked.join(told, "batch", "left")
    none = F.size("names") == 0
    relations = F.when(none, F.lit(None)).otherwise(F.col("relations"))
    return out.withColumn("ok", none | F.col("relations").isNotNull()).withColumn("relations", relations)


def rows_of(told: DataFrame, known: DataFrame, now: Column, bots: tuple[str, ...] = (), min_evidence: int = 2) -> DataFrame:
    """Edge rows, as `upserted` takes them, of what `read` gives: one for each relation that holds, of a batch's repeats the first.

    It holds if it names a cluster of the batch and its owner, a person that the batch's names give on that platform (the bot
    on any), and a label that stands in the statement. Placeholders for names become names of the directory, or nothing.
    """
    x = told.select("batch", "items", "names", F.posexplode("relations").alias("at", "r"))
    x = x.select("batch", "at", "items", "names", F.try_variant_get("r", "$.cluster_id", "bigint").alias("cluster_id"), *[F.try_variant_get("r", f"$.{p}", "string").alias(p) for p in PARTS])
    x = x.withColumn("c", F.get(F.filter("items", lambda c: c["id"] == F.col("cluster_id")), 0))
    x = valid_relations(x).withColumn("o", F.get(F.filter("names", lambda n: n["user_id"] == F.col("object_user_id")), 0))
    x = x.filter((F.col("c.user_id") == F.col("subject_user_id")) & ((F.col("o.platform") == "") | (F.col("o.platform") == F.coalesce("c.platform", F.lit("")))) & F.contains("c.statement", "label"))
    names = known.filter("platform <> ''").groupBy("platform", "user_id").agg(F.min("key").alias("name"))
    for side in ("subject", "object"):
        own = names.select("platform", F.col("user_id").alias(f"{side}_user_id"), F.col("name").alias(f"_{side}"))
        x = x.withColumn("platform", F.coalesce("c.platform", F.lit(""))).join(own, ["platform", f"{side}_user_id"], "left")
    real = lambda side, other: F.when(is_placeholder(F.col(f"{side}_display_name")), F.coalesce(f"_{side}", other)).otherwise(F.col(f"{side}_display_name"))
    bot = F.col("subject_user_id").isin(*bots) | F.col("object_user_id").isin(*bots) if bots else F.lit(False)
    out = x.select(
        "batch", "at", F.struct("batch", "at").alias("pos"), "platform", F.col("subject_user_id").alias("subject_uid"), F.col("object_user_id").alias("object_uid"), F.col("label").alias("relation_label"),
        real("subject", F.lit("")).alias("subject_name"), real("object", F.col("o.name")).alias("object_name"), "statement", "confidence",
        F.coalesce("c.occurred_at", now).alias("occurred_at"), backfill_key(F.col("cluster_id")).alias("evidence_key"), F.lit(False).alias("count_on_conflict"), bot.alias("is_bot_edge"), F.lit(min_evidence).alias("min_evidence"),
    )
    w = Window.partitionBy("batch", "platform", "subject_uid", "object_uid", "relation_label").orderBy("at")
    return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "at")


@dataclass(frozen=True)
class Pass:
    """What one pass did: the edges after it, the watermark reached, revived clusters to take again, and its counts."""

    edges: DataFrame
    watermark: int
    again: DataFrame
    clusters: int
    batches: int
    failed: int
    written: int
    discarded: int
    more: bool


def backfill_wave(
    clusters: DataFrame, edges: DataFrame, aliases: DataFrame, ask: Callable[[DataFrame], DataFrame], now: Column, after_id: int = 0, revived: DataFrame | None = None,
    size: int = 40, count: int = 256, cap: int = 500, bots: tuple[str, ...] = (), nickname: str = "", stopwords: list[str] | None = None, min_evidence: int = 2,
    known: DataFrame | None = None, sources: DataFrame | None = None, done: int = 0,
) -> Pass:
    """One pass over the next `count` batches. ask: (batch, items, names) with names -> (batch, answer), once for all of them.

    Batches count in their order, revived ones first, up to the first that failed: that one and all behind it change nothing, the
    watermark stays before them, and revived clusters among them are to be taken again. The batches of a pass are asked
    together, so what a failure wastes is at most one pass. The first of bots is the bot's own number. known, sources and done: what a
    run has made once for all its passes, as for `batches`. A pass without relations leaves the edges as they are. Runs jobs.
    """
    bot = bots[0] if bots else ""
    known = saved(known_names(aliases, bot, nickname), "known") if known is None else known
    made = batches(clusters, known, after_id, revived, size, count, cap, bot, sources, done)
    told = saved(read(made, ask(made.filter(F.size("names") > 0).select("batch", "items", "names"))), "told")
    stop = told.filter("NOT ok").agg(F.min("batch")).first()[0]
    good = told if stop is None else told.filter(F.col("batch") < stop)
    rows = saved(rows_of(good, known, now, bots, min_evidence), "relations")
    seen = good.agg(
        F.max(F.when(F.col("batch") >= 0, F.col("last_id"))).alias("to"), F.coalesce(F.sum(F.size(F.coalesce("relations", F.array().cast("array<variant>")))), F.lit(0)).alias("told")
    ).first()
    total = made.agg(F.count("*").alias("b"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("c"), F.count_if(F.col("batch") >= 0).alias("new")).first()
    lost = told.filter((F.col("batch") < 0) & (F.col("batch") >= stop)) if stop is not None else told.limit(0)
    again = lost.select(F.explode("items.id").alias("cluster_id"))
    written = rows.count()
    return Pass(
        upserted(edges, rows.drop("batch"), now, stopwords) if written else edges.select(*UPSERTED), after_id if seen["to"] is None else seen["to"], again, total["c"], total["b"],
        0 if stop is None else 1, written, seen["told"] - written, stop is None and total["new"] == count,
    )


def backfill_run(
    clusters: DataFrame, edges: DataFrame, aliases: DataFrame, ask: Callable[[DataFrame], DataFrame], now: Column, commit: Callable[[Pass], DataFrame],
    after_id: int = 0, revived: DataFrame | None = None, size: int = 40, count: int = 256, bots: tuple[str, ...] = (), nickname: str = "", **rules: object,
) -> list[Pass]:
    """Passes until the sources end or a batch fails; full from after_id 0.

    commit stores a pass (edges, watermark, clusters to take again) and returns the stored edges: a run that is killed goes on
    from the last one stored, and a pass that is done twice changes nothing, as its evidence keys are known. Sources are put
    in order, and names looked up, once for the run. Every second pass doubles the batches of a pass: a run over many
    sources takes few passes, and one that fails has not asked more than all before it together, or `count`.
    """
    known = saved(known_names(aliases, bots[0] if bots else "", nickname), "known")
    sources, taken = ordered(clusters, after_id), 0
    done: list[Pass] = []
    while True:
        own = count << len(done) // 2
        one = backfill_wave(clusters, edges, aliases, ask, now, after_id, revived, size, own, bots=bots, nickname=nickname, known=known, sources=sources, done=taken, **rules)
        edges, after_id, revived = commit(one), one.watermark, None
        taken += size * own
        done.append(one)
        if not one.more:
            return done
