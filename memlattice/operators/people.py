"""Aliases and profiles: names of people, resolution in text, profile sections and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cleaned_alias, is_placeholder, normalize_alias, normalized_alias, uid_codes, variants
from .names import found

OWNER = ["platform", "user_id"]


def alias_rows(seen: DataFrame, source: str, cap: int = 8) -> DataFrame:
    """Observations (platform, uid, name, last_seen) -> the latest of each variant, the `cap` latest per owner (at least one)."""
    ok = seen.filter((F.coalesce("platform", F.lit("")) != "") & (F.coalesce("uid", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    rows = ok.select("platform", F.col("uid").alias("user_id"), F.explode(variants("name")).alias("name"), "last_seen")
    latest = rows.groupBy("platform", "user_id", "name").agg(F.max("last_seen").alias("last_seen"))
    w = Window.partitionBy(*OWNER).orderBy(F.desc("last_seen"), "name")
    return latest.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(cap, 1)).drop("rn").withColumn("source", F.lit(source))


def fact_code_aliases(facts: DataFrame, source: str = "fact") -> DataFrame:
    """Statements (platform, statement, last_seen, id) -> the names that they give to user numbers; the first spelling of each, last seen latest."""
    raw = facts.select("platform", "id", "last_seen", F.posexplode(uid_codes(F.col("statement"))).alias("pos", "p"))
    named = raw.select("platform", "id", "pos", "last_seen", normalized_alias("p.uid").alias("user_id"), cleaned_alias("p.code").alias("name")).filter("name <> ''").filter(~is_placeholder(F.col("name")))
    keyed = named.withColumn("key", normalized_alias("name"))
    return keyed.groupBy(*OWNER, "key").agg(F.min_by("name", F.struct("id", "pos")).alias("name"), F.max("last_seen").alias("last_seen")).drop("key").withColumn("source", F.lit(source))


def alias_upsert(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """The later last_seen wins; the source changes only when strictly later."""
    new = rows.groupBy(*OWNER, "name").agg(F.max(F.struct("last_seen", "source")).alias("n"))
    j = aliases.join(new, [*OWNER, "name"], "full_outer")
    later = F.col("last_seen").isNull() | F.coalesce(F.col("n.last_seen") > F.col("last_seen"), F.lit(False))
    return j.select(
        "id", *OWNER, "name", F.coalesce("first_seen", "n.last_seen").alias("first_seen"), F.greatest("last_seen", "n.last_seen").alias("last_seen"), F.when(later, F.coalesce("n.source", "source")).otherwise(F.col("source")).alias("source"),
    )


def names_by_owner(aliases: DataFrame, owners: DataFrame) -> DataFrame:
    """(platform, user_id, name): the latest real name of each owner asked for."""
    w = Window.partitionBy(*OWNER).orderBy(F.desc("last_seen"), "name")
    return aliases.join(owners.distinct(), OWNER).filter(~is_placeholder(F.col("name"))).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(*OWNER, "name")


def variants_of(aliases: DataFrame, platforms: list[str], uids: list[str]) -> DataFrame:
    """(platform, user_id, names): names latest first, for every platform with every uid."""
    own = aliases.filter(F.col("platform").isin(*platforms) & F.col("user_id").isin(*uids))
    return own.groupBy(*OWNER).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("t"), "name"))), lambda x: x["name"]).alias("names"))


def _spelled(aliases: DataFrame, min_chars: int, stopwords: tuple[str, ...]) -> DataFrame:
    """(key, platform, user_id, name): a person's names by their normalised form, the latest spelling of each."""
    at = F.col("last_seen") if "last_seen" in aliases.columns else F.lit(None).cast("timestamp")
    names = aliases.select(*OWNER, "name", at.alias("at"), normalized_alias("name").alias("key")).filter(F.length("key") >= min_chars)
    if stopwords:
        names = names.filter(~F.col("key").isin(*map(normalize_alias, stopwords)))
    return names.groupBy("key", *OWNER).agg(F.max(F.struct("at", "name"))["name"].alias("name"))


def matched(texts: DataFrame, aliases: DataFrame, window: DataFrame | None = None, cap: int = 4, min_chars: int = 2, gram: int = 2, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, platform, user_id, name): people named in a text, longest names first, at most `cap`.

    A name of several people counts only for those that the session window (platform, user_id) backs. Every row of texts is
    read once by an automaton of the names; texts are shuffled only where the names are too many to be sent to them.
    """
    names = _spelled(aliases, min_chars, stopwords)
    clear = names.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(*OWNER, "name")).alias("p")).filter("n = 1").select("key", "p.*")
    if window is not None:
        clear = clear.unionByName(names.join(window.select(*OWNER), OWNER, "left_semi")).distinct()
    return found(texts, clear, True, gram, cap, tuple(OWNER)).select("text_id", *OWNER, "name")


def skipped(texts: DataFrame, aliases: DataFrame, window: DataFrame | None = None, min_chars: int = 2, gram: int = 2, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, name): names of several people, none backed by the window, that a text holds and `matched` passes over."""
    names = _spelled(aliases, min_chars, stopwords)
    vague = names.groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("name")).filter("n > 1").drop("n")
    if window is not None:
        vague = vague.join(names.join(window.select(*OWNER), OWNER, "left_semi"), "key", "left_anti")
    return found(texts, vague, True, gram).select("text_id", "name")


def resolved(aliases: DataFrame, name: str | Column) -> DataFrame:
    """(platform, user_id) that a tool's argument names: one row, or none if the name is unknown or means several."""
    own = aliases.filter(normalized_alias("name") == normalized_alias(F.lit(name) if isinstance(name, str) else name)).select(*OWNER).distinct()
    n = own.agg(F.count("*").alias("_n"))  # one row
    return own.crossJoin(F.broadcast(n)).filter("_n = 1").drop("_n")


def with_window(directory: DataFrame, window: DataFrame, cap: int = 4) -> DataFrame:
    """(text_id, platform, user_id, name): people matched by the session window and by the directory, the window's first, at most cap.

    Both: (text_id, platform, user_id, name). A person counts once, under the name of the window.
    """
    both = window.withColumn("src", F.lit(0)).unionByName(directory.withColumn("src", F.lit(1)))
    one = both.groupBy("text_id", *OWNER).agg(F.min(F.struct("src", (-F.length("name")).alias("long"), "name")).alias("m"))
    w = Window.partitionBy("text_id").orderBy("m", *OWNER)
    return one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).select("text_id", *OWNER, "m.name")


def sections(profiles: DataFrame, clusters: DataFrame, limit: int = 5) -> DataFrame:
    """Profile rows by user and category, at most `limit` each: recent ones latest first, others by score."""
    j = profiles.join(clusters.select(F.col("id").alias("cluster_id"), "occurred_at"), "cluster_id", "left")
    recent = F.when(F.col("category") == "recent", F.col("occurred_at"))
    w = Window.partitionBy(*OWNER, "category").orderBy(recent.desc_nulls_last(), F.desc("score"), F.desc("updated_at"), "id")
    return j.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def sections_multi(profiles: DataFrame, clusters: DataFrame, owners: DataFrame, limit: int = 5) -> DataFrame:
    """As sections, over all accounts of one person: equal statements become one row before the limit, ranked by their highest score."""
    j = profiles.join(owners.distinct(), OWNER).join(clusters.select(F.col("id").alias("cluster_id"), "occurred_at"), "cluster_id", "left")
    same = Window.partitionBy("category", "statement")
    pick = same.orderBy(F.col("occurred_at").desc_nulls_last(), F.desc("score"), F.desc("updated_at"), "id")
    one = j.withColumn("top", F.max("score").over(same)).withColumn("rn", F.row_number().over(pick)).filter("rn = 1")
    recent = F.when(F.col("category") == "recent", F.col("occurred_at"))
    w = Window.partitionBy("category").orderBy(recent.desc_nulls_last(), F.desc("top"), F.desc("updated_at"), "id")
    return one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def uncertain(clusters: DataFrame, owners: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Statements that wait or were replaced, latest first. Over several accounts repeats go after the limit, so fewer may stay."""
    rows = clusters.filter("status IN ('pending_uncertain', 'replaced')")
    order = [F.desc("occurred_at"), F.desc("score"), F.desc("updated_at"), F.col("id")]
    if owners is None:
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*OWNER).orderBy(*order))).filter(F.col("rn") <= limit).drop("rn")
    return rows.join(owners.distinct(), OWNER).orderBy(*order).limit(limit).dropDuplicates(["canonical_statement"])


def latest_names(facts: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(platform, user_id, display_name): the latest non-empty one, of the owners (platform, user_id) asked for."""
    if owners is not None:
        facts = facts.join(owners.distinct(), OWNER)
    return facts.filter(F.coalesce("display_name", F.lit("")) != "").groupBy(*OWNER).agg(F.max_by("display_name", F.struct("occurred_at", "id")).alias("display_name"))


#: Profile sections in the order they are shown.
SECTIONS = ("identity", "naming", "stable", "preference", "interaction", "commitment", "recent")


def profile_text(rows: DataFrame, names: DataFrame, waiting: DataFrame, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """(platform, user_id, text): sections in order, aliases after identity, uncertain statements last, without blacklisted lines."""
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("category")).cast("int") * 10
    lines = rows.filter(F.col("category").isin(*SECTIONS)).select(*OWNER, rank.alias("o"), "rn", F.concat(F.lit("- "), "statement").alias("line"), F.col("category").alias("head"))
    lines = lines.unionByName(names.select(*OWNER, F.lit(15).alias("o"), F.lit(1).alias("rn"), F.concat(F.lit("- "), "name").alias("line"), F.lit("alias").alias("head")))
    lines = lines.unionByName(waiting.select(*OWNER, F.lit(99).alias("o"), F.row_number().over(Window.partitionBy(*OWNER).orderBy(F.desc("occurred_at"), "id")).alias("rn"), F.concat(F.lit("- "), "canonical_statement").alias("line"), F.lit("uncertain").alias("head")))
    for word in blacklist:
        lines = lines.filter(~F.contains(F.col("line"), F.lit(word)))
    by = lines.groupBy(*OWNER, "o", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]).alias("ls"))
    part = F.concat(F.lit("## "), F.col("head"), F.lit("\n"), F.array_join("ls", "\n"))
    return by.groupBy(*OWNER).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
