"""Mixing sources to target weights with hash-threshold histograms.

A document's place in the order of its source is a hash of its id. Tokens (words) are summed by source and the
leading bits of the hash; a running sum over those buckets tells in which bucket the source's budget ends; only
that bucket is opened by the next bits, until it holds the documents of one hash value. A document is then taken by comparing its hash
with its source's threshold: nothing is sorted, and a larger budget takes a superset.

Budgets: sources in code point order, null last, weigh 3, 1, 2, repeating. They share ``share`` of all words by
weight; a target stops at twice its source's words and the excess is shared anew, which ends at
``min(2 * words, level * weight)`` for the one level that spends the budget.

A source's line of budgets is broadcast while there are at most ``MANY`` sources; beyond that it is joined by a shuffle,
whose large partitions adaptive execution splits. Words are split once; the narrow rows that keep their number do the rest.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own; rows
with equal ids share a hash and are taken alike; very long texts are taken whole or not at all; an empty table gives an
empty result; other columns pass through ``mix`` unchanged, whatever their names. A source with no words has target 0.
``copies`` tells how often the mix holds a row: 0, 1 or 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import nullable_key, quoted, saved, words

#: The mix's size against all words, the weights in turn, and the most a source may be repeated.
SHARE, WEIGHTS, REPEAT = 1.5, (3, 1, 2), 2
#: Hash bits, and those that each histogram opens.
BITS, STEP = 40, 10
#: Sources whose budgets are broadcast at most.
MANY = 100_000


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """sizes: (_src, source, source_size), a row for each source. Adds target."""
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(float(w))).otherwise(weight)
    cap = repeat * F.col("source_size")
    weighed = sizes.withColumn("_weight", weight)
    whole = Window.partitionBy()
    before = Window.orderBy(cap / F.col("_weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    rest = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("_level", left / rest).withColumn("_open", cap / F.col("_weight") >= F.col("_level"))
    level = F.min(F.when(F.col("_open"), F.struct(cap / F.col("_weight"), F.col("_level"))))
    return levels.withColumn("_spent", level.over(whole)["_level"]).withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("_spent") * F.col("_weight"), cap.cast("double")))).select("_src", "source_size", "target")


def _hash(key: str) -> Column:
    """The first 40 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _small(lines: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(lines) if few else lines


def thresholds(rows: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """For each source: _whole copies of all its rows, and one more of each row whose _hash is below _limit."""
    state = goals.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    state = state.withColumns({"_rest": F.col("target") - F.col("_whole") * F.col("source_size"), "_prefix": F.lit(0).cast("long"), "_sum": F.lit(0).cast("long")})
    for shift in range(BITS - STEP, -1, -STEP):
        inside = rows.join(_small(state.select("_src", "_prefix"), few), "_src").filter(F.shiftright("_hash", shift + STEP) == F.col("_prefix"))
        hist = inside.groupBy("_src", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("size").alias("_n"))
        run = hist.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # the last bucket that begins within the budget holds the threshold
        met = run.join(state.select("_src", "_rest", F.col("_sum").alias("_base")), "_src").filter(F.col("_base") + F.col("_before") <= F.col("_rest"))
        best = met.groupBy("_src").agg(F.max(F.struct("_bucket", (F.col("_base") + F.col("_before")).alias("_at"), "_n")).alias("_b"))
        state = state.drop("_last").join(best, "_src", "left").select(
            "_src", "source_size", "target", "_whole", "_rest",
            F.coalesce(F.col("_b._bucket"), F.col("_prefix") * 2**STEP).alias("_prefix"), F.coalesce(F.col("_b._at"), F.col("_sum")).alias("_sum"), F.col("_b._n").alias("_last"),
        )
        state = saved(state, "thresholds")
    # the last bucket is one hash value: it is taken when that brings the sum nearer
    nearer = F.abs(F.col("_sum") + F.coalesce(F.col("_last"), F.lit(0)) - F.col("_rest")) <= F.abs(F.col("_sum") - F.col("_rest"))
    room = F.col("_whole") < REPEAT
    return state.withColumn("_limit", F.when(~room, F.lit(0)).otherwise(F.col("_prefix") + F.when(nearer, 1).otherwise(0)).cast("long"))


def budgets(df: DataFrame, key: str, source: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, limits, few): (key, _src, source, _hash, size) of each row of df; each source's line; whether the lines are few."""
    src = F.col(quoted(source))
    rows = df.select(F.col(quoted(key)).alias("key"), nullable_key(src).alias("_src"), src.alias("source"), _hash(key).alias("_hash"), F.size(words(F.col(quoted(text)))).cast("long").alias("size"))
    rows = saved(rows, "mix")
    goals = saved(targets(rows.groupBy("_src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))), "targets")
    few = goals.count() <= MANY
    return rows, thresholds(rows, goals, few).select("_src", "source_size", "target", "_whole", "_limit"), few


def _copies() -> Column:
    return F.col("_whole") + F.when(F.col("_hash") < F.col("_limit"), 1).otherwise(0)


def mixed(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, size, source_size, target, copies, taken), a row for each row of df."""
    rows, limits, few = budgets(df, key, source, text)
    out = rows.join(_small(limits, few), "_src").withColumn("copies", _copies())
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of df that the mix takes, as often as it takes them, with the columns of df."""
    _, limits, few = budgets(df, key, source, text)
    packed = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), nullable_key(F.col(quoted(source))).alias("_src"), _hash(key).alias("_hash"))
    out = packed.join(_small(limits, few), "_src").withColumn("copies", _copies()).filter("copies > 0")
    out = out.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op7_mix(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
