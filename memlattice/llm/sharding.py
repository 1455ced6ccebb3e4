"""K-d tree sharding: split at weighted medians along the widest metadata dimension. DataFrame functions only.

Every document has a place in three metadata dimensions: the logarithm of its number of lines, that of its size, and
a hash of its text. All three follow from the text alone, so equal texts meet in one cell of a fixed grid
(16 x 64 x 1024) and stay together. The grid is summed once, with map-side combination; the tree is then grown on the
sums alone, a level at a time: each node takes its widest dimension and is cut where the running sum of bytes comes
nearest to the share of the leaves on its left, until each leaf is left with the target, the bytes of one shard. The
cuts, one for each inner node, become one CASE expression over the rows, so no row is joined or sorted to find its shard.
Only a text whose copies together outweigh a small part of a shard is dealt into up to 256 chunks, by the hash of
the documents' ids, before the tree is grown; all other groups of equal texts stay whole.

Defined cases: a null text counts as empty, with no bytes and the crc32 of the empty text; repeated rows are placed
alike; very long texts count with all their bytes and are never cut; an empty table gives an empty result; fewer distinct
cells than shards leave some shards empty; other columns are not read. Slots are numbered within (shard, id hash)
buckets and shifted by the sizes of the buckets before, so no task needs a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARDS, LINES, SIZES, HASHES, CHUNKS = 40, 16, 64, 1024, 256
#: Copies of one text that outweigh 1/HEAVY of a shard are dealt into chunks. At most SHARDS * HEAVY texts can be that heavy.
HEAVY = 8
#: Buckets of a shard for numbering its slots.
SUBS = 64
#: Order of the packed fields for a cut along each dimension; equal texts stay neighbours in each.
_FIELDS = {"l": LINES, "z": SIZES, "h": HASHES, "c": CHUNKS}
_ORDERS = {"l": "lhzc", "z": "zhlc", "h": "hzlc"}


def with_cells(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, th, l, z, h): a hash of the text, and the coordinates of the document's cell."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(t).cast("long") + 16
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return df.select(
        F.col(key).alias("key"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("th"),
        F.least(F.lit(LINES - 1), F.floor(F.log2(lines.cast("double")))).cast("long").alias("l"),
        F.least(F.lit(SIZES - 1), F.floor(F.log2(size.cast("double")) * 2)).cast("long").alias("z"),
        F.pmod(F.xxhash64(t), F.lit(HASHES)).cast("long").alias("h"),
    )


def _packed(dim: str) -> Column:
    out: Column = F.lit(0).cast("long")
    for f in _ORDERS[dim]:
        out = out * _FIELDS[f] + F.col(f)
    return out


def _chunk(heavy: Column) -> Column:
    return F.when(heavy, F.pmod(F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), F.lit(CHUNKS))).otherwise(F.lit(0)).cast("long")


def grow(cells: DataFrame, shards: int = SHARDS) -> Column:
    """The leaf of each (l, z, h, c), as a Column; cells: those with their bytes, a bounded table.

    Each level is one job over the cells; the driver gets one cut for each inner node, shards - 1 in all.
    """
    leaves = {1: (0, shards)}
    done: dict[int, Column] = {}
    cuts: dict[int, Column] = {}
    while leaves:
        for node in [n for n, (a, b) in leaves.items() if b - a == 1]:
            done[node] = F.lit(leaves.pop(node)[0])
        if not leaves:
            break
        node = F.lit(None).cast("long")
        for n in leaves:
            path = F.lit(True)
            m = n
            while m > 1:
                path = path & (cuts[m // 2] if m % 2 == 0 else ~cuts[m // 2])
                m //= 2
            node = F.when(path, F.lit(n).cast("long")).otherwise(node)
        at = cells.withColumn("node", node).filter("node IS NOT NULL")
        by = Window.partitionBy("node")
        spans = at.groupBy("node").agg(*[((F.max(d) - F.min(d) + 1) / F.lit(_FIELDS[d])).alias(f"w{d}") for d in "lzh"], F.sum("bytes").alias("total"))
        spans = spans.select("node", "total", F.when((F.col("wl") >= F.col("wz")) & (F.col("wl") >= F.col("wh")), "l").when(F.col("wz") >= F.col("wh"), "z").otherwise("h").alias("dim"))
        share = F.lit(None).cast("double")
        for n, (a, b) in leaves.items():
            share = F.when(F.col("node") == n, F.lit((b - a) // 2 / (b - a))).otherwise(share)
        key = F.when(F.col("dim") == "l", _packed("l")).when(F.col("dim") == "z", _packed("z")).otherwise(_packed("h"))
        ran = at.join(F.broadcast(spans), "node").withColumn("key", key)  # spans: at most `shards` rows
        ran = ran.withColumn("run", F.sum("bytes").over(by.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
        best = ran.groupBy("node").agg(F.min_by(F.struct("dim", "key"), F.struct(F.abs(F.col("run") - share * F.col("total")), F.col("key"))).alias("cut"))
        found = {r["node"]: r["cut"] for r in best.collect()}
        for n, (a, b) in list(leaves.items()):
            del leaves[n]
            mid = a + (b - a) // 2
            cuts[n] = _packed(found[n]["dim"]) <= F.lit(found[n]["key"]) if n in found else F.lit(True)
            leaves[2 * n], leaves[2 * n + 1] = (a, mid), (mid, b)

    def leaf(n: int) -> Column:
        return done[n] if n in done else F.when(cuts[n], leaf(2 * n)).otherwise(leaf(2 * n + 1))

    return leaf(1).cast("int")


def sharded(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of each row of df."""
    base = saved(with_cells(df, key, text), "cells")
    whole = base.agg(F.sum("size").alias("all"))
    groups = base.groupBy("th").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    heavy = groups.filter("n > 1").crossJoin(F.broadcast(whole)).filter(F.col("bytes") * shards * HEAVY > F.col("all"))  # whole: one row
    texts = [r["th"] for r in heavy.select("th").collect()]  # at most shards * HEAVY
    rows = base.withColumn("c", _chunk(F.col("th").isin(texts) if texts else F.lit(False)))
    cells = saved(rows.groupBy("l", "z", "h", "c").agg(F.sum("size").alias("bytes")), "grid")
    out = rows.withColumn("shard", grow(cells, shards)).select("key", "size", "text_crc32", "shard")
    return slotted(out).withColumnRenamed("key", key)


def slotted(df: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 within shard; df: (key, size, text_crc32, shard)."""
    df = df.withColumn("sub", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(SUBS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    start = df.groupBy("shard", "sub").agg(F.count("*").alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = Window.partitionBy("shard", "sub").orderBy("key", "text_crc32", "size")
    numbered = df.withColumn("at", F.row_number().over(within) - 1)
    # start: shards * SUBS rows
    out = numbered.join(F.broadcast(start), ["shard", "sub"]).withColumn("slot", (F.col("from") + F.col("at")).cast("long"))
    return out.select("key", "size", "text_crc32", "shard", "slot")


def op3_shards(docs: DataFrame) -> DataFrame:
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
