"""SimHash near-duplicates: exact links by vantage-point trees over shards of the Hamming space.

Fingerprints are made in Arrow batches: a shingle's XXH64 votes on 64 bits. Equal fingerprints are one node, which
takes groups of copies out of every later step. Links are found in two tiers:

* The top of a vantage-point tree is grown on a bounded sample of fingerprints. A node keeps a point and a radius;
  fingerprints within the radius go inside, the others outside. By the triangle bound, two fingerprints at up to r
  bits lie at most r apart in their distances from the point, so it is enough to send the outer ones within
  ``radius + r`` inside as well: every pair that links then meets in at least one leaf. Leaves are the shards.
* In a shard the same tree goes on, in numpy, down to small buckets that are compared outright. A part that a split
  cannot thin out is compared in blocks, so memory stays bounded and no pair is lost.

A shard returns a spanning forest of its links, not the links themselves, so a dense ball of n fingerprints gives
n - 1 edges. Components over all shards come from rounds of large-star and small-star joins, each written to the
shared folder; nothing about single documents reaches the driver.

Defined cases: null, empty and blank texts have no words and fingerprint zero, and are linked like any other;
fewer words than a shingle make one shingle; rows with equal ids each have their own fingerprint; an empty table
gives an empty result; a null doc_id gets a null component unless its fingerprint links elsewhere; very long texts are
read whole; other columns pass through ``one_of_each`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, quoted, saved, slices

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Most fingerprints that the driver sees to grow the top of the tree, and the sampled ones in a leaf at least; shards
#: are as many as hold about LEAF fingerprints each, some 4,000 at most.
LEAF = 2_000
SAMPLE, LEAF_SAMPLE = 65536, 16
#: Fingerprints of a bucket that is compared outright, and rows of a block of comparisons.
BUCKET, BLOCK = 192, 512


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of text; zero if it has no words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), seed)]
    else:
        line = b" ".join(w)
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        hashes = [h(line[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    votes = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=[key, "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


# -- the tree ---------------------------------------------------------------------------------------------------


def _cut(dist: np.ndarray, r: int) -> tuple[int, float]:
    """The radius whose larger side is smallest, and that side's share of all; inner sides hold the overlap."""
    counts = np.bincount(dist, minlength=65).cumsum()
    n = counts[-1]
    inner = counts[np.minimum(np.arange(65) + r, 64)]
    larger = np.maximum(inner, n - counts)
    m = int(np.argmin(larger))
    return m, larger[m] / n


def _point(fps: np.ndarray, rng: np.random.Generator, r: int) -> tuple[np.uint64, int, float]:
    """Of a few candidates, the vantage point that splits best."""
    best = None
    probe = fps if len(fps) <= 2048 else rng.choice(fps, 2048, replace=False)
    for p in rng.choice(fps, min(8, len(fps)), replace=False):
        for q in (p, ~p & np.uint64(0xFFFFFFFF), p ^ np.uint64(0xFFFF0000FFFF0000)):
            m, share = _cut(np.bitwise_count(probe ^ q), r)
            if best is None or share < best[2]:
                best = (np.uint64(q), m, share)
    return best


def top_tree(sample: np.ndarray, r: int = RADIUS, leaf: int = LEAF_SAMPLE) -> list[tuple[int, int, int, int]]:
    """Nodes (point, radius, inner, outer); inner and outer are node numbers, or -1 - shard. Empty: one shard."""
    nodes: list[list[int]] = []
    rng = np.random.default_rng(7)
    shards = 0

    def grow(fps: np.ndarray) -> int:
        nonlocal shards
        if len(fps) > leaf:
            point, m, share = _point(fps, rng, r)
            if share < 0.9:
                at = len(nodes)
                nodes.append([int(point), m, 0, 0])
                d = np.bitwise_count(fps ^ point)
                nodes[at][2] = grow(fps[d <= m])
                nodes[at][3] = grow(fps[d > m])
                return at
        shards += 1
        return -shards

    grow(np.unique(sample))
    return [tuple(x) for x in nodes]


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], r: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of each shard that each fingerprint belongs to."""
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
    rows, shards, todo = [], [], [(0, np.arange(len(fps)))]
    while todo:
        at, idx = todo.pop()
        if at < 0 or not len(idx):
            rows.append(idx)
            shards.append(np.full(len(idx), -1 - at if at < 0 else 0, dtype=np.int64))
            continue
        point, m, inner, outer = nodes[at]
        d = np.bitwise_count(fps[idx] ^ np.uint64(point))
        todo += [(inner, idx[d <= m + r]), (outer, idx[d > m])]
    return np.concatenate(rows), np.concatenate(shards)


class _Forest:
    """Union-find over positions; a root is the smallest position of its set."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def forest(fps: np.ndarray, r: int = RADIUS) -> np.ndarray:
    """For distinct fps, the position of the smallest member of each one's component under links of up to r bits."""
    sets = _Forest(len(fps))
    rng = np.random.default_rng(11)
    todo = [np.arange(len(fps))]
    while todo:
        idx = todo.pop()
        if len(idx) < 2:
            continue
        own = fps[idx]
        if len(idx) > BUCKET:
            point, m, share = _point(own, rng, r)
            if share < 0.9:
                d = np.bitwise_count(own ^ point)
                todo += [idx[d <= m + r], idx[d > m]]
                continue
        for a in range(0, len(idx), BLOCK):
            for b in range(a, len(idx), BLOCK):
                x, y = np.nonzero(np.bitwise_count(own[a : a + BLOCK, None] ^ own[None, b : b + BLOCK]) <= r)
                keep = x + a < y + b
                x, y = idx[x[keep] + a], idx[y[keep] + b]
                if len(x):  # within a block, only pairs whose sets still differ go on
                    open_ = sets.up[x] != sets.up[y]
                    sets.join(x[open_], y[open_])
    return np.array([sets.find(i) for i in range(len(fps))], dtype=np.int64) if len(fps) else np.zeros(0, np.int64)


def edges(nodes: DataFrame, r: int = RADIUS) -> DataFrame:
    """nodes: distinct (fp). (a, b), a < b: a spanning forest of the links of each shard."""
    spark = nodes.sparkSession
    n = max(1, nodes.count())
    seen = nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE * 0.9 / n) * (1 << 20)) + 1)).limit(2 * SAMPLE)
    sample = np.array([x["fp"] for x in seen.collect()], dtype=np.int64).view(np.uint64)  # a bounded sample, for the shape of the tree alone
    tree = spark.sparkContext.broadcast(top_tree(sample, r, max(LEAF_SAMPLE, int(len(sample) * LEAF / n))))  # at most SAMPLE / LEAF_SAMPLE nodes of four numbers

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, shards = route(fps, tree.value, r)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(fps[rows].view(np.int64))], names=["shard", "fp"])

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(pdf["fp"].to_numpy()).astype(np.int64)
        root = fps[forest(fps.view(np.uint64), r)]
        own = root != fps
        return pd.DataFrame({"a": root[own], "b": fps[own]})

    return nodes.mapInArrow(placed, "shard bigint, fp bigint").groupBy("shard").applyInPandas(linked, "a bigint, b bigint").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: (a, b). (node, root): the smallest node of each component with a link, by alternating star rounds."""
    e = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u2"), F.col("m").alias("v2")).filter("u2 <> v2")
        after = saved(small.select(F.col("u2").alias("u"), F.col("v2").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        settled = after.count() == e.count() and after.join(e, ["u", "v"], "left_anti").isEmpty()  # equal sets
        drop(e)
        e = after
        if settled:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, r: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) of each row of df; component_id is the smallest key reachable."""
    made = saved(fingerprints(df, key, text, shingle), "fps")
    nodes = saved(made.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(edges(nodes.select("fp"), r))
    return _named(made, nodes, roots).select(key, "fp", "component_id")


# -- near copies beyond the radius --------------------------------------------------------------------------------

#: Words of a shingle and least Jaccard similarity of near copies; sketches of a document and shingles in each.
WORDS, SIMILAR, SKETCHES, MEMBERS = 5, 0.8, 12, 3
#: Texts and words of a block of a sketch group, and shingles counted at once.
MEET, WEIGHT, COLUMNS = 192, 1 << 20, 4096
_TURN = np.random.default_rng(23).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of the n-word shingles of text."""
    w = (text or "").encode().lower().split()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(w[i : i + n])) for i in range(max(1, len(w) - n + 1))] if w else [], dtype=np.uint64))


def sketches(text: str | None) -> np.ndarray:
    """SimHash fingerprints, each of the MEMBERS shingles that come first in an order of its own.

    Two texts of similarity s agree in one of them with a chance of about s ** MEMBERS, however long they are.
    """
    own = shingles(text)
    if not len(own):
        return np.zeros(0, dtype=np.int64)
    turned = own[None, :] * _TURN[:, None]
    turned ^= turned >> np.uint64(32)
    turned *= np.uint64(0x9E3779B97F4A7C15)
    m = min(MEMBERS, len(own))
    first = np.take_along_axis(turned, np.argpartition(turned, m - 1, axis=1)[:, :m], axis=1)
    bits = np.unpackbits(first.view(np.uint8).reshape(SKETCHES, m, 8), axis=2, bitorder="little").sum(axis=1) * 2 > m
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def sketched(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp, sk, size): the fingerprint, the sketches and the number of words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                texts = b.column(1).to_pylist()
                fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array([sketches(t) for t in texts], pa.list_(pa.int64())), pa.array([len((t or "").split()) for t in texts], pa.int64())], names=[key, "fp", "sk", "size"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp bigint, sk array<bigint>, size bigint")


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """pairs: (a, b, ta, tb). (a, b) of those whose texts' shingles have a Jaccard similarity of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                keep = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    one, two = shingles(x), shingles(y)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(both >= least * (len(one) + len(two) - both) and both > 0)
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _joined(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """A forest of the links among the texts of one group; pdf: (fp, comp, t). Pairs of one component are skipped."""
    own = [shingles(t) for t in pdf["t"]]
    size = np.array([len(x) for x in own])
    tokens, place = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(len(own)), size)
    often = np.bincount(place, minlength=len(tokens)) > 1  # the others are in no intersection
    place, row = (np.cumsum(often) - 1)[place[often[place]]], row[often[place]]
    by = np.argsort(place, kind="stable")
    place, row = place[by], row[by]
    both = np.zeros((len(own), len(own)))
    for at in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + COLUMNS])
        part = np.zeros((len(own), COLUMNS), dtype=np.float32)
        part[row[lo:hi], place[lo:hi] - at] = 1
        both += part @ part.T
    comp = pdf["comp"].to_numpy()
    x, y = np.nonzero(np.triu((both > 0) & (both >= least * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :]), 1))
    places = np.unique(comp, return_inverse=True)[1]
    sets, keep = _Forest(len(places)), []
    for i, j in zip(x.tolist(), y.tolist()):
        one, two = sets.find(places[i]), sets.find(places[j])
        if one != two:
            sets.up[max(one, two)] = min(one, two)
            keep.append((i, j))
    fp = pdf["fp"].to_numpy()
    return pd.DataFrame({"a": [min(fp[i], fp[j]) for i, j in keep], "b": [max(fp[i], fp[j]) for i, j in keep]}, dtype="int64")


def _groups(members: DataFrame, block: int) -> DataFrame:
    """(g, fp): groups of bounded size in which every two members of a sketch group and of different components meet.

    members: (_t, _s, fp, size, comp). In a sketch group, a component of `block` members or more is a part of its own
    and the others make one mixed part; parts are dealt into blocks, and every two blocks are a group, but for those
    of one component.
    """
    at = ["_t", "_s"]
    per = members.groupBy(*at, "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    per = per.withColumn("part", F.when((F.col("n") >= block) | (F.col("w") >= WEIGHT), F.col("comp")))
    parts = per.groupBy(*at, "part").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sum("w") / WEIGHT)).alias("k"), F.count("*").alias("c"))
    dealt = parts.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("part", "k"))).alias("parts"), F.sum("c").alias("c")).filter("c > 1").drop("c")
    own = members.join(per.select(*at, "comp", "part"), [*at, "comp"]).join(dealt, at)
    own = own.withColumn("me", F.expr("filter(parts, x -> x.part <=> part)[0]"))
    own = own.withColumn("off", F.expr("aggregate(parts, 0L, (s, x) -> s + IF(part IS NOT NULL AND (x.part IS NULL OR x.part < part), x.k, 0L))"))
    own = own.withColumn("i", F.expr("off + pmod(xxhash64(fp), me.k)")).withColumn("all", F.expr("aggregate(parts, 0L, (s, x) -> s + x.k)"))
    others = F.expr("filter(sequence(0L, all - 1), j -> all = 1 OR (j <> i AND (part IS NULL OR j < off OR j >= off + me.k)))")
    met = own.select(*at, "fp", "i", F.explode(others).alias("j")).groupBy(*at, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    same = met.agg(F.sort_array(F.collect_set("fp")).alias("fps")).select("fps").distinct()  # sketches often group the same texts
    return same.select(F.xxhash64("fps").alias("g"), F.explode("fps").alias("fp"))


def near_links(df: DataFrame, made: DataFrame, nodes: DataFrame, key: str, text: str, least: float = SIMILAR, known: DataFrame | None = None, block: int = MEET) -> DataFrame:
    """(a, b): links of which follow those of all texts that share a sketch and are verified.

    made: (key, fp, sk, size), nodes: (fp, least), known: links (a, b) found elsewhere. First every text is held
    against three members of each of its sketch groups: the outermost two and the one that shares most sketches with
    others, which in a group of edited copies is their original. What that leaves in more than one component is then
    compared completely, in blocks; only pairs of one component are left out, as their link adds nothing.
    """
    at = ["_t", "_s"]
    chosen = made.join(nodes, "fp").filter(F.col(key) == F.col("least"))
    by_sketch = saved(chosen.select("fp", "size", F.posexplode("sk").alias("_t", "_s")).distinct(), "by_sketch")
    met = by_sketch.join(by_sketch.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1"), at)
    central = met.groupBy("fp").agg(F.sum("n").alias("c"))
    met = saved(met.join(central, "fp"), "met")
    ends = met.groupBy(*at).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max(F.struct("c", "fp"))["fp"].alias("mid"))
    pairs = met.join(ends, at).select("fp", F.explode(F.array("lo", "hi", "mid")).alias("p")).filter("fp <> p")
    pairs = saved(pairs.select(F.least("fp", "p").alias("a"), F.greatest("fp", "p").alias("b")).distinct(), "pairs")
    asked = met.select("fp").distinct().join(nodes, "fp")
    texts = saved(df.select(F.col(key).alias("least"), F.col(text).alias("t")).join(asked, "least").select("fp", "t").dropDuplicates(["fp"]), "texts")
    with_a = pairs.join(texts.select(F.col("fp").alias("a"), F.col("t").alias("ta")), "a")
    first = saved(_verified(with_a.join(texts.select(F.col("fp").alias("b"), F.col("t").alias("tb")), "b"), least).distinct(), "near")
    roots = components(first if known is None else first.unionByName(known))
    # all pairs of a group of up to three have been compared
    left = met.filter("n > 3").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(*at, "fp", "size", F.coalesce("root", "fp").alias("comp"))
    groups = saved(_groups(saved(left, "left"), block), "groups")
    rest = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(texts, "fp").select("g", "fp", F.coalesce("root", "fp").alias("comp"), "t")
    more = rest.groupBy("g").applyInPandas(lambda pdf: _joined(pdf, least), "a bigint, b bigint")
    return first.unionByName(more).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", r: int = RADIUS, least: float = SIMILAR) -> DataFrame:
    """(key, component_id): groups under links of up to r bits or of a shingle similarity of at least `least`."""
    made = saved(sketched(df, key, text), "sketched")
    nodes = saved(made.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    close = saved(edges(nodes.select("fp"), r), "close")
    links = close.unionByName(near_links(df, made, nodes, key, text, least, close))
    return _named(made.select(key, "fp"), nodes, components(links))


def _named(made: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    label = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    label = saved(label, "labels")
    lowest = label.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.join(label.join(lowest, "root").select("fp", "component_id"), "fp")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows whose group holds a smaller key; of repeated rows with that key, one stays; null keys stay."""
    named = saved(near_duplicates(df.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t")), "k", "t"), "groups")
    keep = named.filter(F.col("k") == F.col("component_id")).groupBy("k").agg(F.count("*").alias("n"))
    packed = df.select(F.col(quoted(key)).alias("k"), F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"))
    marked = packed.join(keep, "k")
    out = marked.filter("n = 1").select("row").unionByName(marked.filter("n > 1").groupBy("k").agg(F.first("row").alias("row")).select("row"))
    out = out.unionByName(packed.filter(F.col("k").isNull()).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op6_neardup(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
