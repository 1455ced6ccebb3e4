"""Hard-negative mining by a pivot table.

Vectors of integers are augmented by one component that gives all of them one length, which turns the inner product with
an anchor (augmented by zero) into a Euclidean distance: score = (|a|^2 + M - d^2) / 2, M the greatest squared length. The
distances of every row to a few pivots are stored. By the triangle inequality an anchor's own distances to the pivots
then bracket each of its scores from below and above, first for a whole block of neighbouring rows, then row by row; only rows
whose bracket can still hold an answer are scored, exactly, in integers. Pivots come from a bounded sample; whichever they are,
results are exact.

Rows lie in blocks, sorted by label, nearest pivot and distance to it, so a block has few labels and narrow distances; ties go by
id, so equal vectors fill as many blocks as they need. Anchors are packed likewise. Blocks are dealt to ``groups`` and anchors
to ``chunks``; each (group, chunk) is one cogrouped task whose two sides are bounded by GROUP_ROWS and CHUNK_ROWS. For
positives a chunk is sent only to groups that hold one of its labels. What tasks find, at most k rows an anchor, is merged.

Defined cases: rows with a null id, label or vector, or with any null or non-finite component, take no part; an id names one
row: of rows with equal ids the least by (label, vector) counts, so repeated rows count once; vectors of different lengths
are compared as if the shorter ones ended in zeros; a component whose integer lies beyond +-2^28 counts as that bound (for
over 64 components 2^31 over the root of their number), so that every score fits a long; an anchor without another row of
its label has no positives, and one without a row in a positive's window no negatives: neither gives rows; an empty table gives
an empty result. Columns other than id, label and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: The contract's numbers: scale, every which row is an anchor, positives, negatives, and the window in percent.
SCALE, ANCHOR, RELABEL, LABELS, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 7, 10, 5, 3, 50, 95
#: Pivots, and rows of the sample they come from.
PIVOTS, SAMPLE = 12, 2000
#: Rows of a block, of all blocks of a task, and anchors of a task.
BLOCK_ROWS, GROUP_ROWS, CHUNK_ROWS = 256, 8192, 8192
#: Anchors that are bracketed together.
TILE = 64


def prepared(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(id, label, v): the rows that take part, once for each id, with integer components."""
    x = F.col(vector)
    label = F.col(label) if isinstance(label, str) else label
    number = lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))
    most = F.least(F.lit(float(1 << 28)), F.floor(F.lit(float(1 << 31)) / F.sqrt(F.greatest(F.size(x), F.lit(1)))))
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = rows.filter(F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull()).filter(finite)
    put = clean.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.greatest(F.least(number(c).cast("double"), most), -most).cast("int")).alias("v"))
    return put.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows of float64, zeros behind the shorter ones."""
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products as int64; most: the greatest squared length."""
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Space:
    """What all tasks share: dimensions, the greatest squared length, the pivots with their added component."""

    dims: int
    most: float
    pivots: np.ndarray
    added: np.ndarray

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (v * v).sum(axis=1), 0))

    def distances(self, v: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Of rows to pivots, in the augmented space."""
        squares = (v * v).sum(axis=1) + added**2
        own = (self.pivots * self.pivots).sum(axis=1) + self.added**2
        d = squares[:, None] + own - 2 * (v @ self.pivots.T + np.outer(added, self.added))
        return np.sqrt(np.maximum(d, 0))

    @property
    def slack(self) -> float:
        """More than rounding can add to a distance."""
        return 1e-6 * np.sqrt(self.most) + 1e-6


def space(rows: DataFrame) -> Space | None:
    """Fits the space: two numbers over all rows, and pivots far from each other out of a sample of SAMPLE rows at most."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    top = rows.agg(F.max(F.size("v")).alias("dims"), F.max(square).alias("most")).first()
    if top["dims"] is None:
        return None
    some = rows.select("v", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    v = matrix(some["v"], top["dims"])
    s = Space(top["dims"], top["most"], v[:0], np.zeros(0))
    added = s.lift(v)
    whole = np.column_stack([v, added])
    chosen, near = [0], np.full(len(v), np.inf)
    while len(chosen) < min(PIVOTS, len(v)):
        near = np.minimum(near, ((whole - whole[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    s.pivots, s.added = v[chosen], added[chosen]
    return s


def measured(rows: DataFrame, s: Space, anchors: bool) -> DataFrame:
    """rows with their distances to the pivots, the nearest one (cell) and the distance to it; an anchor's added component is zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = matrix(f["v"], s.dims)
            d = s.distances(v, np.zeros(len(v)) if anchors else s.lift(v))
            yield pd.DataFrame({"id": f["id"], "label": f["label"], "v": [x.tobytes() for x in v.astype(np.int32)], "d": [x.tobytes() for x in d], "cell": d.argmin(axis=1).astype(np.int32), "near": d.min(axis=1)})

    return rows.select("id", "label", "v").mapInPandas(run, "id long, label long, v binary, d binary, cell int, near double")


ORDER = ["label", "cell", "near", "id"]


class Rows:
    """Rows as arrays, in the order of their labels, cells and distances."""

    def __init__(self, frame: pd.DataFrame, s: Space) -> None:
        f = frame.sort_values(ORDER)
        self.id, self.label = f["id"].to_numpy(np.int64), f["label"].to_numpy(np.int64)
        self.v = np.frombuffer(b"".join(f["v"]), dtype=np.int32).reshape(len(f), s.dims).astype(np.float64)
        self.d = np.frombuffer(b"".join(f["d"]), dtype=np.float64).reshape(len(f), len(s.pivots))
        self.square = (self.v * self.v).sum(axis=1)
        self.scores = [np.array(x, dtype=np.int64) for x in f["scores"]] if "scores" in f else []


def brackets(s: Space, square: np.ndarray, da: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score of each anchor with what lies between the distances low and high to each pivot."""
    near = np.zeros((len(da), len(low)))
    far = np.full((len(da), len(low)), np.inf)
    for j in range(da.shape[1]):
        a = da[:, j, None]
        np.maximum(near, low[:, j] - a, out=near)
        np.maximum(near, a - high[:, j], out=near)
        np.minimum(far, a + high[:, j], out=far)
    near = np.maximum(near - s.slack, 0)
    far += s.slack
    most = (square[:, None] + s.most) / 2
    margin = 1 + 1e-9 * s.most
    return most - far * far / 2 - margin, most - near * near / 2 + margin


class Best:
    """The k best (score, id) of each of several lists: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """What a score must reach to come in."""
        return self.score[:, -1]

    def put(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: one row for each list of `which`, NONE where a candidate does not count; ids: one for each column."""
        s = np.concatenate([self.score[which], score], axis=1)
        i = np.concatenate([self.id[which], np.where(score == NONE, np.iinfo(np.int64).max, ids)], axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.score.shape[1]]  # ~s falls as s rises, without an overflow
        self.score[which], self.id[which] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


NONE = np.iinfo(np.int64).min


def percent(score: np.ndarray, p: int, up: bool) -> np.ndarray:
    """p hundredths of score, rounded up or down, without an overflow."""
    q, r = np.divmod(score, 100)
    return p * q + (-(-p * r // 100) if up else p * r // 100)


@dataclass
class Work:
    """What was done: pairs of blocks with anchors' tiles, rows bracketed, pairs scored exactly."""

    blocks: int = 0
    bracketed: int = 0
    scored: int = 0


def searched(s: Space, anchors: Rows, rows: Rows, k: int, same: bool, work: Work | None = None) -> Iterator[tuple[np.ndarray, Best]]:
    """(anchors of a tile, the best of each of their windows): rows of the anchor's label without a window, or others within
    the windows of its positives' scores."""
    work = work or Work()
    starts = np.arange(0, len(rows.id), BLOCK_ROWS)
    low, high = np.minimum.reduceat(rows.d, starts), np.maximum.reduceat(rows.d, starts)
    first, last = rows.label[starts], rows.label[np.append(starts[1:], len(rows.id)) - 1]
    windows = 1 if same else POSITIVES
    for at in range(0, len(anchors.id), TILE):
        tile = np.arange(at, min(at + TILE, len(anchors.id)))
        label, n = anchors.label[tile], len(tile)
        best = Best(n * windows, k)
        floor, ceiling = np.full((n, windows), NONE), np.full((n, windows), np.iinfo(np.int64).max)
        if not same:
            floor[:], ceiling[:] = -NONE - 1, NONE  # no such positive: an empty window
            for i, t in enumerate(tile):
                x = anchors.scores[t]
                floor[i, : len(x)], ceiling[i, : len(x)] = percent(x, LOW, True), percent(x, HIGH, False)
        top = ceiling.max(axis=1)
        lo, hi = brackets(s, anchors.square[tile], anchors.d[tile], low, high)
        may = (first <= label[:, None]) & (label[:, None] <= last) if same else ~((first == label[:, None]) & (label[:, None] == last))
        own = np.where(may, hi, -np.inf)
        seeds = own.argmax(axis=1)  # every anchor's most promising block comes first, so that the others meet a high bar
        for b, seed in [*((b, True) for b in np.unique(seeds)), *((b, False) for b in np.argsort(-own.max(axis=0), kind="stable"))]:
            need = np.maximum(best.least().reshape(n, windows), floor).min(axis=1)  # what a score must reach for any of the anchor's windows
            live = np.flatnonzero(may[:, b] & (hi[:, b] >= need) & (lo[:, b] <= top) & ((seeds == b) == seed))
            if not len(live):
                continue
            r = slice(starts[b], starts[b] + BLOCK_ROWS)
            ids = rows.id[r]
            fits = (rows.label[r] == label[live, None]) == same
            fits &= ids != anchors.id[tile[live], None]
            lo_r, hi_r = brackets(s, anchors.square[tile[live]], anchors.d[tile[live]], rows.d[r], rows.d[r])
            fits &= (hi_r >= need[live, None]) & (lo_r <= top[live, None])
            work.blocks, work.bracketed = work.blocks + 1, work.bracketed + fits.size
            left = np.flatnonzero(fits.any(axis=0))
            some = fits.any(axis=1)
            if not len(left):
                continue
            live, fits = live[some], fits[some][:, left]
            work.scored += int(fits.sum())
            exact = products(anchors.v[tile[live]], rows.v[r][left], s.most)
            for w in range(windows):
                inside = fits & (exact >= floor[live, w, None]) & (exact <= ceiling[live, w, None])
                hit = inside.any(axis=1)
                if hit.any():
                    best.put(live[hit] * windows + w, np.where(inside[hit], exact[hit], NONE), ids[left])
        yield tile, best


def met(index: DataFrame, anchors: DataFrame, s: Space, chunks: int, same: bool) -> DataFrame:
    """(id, w, other, score): at most k a window from each pair of a group of rows and a chunk of anchors; anchors come with their groups `g`."""
    k = POSITIVES if same else NEGATIVES

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a = Rows(right, s)
            windows = 1 if same else POSITIVES
            for tile, best in searched(s, a, Rows(left, s), k, same):
                i, j = np.nonzero(best.score != NONE)
                out.append(pd.DataFrame({"id": a.id[tile[i // windows]], "w": i % windows, "other": best.id[i, j], "score": best.score[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("id", "w", "other", "score")})

    dealt = index.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = anchors.withColumnsRenamed({"g": "group", "c": "chunk"})
    return dealt.groupBy("g", "c").cogroup(asked.groupBy("group", "chunk")).applyInPandas(run, "id long, w long, other long, score long")


def first_k(rows: DataFrame, k: int) -> DataFrame:
    """rows with their rank in their window, up to k."""
    by = Window.partitionBy("id", "w").orderBy(F.desc("score"), "other")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(rows: DataFrame, group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """RESULT for prepared rows. Runs jobs: rows, index, anchors and positives are stored, as each is read several times."""
    spark = rows.sparkSession
    rows = saved(rows, "vectors")
    s = space(rows)
    if s is None:
        return spark.createDataFrame([], RESULT)
    n, n_anchors = rows.count(), rows.filter(F.col("id") % ANCHOR == 0).count()
    groups, chunks = -(-n // group_rows), max(1, -(-n_anchors // chunk_rows))
    index = saved(saved(measured(rows, s, False), "pivots").repartitionByRange(groups, *ORDER).withColumn("g", F.spark_partition_id()), "index")
    anchors = saved(measured(rows.filter(F.col("id") % ANCHOR == 0), s, True).withColumn("c", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "anchors")
    groups = index.agg(F.max("g")).first()[0] + 1  # Spark may deal into other numbers than asked for
    homes = index.select("label", F.col("g").alias("home")).distinct().withColumnRenamed("home", "g")  # at most a row for each label and one for each group
    found = first_k(met(index, anchors.join(homes, "label"), s, chunks, True), POSITIVES)
    positives = saved(found.select("id", (F.col("rank") - 1).cast("long").alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = positives.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))  # POSITIVES at most
    asked = anchors.join(listed, "id").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    out = first_k(met(index, asked, s, chunks, False), NEGATIVES).join(positives, ["id", "w"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mined(prepared(rows, label=label))
