"""Toxicity: bags of subword embeddings, averaged by window, into a linear softmax; trained jointly in numpy.

A word is the bag of its byte n-grams (3 to 6, with word-end marks) and itself, each hashed to a bucket with an
embedding. The bags of a window of words are averaged (short windows count as full ones, padded with zero) and go
into a softmax over {clean, toxic}. A document's margin is pooled over its windows: smoothly while training, by the
largest at scoring, so a few words in a long text are not averaged away. As the softmax is linear, a trained word
is worth one number, which scoring keeps in a bounded cache; unseen misspellings share n-grams and need no training.

The classifier is fitted on at most ``MAX_DOCS`` labelled documents of each class, those of the least hashes of their
ids, of up to ``MAX_BYTES`` bytes. Everything is scored whole.

Defined cases: null and empty texts have no window and score the softmax's bias; no labels at all give score 0;
a null label is no label; several labels of a document count as toxic if any is; of several texts under one id the least
is learned from; very long texts are scored whole, window by window; repeated rows score alike; an empty table gives an
empty result; other columns pass through ``clean`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, positional, quoted, remainder, slices

#: Bound of the training sample.
MAX_DOCS, MAX_BYTES = 1000, 65536
BUCKETS, DIM, GRAMS, WINDOW = 1 << 18, 8, (3, 4, 5, 6), 24
EPOCHS, RATE = 140, 0.5
#: Words a worker remembers.
CACHE = 300_000
FOLDS = 5
#: Running words that are fitted on at once, and different words whose n-grams are made at once.
PASS, RUN = 1 << 17, 1 << 13


class Model(NamedTuple):
    """value: what each bucket adds to the margin toxic - clean of a bag that holds it alone; bias: the margin of an empty bag."""

    value: np.ndarray
    bias: float


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every subword of every word; n-grams are taken from all words at once."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    text = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    owner = np.repeat(np.arange(len(raw)), lengths)
    mix = np.uint64(0x9E3779B97F4A7C15)
    ids, at = [], []
    rolled = np.zeros(len(text), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(text) - n + 1
        if m <= 0:
            break
        rolled = (rolled[:m] + text[n - 1 :] + np.uint64(n)) * mix
        rolled ^= rolled >> np.uint64(29)
        if n in GRAMS:
            inside = owner[:m] == owner[n - 1 :]
            ids.append((rolled[inside] >> np.uint64(40)) % np.uint64(BUCKETS))
            at.append(owner[:m][inside])
    whole = np.zeros(len(raw), dtype=np.uint64)  # the word itself
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(text):
        np.add.at(whole, owner, (text + np.uint64(1)) * (mix + (place.astype(np.uint64) * np.uint64(0x100000001B3) << np.uint64(1))))
    whole ^= whole >> np.uint64(31)
    ids.append((whole * mix >> np.uint64(40)) % np.uint64(BUCKETS))
    at.append(np.arange(len(raw)))
    return np.concatenate(ids).astype(np.int64), np.concatenate(at)


def word_values(words: list[str], value: np.ndarray) -> np.ndarray:
    """The mean value of each word's subwords."""
    if not words:
        return np.zeros(0)
    ids, at = bags(words)
    return np.bincount(at, weights=value[ids], minlength=len(words)) / np.bincount(at, minlength=len(words))


def _split(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    out: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            w = t.lower().split()
            counts[i] = len(w)
            out += w
    return out, counts


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window among all words, document of each window)."""
    n = -(-counts // WINDOW)
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(counts) - counts
    return first[doc] + (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * WINDOW, doc


def _fresh(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 where a word differs from the three before it in its text, else 0: runs of a repeated word count once."""
    out, owner = np.ones(len(values)), np.repeat(np.arange(len(counts)), counts)
    for lag in (1, 2, 3):
        out[lag:][(values[lag:] == values[:-lag]) & (owner[lag:] == owner[:-lag])] = 0
    return out


class Part(NamedTuple):
    """Some texts with words, as numbers."""

    token: np.ndarray  # the words' numbers, one text behind the other
    fresh: np.ndarray  # whether a word counts
    starts: np.ndarray  # of the windows, among the words
    sizes: np.ndarray  # words of each window
    docs: np.ndarray  # the texts
    first: np.ndarray  # of each text, its first window
    windows: np.ndarray  # of each text, how many


def _numbered(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, the number of every word of the texts in order, how many each text has); one text is split at a time."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    found = []
    for t in texts:
        w = t.lower().split() if t else []
        found.append(np.fromiter(map(known.__getitem__, w), dtype=np.int32, count=len(w)))
    return list(known), np.concatenate(found), np.array([len(x) for x in found])


def _parts(token: np.ndarray, counts: np.ndarray) -> Iterator[Part]:
    """Runs of whole texts of about PASS words each (a longer text comes alone or last)."""
    docs = np.flatnonzero(counts)
    ends = np.cumsum(counts[docs])
    for own in np.split(np.arange(len(docs)), np.flatnonzero(np.diff((ends - 1) // PASS)) + 1):
        if len(own):
            n = counts[docs[own]]
            mine = token[ends[own[0]] - n[0] : ends[own[-1]]]
            starts, doc = _windows(n)
            windows = np.bincount(doc, minlength=len(n))
            yield Part(mine, _fresh(mine, n) > 0, starts, np.diff(starts, append=len(mine)), docs[own], np.cumsum(windows) - windows, windows)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Full-batch momentum on the pooled windows; the loss weighs both classes alike.

    One scale for each parameter array, so that rare n-grams do not move as far as frequent ones. Beside the texts it holds 5 bytes
    for each of their words and 8 for each frequent n-gram of a different word; all else is made for a run of texts or words at a time.
    """
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, dtype=np.float32), -30.0 if not len(y) or y.max() == 0 else 30.0)
    words, token, counts = _numbered(texts)
    runs = [(a, words[a : a + RUN]) for a in range(0, len(words), RUN)]
    # buckets of fewer than 4 running words say little and are left at zero
    times, size, running = np.bincount(token, minlength=len(words)).astype(np.float64), np.zeros(len(words)), np.zeros(BUCKETS)
    for a, run in runs:
        ids, at = bags(run)
        size[a : a + len(run)] = np.bincount(at, minlength=len(run))
        running += np.bincount(ids, weights=times[a + at], minlength=BUCKETS)
    used, slots, mark = np.zeros(BUCKETS, dtype=bool), [], running >= 4
    for a, run in runs:
        ids, at = bags(run)
        keep = mark[ids]
        used[ids[keep]] = True
        slots.append((a, len(run), ids[keep].astype(np.int32), at[keep].astype(np.int32)))
    used, place = np.flatnonzero(used), (np.cumsum(used) - 1).astype(np.int32)
    slots = [(a, n, place[ids], at) for a, n, ids, at in slots]
    del words, runs, times
    parts = list(_parts(token, counts))
    rng = np.random.default_rng(5)
    emb, lin, bias = rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    params = [emb, lin, bias]
    first, second = [np.zeros_like(p) for p in params], [0.0, 0.0, 0.0]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for step in range(1, EPOCHS + 1):
        side = lin[:, 1] - lin[:, 0]
        per_slot, per_word = emb @ side, np.zeros(len(size))
        for a, n, slot, at in slots:
            per_word[a : a + n] = np.bincount(at, weights=per_slot[slot], minlength=n)
        per_word /= size
        g_word, g_bucket, g_bias = np.zeros(len(size)), np.zeros(len(used)), 0.0
        for p in parts:
            margin = np.add.reduceat(per_word[p.token] * p.fresh, p.starts) / WINDOW
            soft = np.exp(np.minimum(0, (margin - np.repeat(np.maximum.reduceat(margin, p.first), p.windows)) * (0.5 + 2.0 * step / EPOCHS)))
            soft /= np.repeat(np.add.reduceat(soft, p.first), p.windows)
            pooled = np.add.reduceat(soft * margin, p.first) + bias[1] - bias[0]
            err = (1 / (1 + np.exp(-np.clip(pooled, -40, 40))) - y[p.docs]) * weight[p.docs]
            g_bias += err.sum()
            np.add.at(g_word, p.token.astype(np.intp), np.repeat(np.repeat(err, p.windows) * soft / WINDOW, p.sizes) * p.fresh)
        g_word /= size
        for a, n, slot, at in slots:
            np.add.at(g_bucket, slot.astype(np.intp), g_word[a : a + n][at])
        g_lin = emb.T @ g_bucket
        of_emb = np.outer(g_bucket, side)
        of_emb += 1e-7 * emb
        for i, (p, g, m) in enumerate(zip(params, [of_emb, np.stack([-g_lin, g_lin], axis=1), np.array([-g_bias, g_bias])], first)):
            second[i] = max(second[i] * 0.95, float(g.max(initial=0)), -float(g.min(initial=0)))
            g -= m
            g *= 0.1
            m += g
            p -= np.multiply(m, RATE * (0.3 + 0.7 * (1 - step / EPOCHS)) / (second[i] + 1e-12), out=g)
    value = np.zeros(BUCKETS, dtype=np.float32)
    value[used] = emb @ (lin[:, 1] - lin[:, 0])
    return Model(value, float(bias[1] - bias[0]))


def scores(texts: list[str | None], model: Model, cache: dict[str, float]) -> np.ndarray:
    """The probability of toxic for each text; cache: word values of earlier calls."""
    words, counts = _split(texts)
    got = np.fromiter(map(cache.get, words, repeat(np.nan)), dtype=np.float64, count=len(words))
    missing = np.flatnonzero(np.isnan(got))
    if len(missing):
        new = list({words[i] for i in missing.tolist()})
        if len(cache) + len(new) > CACHE:
            cache.clear()
        found = dict(zip(new, word_values(new, model.value).tolist()))
        got[missing] = np.fromiter((found[words[i]] for i in missing.tolist()), dtype=np.float64, count=len(missing))
        cache.update(found)
    margin = np.zeros(len(texts))
    starts, doc = _windows(counts)
    if len(starts):
        sums = np.add.reduceat(got * _fresh(got, counts), starts) / WINDOW
        has = np.flatnonzero(counts)
        margin[has] = np.maximum.reduceat(sums, np.searchsorted(doc, has))
    return 1 / (1 + np.exp(-np.clip(margin + model.bias, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int | None = FOLDS) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: labelled rows outside fold 0, at most MAX_DOCS of each class. Only labels of rows that docs
    has, short enough to learn from, are drawn from."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
    rows = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t")).filter(F.octet_length("t") <= MAX_BYTES)
    if folds:
        rows, known = rows.filter(remainder(F.col("k"), folds) != 0), known.filter(remainder(F.col("k"), folds) != 0)
    known = known.join(rows.select("k"), "k", "left_semi")  # ids alone move
    # each class by its hashes: a share that holds enough of it, of which the least are taken
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y, count in sorted(n.items()):
        share = int(min(1.0, 1.5 * MAX_DOCS / count) * (1 << 40))
        own = known.filter((F.col("y") == y) & (F.pmod(F.xxhash64("k"), F.lit(1 << 40)) <= share))
        own = own.orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 40)), "k").limit(MAX_DOCS)
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        return [], []
    # at most 2 * MAX_DOCS ids, so that no text is shuffled to find them; one text for each
    got = rows.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).toArrow().sort_by([("y", "ascending"), ("k", "ascending")])
    return got.column("t").to_pylist(), got.column("y").to_pylist()


def scored(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability of toxic; every column of docs is kept, and `into` must be none of them."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input
    names = docs.columns
    at = names.index(text)
    local: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, at)):
            p = scores(b.column(at).to_pylist(), shared.value, local)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*names, into])

    return positional(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def op2_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(*sample(docs, labels))
    out = scored(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below limit, learned from the labels outside fold 0."""
    into = fresh("score", docs.columns)
    out = scored(spark, docs, fit(*sample(docs, labels)), into=into)
    return out.filter(F.col(into) < limit).select(*[F.col(quoted(c)) for c in docs.columns])
