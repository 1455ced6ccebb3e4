"""Language ID: a byte convolutional network over fixed-length windows, trained in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over the window, and classified by a
softmax. A text is cut into windows of ``WINDOW`` bytes, the last one padded with zeros; the mean of the windows'
log-probabilities decides, so every byte of every text counts. The convolution is one matrix product over unfolded
windows: narrow filters are padded with zero weights to the widest.

The network is fitted on a bounded sample: of each language the ``max(LEAST, MAX_DOCS / languages)`` texts of the least
hashes, of up to ``MAX_BYTES`` bytes, and up to ``MAX_WINDOWS`` evenly spaced windows of each. Every language that has
a labelled text can be predicted. Everything is classified whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training rows every text is; with
one language alone every text with a letter is of it; very long texts are classified whole, window by window; of equal
probabilities the first language by code point wins; repeated rows get equal results; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remainder, slices

#: Bound of the training sample.
MAX_DOCS, LEAST, MAX_WINDOWS, MAX_BYTES = 800, 20, 6, 65536
WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 10
EPOCHS, BATCH, RATE = 12, 64, 0.01
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Windows convolved at once, so that the unfolded bytes stay in cache.
CHUNK = 48


class Model(NamedTuple):
    names: list[str]
    emb: np.ndarray  # 256 x DIM
    kernel: np.ndarray  # widest * DIM x filters
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _mask() -> np.ndarray:
    """Which weights of the padded kernel exist."""
    wide = max(WIDTHS)
    return np.concatenate([np.repeat((np.arange(wide) < w), DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)


def cut(text: bytes) -> np.ndarray:
    """The windows of text, a row each, padded to WINDOW and to the widest filter."""
    n = max(1, -(-len(text) // WINDOW))
    rows = np.zeros((n, WINDOW + max(WIDTHS) - 1), dtype=np.uint8)
    flat = np.zeros(n * WINDOW + max(WIDTHS) - 1, dtype=np.uint8)
    flat[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    rows[:, :WINDOW] = flat[: n * WINDOW].reshape(n, WINDOW)
    rows[:-1, WINDOW:] = rows[1:, : max(WIDTHS) - 1]
    return rows


def _unfold(rows: np.ndarray, emb: np.ndarray) -> np.ndarray:
    x = emb[rows]
    wide = max(WIDTHS)
    a, b, c = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(rows), WINDOW, wide * DIM), (a, b, c)).reshape(-1, wide * DIM)


def pooled(rows: np.ndarray, m: Model) -> np.ndarray:
    """The filters' maxima; each window is multiplied by itself."""
    return np.matmul(_unfold(rows, m.emb).reshape(len(rows), WINDOW, -1), m.kernel).max(axis=1)


def log_probs(rows: np.ndarray, m: Model) -> np.ndarray:
    """Of each window. A library may sum the rows of one product in different orders by their place in it, so each window is
    a product of its own, and its result does not depend on its neighbours."""
    parts = [np.maximum(pooled(rows[a : a + CHUNK], m) + m.shift, 0)[:, None] for a in range(0, len(rows), CHUNK)]
    z = np.concatenate([np.matmul(h, m.out)[:, 0] for h in parts]) + m.bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    rng = np.random.default_rng(3)
    wide, mask = max(WIDTHS), _mask()
    n_f = mask.shape[1]
    m = Model(
        names, rng.normal(0, 0.5, (256, DIM)).astype(np.float32), (rng.normal(0, 0.3, (wide * DIM, n_f)) * mask).astype(np.float32),
        np.zeros(n_f, np.float32), rng.normal(0, 0.3, (n_f, max(1, len(names)))).astype(np.float32), np.zeros(max(1, len(names)), np.float32),
    )
    if len(names) < 2:
        return m
    rows, ys = [], []
    for t, l in zip(texts, langs):
        own = cut(t.encode())
        keep = own if len(own) <= MAX_WINDOWS else own[np.linspace(0, len(own) - 1, MAX_WINDOWS).astype(int)]
        rows.append(keep)
        ys += [names.index(l)] * len(keep)
    x, y = np.concatenate(rows), np.array(ys)
    share = np.bincount(y, minlength=len(names)) / len(y)
    params = [m.emb, m.kernel, m.shift, m.out, m.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for part in np.split(order, range(BATCH, len(order), BATCH)):
            step += 1
            b = x[part]
            unfolded = _unfold(b, m.emb)
            conv = (unfolded @ m.kernel).reshape(len(b), WINDOW, n_f)
            at = conv.argmax(axis=1)  # rows x filters
            top = np.take_along_axis(conv, at[:, None], axis=1)[:, 0] + m.shift
            h = np.maximum(top, 0)
            z = h @ m.out + m.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[part]] -= 1
            p *= (1 / np.sqrt(share[y[part]] * len(names)) / len(b))[:, None]
            g_h = (p @ m.out.T) * (top > 0)
            where = (np.arange(len(b))[:, None] * WINDOW + at).ravel()
            taken = unfolded[where].reshape(len(b), n_f, -1)
            g_k = np.einsum("bf,bfk->kf", g_h, taken) * mask
            g_x = (g_h[:, :, None] * m.kernel.T[None]).reshape(len(b) * n_f, wide, DIM)
            g_e = np.zeros_like(m.emb)
            sources = np.take_along_axis(np.lib.stride_tricks.sliding_window_view(b, wide, axis=1), at[:, :, None], axis=1).reshape(-1, wide)
            np.add.at(g_e, sources.ravel(), g_x.reshape(-1, DIM))
            for i, g in enumerate((g_e, g_k, g_h.sum(0), h.T @ p, p.sum(0))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.01 * (g * g - second[i])
                params[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
    return m


def predictions(texts: list[str | None], m: Model) -> tuple[list[str], list[float]]:
    langs, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and m.names and any(map(str.isalpha, t))]
    at = 0
    while at < len(todo):
        part, parts, size = [], [], 0
        while at < len(todo) and size < 1 << 22:
            rows = cut(texts[todo[at]].encode("utf-8", "replace"))
            part.append(todo[at])
            parts.append(rows)
            size += rows.size
            at += 1
        counts = np.array([len(r) for r in parts])
        mean = np.add.reduceat(log_probs(np.concatenate(parts), m), np.cumsum(counts) - counts, axis=0) / counts[:, None]
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        for i, p in zip(part, prob):
            k = int(p.argmax())
            langs[i], sure[i] = m.names[k], float(p[k])
    return langs, sure


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """Texts and languages to learn from, of each language those of the least hashes."""
    known = docs.select(F.xxhash64(key, text).alias("h"), F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    known = known.filter(F.col("l").isNotNull() & F.octet_length("t").between(1, MAX_BYTES) & (remainder(F.col("k"), FOLDS) != HELD))
    per = known.groupBy("l").count().collect()  # a row for each language
    if not per:
        return [], []
    each = max(LEAST, MAX_DOCS // len(per))
    share = [(r["l"], int(min(1.0, 1.5 * each / r["count"]) * (1 << 40))) for r in per]
    of = F.broadcast(docs.sparkSession.createDataFrame(share, "l string, share long"))
    some = known.join(of, "l").filter(F.pmod("h", F.lit(1 << 40)) <= F.col("share"))
    first = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 40)), "t")
    got = some.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each).select("l", "n", "t").collect()
    got = sorted(got, key=lambda r: (r["l"], r["n"]))
    return [r["t"] for r in got], [r["l"] for r in got]


def identified(spark: SparkSession, docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of each row of docs."""
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            langs, sure = predictions(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=[key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def op8_langid(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = fit(*sample(docs))
    return identified(spark, docs, model).select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
