"""LM scoring: a causal self-attention model on subword ids, trained in numpy, mixed with the words' corpus counts.

Words become pieces of a public vocabulary; pieces outside the ``PIECES`` most frequent of all training rows become
bytes. The model embeds ids, lets every position attend to those before it in its window (two heads, a learned bias
for each distance), and predicts the next id by a two-step softmax: a class of ids, then the id within it. Windows of
``SPAN`` positions overlap by ``OVERLAP``; each position is scored once, by the first window that holds it, and many
windows are computed at once under one causal mask. For scoring, everything that depends on one id alone (queries,
keys, values, its own part of the hidden layer) is looked up in tables made from the weights.

What is learned follows the corpus: words and pieces are counted over every training row, and the weights are fitted on
every training row, in three rounds of rows that their hashes choose: ``MAX_DOCS`` rows (of up to ``MAX_BYTES`` bytes) on the
driver, then every ``EVERY``-th of the others, then all the rest, which are nearly all. In the last two rounds a copy is
trained for each ``COPY_ROWS`` or ``LAST_ROWS`` rows, and the copies are averaged by the number of their windows. Which rows a
copy sees, and in which order, follows from hashes alone, no result depends on a row's place in a product, and sums
are exact: the partitions of the input change no score. Everything is scored whole.

A word's probability is ``1 - MIX`` times the model's (the product over its ids) plus ``MIX`` times its share
``(c + 1) / (N + V + 1)`` if it was seen, which is the base's. At most ``TABLE`` words of ``TABLE_BYTES`` bytes in all,
the most frequent, are broadcast; all other words of a document are joined to the counts by a shuffle, so neither
side's size matters. Frequent words never enter that shuffle, so no key of it is hot.

Defined cases: a null or empty text is its end alone; without training documents N and V are 0 and the model is its
random start; rows with equal ids are scored each for itself, equal texts equally; very long texts are cut into windows like any other and
come alone in a slice; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ragged, remainder, saved, slices, split_words

#: Rows that are fitted first, up to so many bytes each; of the others, one in so many goes before the rest.
MAX_DOCS, MAX_BYTES, EVERY = 450, 65536, 64
PIECES, CLASS = 1023, 32
SPAN, OVERLAP = 24, 8
DIM, HEADS, KEY, HIDDEN = 32, 2, 8, 48
EPOCHS, BATCH, RATE = 4, 80, 0.015
#: Learning rate of the copies that are averaged, and floats of a part of their weights.
LOCAL_RATE, CHUNK_FLOATS = 0.002, 1 << 12
#: Rows that one copy is fitted on, on average, those of the rest and its windows at once; steps of a unit in which weights are summed exactly.
COPY_ROWS, LAST_ROWS, WIDE, STEPS = 250, 2048, 256, 1 << 20
#: Words broadcast, their bytes in all and in one, windows computed at once, bytes of text at once.
TABLE, TABLE_BYTES, LONGEST, CHUNK, SLICE = 300_000, 4 << 20, 4096, 1280, 4 << 20
#: Windows that attend at once, positions of one class in a product (as many as a vector unit takes alike), and bytes of text whose words are counted at once.
PART, BLOCK, COUNTED = 64, 16, 8 << 20
#: Windows among which equal ones are computed once, and rows of a tall product that are summed at once.
ALIKE, TALL = 1 << 16, 384
FOLDS, HELD = 7, 2
#: Weight of the word's share in all training rows.
MIX = 0.5
END = 0


class Ids:
    """Model ids of words: END, 256 bytes, then the frequent pieces."""

    def __init__(self, path: str, frequent: list[int]) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        of = {p: 257 + i for i, p in enumerate(frequent)}
        made: list[list[int]] = []
        for p in range(self.sp.get_piece_size()):
            if p in of:
                made.append([of[p]])
            elif self.sp.is_byte(p):
                made.append([1 + int(self.sp.id_to_piece(p)[3:5], 16)])
            else:
                made.append([1 + b for b in self.sp.id_to_piece(p).replace("▁", " ").encode()])
        self.size = np.array([len(x) for x in made])
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.array([x for ids in made for x in ids], dtype=np.int32)
        self.met, self.met_pieces, self.met_n = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words in order, their number in each word)."""
        made = self.sp.encode(words, num_threads=1) if words else []
        return np.fromiter(chain.from_iterable(made), dtype=np.int64), np.fromiter(map(len, made), dtype=np.int64, count=len(words))

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for an Arrow array of different words; those met before, up to TABLE of TABLE_BYTES in all, are not encoded again."""
        place = pc.fill_null(pc.index_in(words, value_set=self.met), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = place < 0
        place[new] = len(self.met) + np.arange(new.sum())
        fresh = words.filter(pa.array(new))
        made, n = self.pieces(fresh.to_pylist())
        pieces, sizes = np.concatenate([self.met_pieces, made.astype(np.int32)]), np.concatenate([self.met_n, n.astype(np.int32)])
        size = sizes[place].astype(np.int64)
        out = pieces[ragged((np.cumsum(sizes, dtype=np.int64) - sizes)[place], size)]
        room = TABLE_BYTES - (pc.sum(pc.binary_length(self.met)).as_py() or 0)
        more = min(TABLE - len(self.met), int(np.searchsorted(np.cumsum(pc.binary_length(fresh).to_numpy(zero_copy_only=False), dtype=np.int64), room, side="right")))
        if more > 0:
            self.met = pa.concat_arrays([self.met, fresh.slice(0, more)])
            self.met_n = sizes[: len(self.met)]
            self.met_pieces = pieces[: int(self.met_n.sum())]
        return out, size

    def totals(self, uses: dict[int, int], ends: int) -> np.ndarray:
        """How often each id occurs where the pieces occur so often and texts end so often."""
        out = np.zeros(257 + PIECES)
        out[END] = ends
        for p, n in uses.items():
            np.add.at(out, self.pool[self.first[p] : self.first[p] + self.size[p]], n)
        return out

    def streams(self, words: pa.Array, counts: np.ndarray) -> Streams:
        """The ids of texts of so many words each; every different word is encoded once."""
        coded = words.dictionary_encode()
        pieces, n = self.coded(coded.dictionary)
        ids = np.concatenate([self.pool[ragged(self.first[pieces], self.size[pieces])], np.array([END], np.int32)])
        ends = np.concatenate([[0], np.cumsum(self.size[pieces])])[np.concatenate([[0], np.cumsum(n)])]
        size, start = np.append(np.diff(ends), 1), ends  # the end is the last word
        row, end = coded.indices.to_numpy(zero_copy_only=False), len(n)
        doc = np.repeat(np.arange(len(counts)), counts)
        token = np.full(len(row) + len(counts), end)
        token[np.arange(len(row)) + doc] = row
        both = np.full(len(row) + 2 * len(counts), end)
        both[np.arange(len(row)) + 2 * doc + 1] = row
        wide = size[both]
        total = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(counts + 2)])]
        return Streams(ids[ragged(start[both], wide)], np.diff(total), token, size[token], coded.dictionary)


_LAST: list[tuple[tuple, Ids]] = []


def ids_for(path: str, frequent: list[int]) -> Ids:
    """Ids(path, frequent), kept by a worker from task to task with the words that it met; it holds the last one alone."""
    key = path, tuple(frequent)
    if not _LAST or _LAST[0][0] != key:
        _LAST[:] = [(key, Ids(path, frequent))]
    return _LAST[0][1]


class Streams(NamedTuple):
    flat: np.ndarray  # of each text: END, the ids of its words, END
    sizes: np.ndarray  # ids of each text
    token: np.ndarray  # of each word, its place among the different words; of a text's end, their number
    wide: np.ndarray  # ids of each token
    words: pa.Array  # the different words


class Model(NamedTuple):
    emb: np.ndarray
    qkv: np.ndarray
    near: np.ndarray  # HEADS x SPAN, the bias of each distance
    own: np.ndarray
    seen: np.ndarray
    shift: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_id: np.ndarray  # classes x HIDDEN x CLASS
    id_bias: np.ndarray


def start(n_ids: int, seed: int = 9) -> Model:
    rng = np.random.default_rng(seed)
    classes = -(-n_ids // CLASS)
    wide = HEADS * (2 * KEY + DIM // HEADS)

    def normal(*shape: int, by: float) -> np.ndarray:
        return rng.normal(0, by, shape).astype(np.float32)

    return Model(
        normal(n_ids, DIM, by=0.3), normal(DIM, wide, by=0.2), np.tile(-0.1 * np.arange(SPAN, dtype=np.float32), (HEADS, 1)),
        normal(DIM, HIDDEN, by=0.2), normal(DIM, HIDDEN, by=0.2), np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, classes, by=0.1), np.zeros(classes, np.float32), normal(classes, HIDDEN, CLASS, by=0.1), np.zeros((classes, CLASS), np.float32),
    )


_GAP = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
_CAUSAL = _GAP >= 0


def _target_log_prob(z: np.ndarray, t: np.ndarray, safe: bool) -> np.ndarray:
    """Log-probability of t under softmax(z), not finite where exp overflows unless safe; z: windows x positions x classes, used up."""
    if safe:
        z -= z.max(axis=-1, keepdims=True)
    own = z.reshape(-1, z.shape[-1])[np.arange(len(t)), t]
    return own - np.log(np.matmul(np.exp(z, out=z), np.ones(z.shape[-1], np.float32))).ravel()


def _in_class(y: np.ndarray, place: np.ndarray, t: np.ndarray, safe: bool) -> np.ndarray:
    """The same within a class; y: blocks x ids x BLOCK positions, used up; place: the positions of interest among those of all blocks."""
    if safe:
        y -= y.max(axis=1, keepdims=True)
    own = y[place // BLOCK, t, place % BLOCK]
    return own - np.log(np.matmul(np.ones(CLASS, np.float32), np.exp(y, out=y))).ravel()[place]


class Ready:
    """A model's tables for scoring: what each id gives as a query, key and value, and to the hidden layer by itself.

    Values and the hidden layer have a last column of ones: it sums the attention, and makes biases rows of matrices.
    """

    def __init__(self, m: Model) -> None:
        z = (m.emb @ m.qkv).reshape(len(m.emb), HEADS, -1)
        self.q = np.concatenate([z[:, h, :KEY] / np.float32(np.sqrt(KEY)) for h in range(HEADS)], axis=1)
        one = np.ones((len(m.emb), 1), np.float32)
        self.kv = np.concatenate([x for h in range(HEADS) for x in (z[:, h, KEY:], one)], axis=1)
        self.own = np.concatenate([m.emb @ m.own + m.shift, one], axis=1)
        self.seen = np.concatenate([m.seen, np.zeros((DIM, 1), np.float32)], axis=1)
        self.to_class = np.concatenate([m.to_class, m.class_bias[None]])
        self.to_id = np.ascontiguousarray(np.concatenate([m.to_id, m.id_bias[:, None]], axis=1).transpose(0, 2, 1))
        self.near = [np.where(_CAUSAL, m.near[h, np.maximum(_GAP, 0)], -1e9).astype(np.float32) for h in range(HEADS)]


def _hidden(ids: np.ndarray, skip: int, r: Ready, safe: bool, out: np.ndarray) -> None:
    """The hidden layer of some windows from position skip on, into out."""
    own, wide = ids[:, skip:], DIM // HEADS
    seen = np.empty((*own.shape, DIM), dtype=np.float32)
    q, kv = r.q.take(own, axis=0), r.kv.take(ids, axis=0)
    for h in range(HEADS):
        at = h * (KEY + wide + 1)
        s = np.matmul(q[:, :, h * KEY : (h + 1) * KEY], kv[:, :, at : at + KEY].transpose(0, 2, 1))
        s += r.near[h][skip:]
        if safe:
            s -= s.max(axis=-1, keepdims=True)
        np.exp(s, out=s)
        o = np.matmul(s, kv[:, :, at + KEY : at + KEY + wide + 1])
        np.divide(o[:, :, :wide], o[:, :, wide:], out=seen[:, :, h * wide : (h + 1) * wide])
    np.matmul(seen, r.seen, out=out)
    out += r.own.take(own, axis=0)
    np.maximum(out, 0, out=out)


def log_probs(ids: np.ndarray, targets: np.ndarray, skip: int, r: Ready, safe: bool = False) -> np.ndarray:
    """Natural log-probability of each target from position skip on; ids, targets: windows x SPAN.

    A library may sum the rows of one product in different orders by their place in it, so no result depends on a row's place:
    windows are multiplied each by itself, and in blocks of one class the positions lie across, as lanes.
    """
    t = targets[:, skip:].ravel()
    c = t // CLASS
    hidden = np.empty((len(ids), SPAN - skip, r.seen.shape[1]), dtype=np.float32)
    z = np.empty((len(ids), SPAN - skip, r.to_class.shape[1]), dtype=np.float32)
    for a in range(0, len(ids), PART):
        _hidden(ids[a : a + PART], skip, r, safe, hidden[a : a + PART])
        np.matmul(hidden[a : a + PART], r.to_class, out=z[a : a + PART])
    out = _target_log_prob(z, c, safe)
    order = np.argsort(c.astype(np.int16), kind="stable")
    size = np.bincount(c, minlength=len(r.to_id))
    blocks = -(-size // BLOCK)
    place = ragged((np.cumsum(blocks) - blocks) * BLOCK, size)
    lane = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.int64)  # lanes that are over hold some position, whose result is not read
    lane[place] = order
    h = hidden.reshape(len(t), -1).take(lane, axis=0).reshape(-1, BLOCK, r.to_id.shape[2])
    y, across = np.empty((len(h), CLASS, BLOCK), dtype=np.float32), h.transpose(0, 2, 1)
    ends = np.cumsum(blocks)
    for k in np.flatnonzero(blocks).tolist():
        own = slice(ends[k] - blocks[k], ends[k])
        np.matmul(r.to_id[k], across[own], out=y[own])
    out[order] += _in_class(y, place, (t - c * CLASS)[order], safe)
    out = out.reshape(len(ids), -1)
    bad = np.flatnonzero(~np.isfinite(out).all(axis=1)) if not safe else []
    if len(bad):  # rare: a sum of exp is beyond float32
        out[bad] = log_probs(ids[bad], targets[bad], skip, r, True)
    return out


def windows(lengths: np.ndarray, step: int = SPAN - OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first position, first scored position) of each window, for documents of so many positions."""
    n = 1 + np.maximum(0, -(-(lengths - SPAN) // step))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, k * step, np.where(k > 0, k * step + SPAN - step, 0)


_ODD = np.random.default_rng(3).integers(0, 1 << 63, SPAN + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _different(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the different rows, which of these each row equals); by hashes, which are checked."""
    _, first, same = np.unique((rows.astype(np.uint64) * _ODD[: rows.shape[1]]).sum(axis=1), return_index=True, return_inverse=True)
    if not np.array_equal(rows[first[same]], rows):  # two rows of one hash
        return np.arange(len(rows)), np.arange(len(rows))
    return first, same


def score_streams(flat: np.ndarray, sizes: np.ndarray, r: Ready) -> np.ndarray:
    """The natural log-probability of every id of every stream after its first, in order; flat: streams of such sizes.

    Only the positions that a window scores are computed in it; those before are keys and values alone. Equal windows are computed once.
    """
    lengths, base = sizes - 1, np.cumsum(sizes) - sizes
    flat = np.concatenate([flat, np.zeros(SPAN + 1, np.int32)])
    doc, first, scored = windows(lengths)
    out = np.zeros(int(lengths.sum()))
    place = np.cumsum(lengths) - lengths
    for skip in (0, OVERLAP):
        own = np.flatnonzero(scored - first == skip)
        for a in range(0, len(own), ALIKE):
            w = own[a : a + ALIKE]
            d, f = doc[w], first[w]
            rows = flat[np.minimum((base[d] + f)[:, None] + np.arange(SPAN + 1), len(flat) - 1)]
            rows[np.arange(SPAN + 1) > (lengths[d] - f)[:, None]] = END  # what follows a text is not scored
            once, same = _different(rows)
            found = np.empty((len(once), SPAN - skip), np.float32)
            for k in range(0, len(once), CHUNK):
                part = rows[once[k : k + CHUNK]]
                with np.errstate(over="ignore", invalid="ignore"):
                    found[k : k + CHUNK] = log_probs(part[:, :-1], part[:, 1:], skip, r)
            to = f[:, None] + np.arange(skip, SPAN)
            inside = to < lengths[d][:, None]
            out[(place[d][:, None] + to)[inside]] = found[same][inside]
    return out


def _softmax(z: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(weighted sum of the log-probabilities of t, minus its gradient by z); z is used up."""
    rows = np.arange(len(t))
    _exp_ready(z)
    own = z[rows, t]
    total = np.maximum(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32), 1e-30)
    z *= (weight / total)[:, None]
    z[rows, t] -= weight
    return float(((own - np.log(total)) * weight).sum()), z


def _exp_ready(z: np.ndarray) -> None:
    """Bounds z so that sums of its exp stay finite; mostly one look at it."""
    if not z.max(initial=0) <= 60:
        np.minimum(z, 60, out=z)


def _run_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at first; pairs of floats are added as one complex number, in half as many strides."""
    return np.add.reduceat(x.view(np.complex64), first, axis=0).view(np.float32)


def _tall(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y for many rows, in blocks that stay in cache."""
    n = len(x) // TALL * TALL
    whole = np.matmul(x[:n].reshape(-1, TALL, x.shape[1]).transpose(0, 2, 1), y[:n].reshape(-1, TALL, y.shape[1])).sum(axis=0)
    return whole + x[n:].T @ y[n:]


def _gradients(ids: np.ndarray, targets: np.ndarray, wanted: np.ndarray, m: Model) -> tuple[float, list[np.ndarray]]:
    """(loss, its gradient by each array of m). What depends on one id alone is computed once for each id, not for each position."""
    b, flat, t = len(ids), ids.ravel(), targets.ravel()
    weight = wanted.ravel().astype(np.float32)
    weight /= max(1.0, float(weight.sum()))
    wide, scale = DIM // HEADS, np.float32(1 / np.sqrt(KEY))
    table = m.emb @ m.qkv
    table.reshape(len(table), HEADS, -1)[:, :, :KEY] *= scale
    z = table.take(flat, axis=0).reshape(b, SPAN, HEADS, -1).transpose(0, 2, 1, 3)
    q, k, v = z[..., :KEY], z[..., KEY : 2 * KEY], z[..., 2 * KEY :]
    p = np.matmul(q, k.transpose(0, 1, 3, 2))  # exp of the scores; their sums divide what is narrower
    p += np.where(_CAUSAL, m.near[:, np.maximum(_GAP, 0)], -1e9).astype(np.float32)
    _exp_ready(p)
    np.exp(p, out=p)
    part = 1 / np.matmul(p, np.ones((SPAN, 1), np.float32))
    seen = np.empty((b, SPAN, HEADS, wide), dtype=np.float32)
    o = seen.transpose(0, 2, 1, 3)
    np.multiply(np.matmul(p, v), part, out=o)
    seen = seen.reshape(b * SPAN, DIM)
    h = seen @ m.seen
    h += (m.emb @ m.own + m.shift).take(flat, axis=0)
    np.maximum(h, 0, out=h)
    c = t // CLASS
    y = h @ m.to_class
    y += m.class_bias
    loss, gc = _softmax(y, c, weight)
    order = np.argsort(c.astype(np.int16), kind="stable")
    sorted_c, hs = c[order], h.take(order, axis=0)
    first = np.flatnonzero(np.diff(sorted_c, prepend=-1))
    segments = [(int(sorted_c[x]), slice(x, y)) for x, y in zip(first.tolist(), [*first[1:].tolist(), len(t)])]
    gi = m.id_bias.take(sorted_c, axis=0)
    for x, s in segments:
        gi[s] += hs[s] @ m.to_id[x]
    own, gi = _softmax(gi, t[order] - sorted_c * CLASS, weight[order])
    loss += own
    g_id, g_ib, ghs = np.zeros_like(m.to_id), np.zeros_like(m.id_bias), np.empty_like(hs)
    g_ib[sorted_c[first]] = _run_sums(gi, first)
    for x, s in segments:
        np.matmul(hs[s].T, gi[s], out=g_id[x])
        np.matmul(gi[s], m.to_id[x].T, out=ghs[s])
    back_to = np.empty_like(order)
    back_to[order] = np.arange(len(order))
    gh = gc @ m.to_class.T
    gh += ghs.take(back_to, axis=0)
    gh *= h > 0
    go = (gh @ m.seen.T).reshape(b, SPAN, HEADS, wide).transpose(0, 2, 1, 3) * part
    gs = np.matmul(go, v.transpose(0, 1, 3, 2))
    gs -= np.einsum("bhij,bhij->bhi", go, o)[..., None]
    gs *= p
    g_near, per_gap = np.zeros_like(m.near), gs.sum(axis=0)
    for d in range(SPAN):
        g_near[:, d] = np.trace(per_gap, offset=-d, axis1=1, axis2=2)
    back = np.empty((b, SPAN, HEADS, 2 * KEY + wide), dtype=np.float32)
    gz = back.transpose(0, 2, 1, 3)
    np.matmul(gs, k, out=gz[..., :KEY])
    np.matmul(gs.transpose(0, 1, 3, 2), q, out=gz[..., KEY : 2 * KEY])
    np.matmul(p.transpose(0, 1, 3, 2), go, out=gz[..., 2 * KEY :])
    by = np.argsort(flat.astype(np.int16) if len(m.emb) < 1 << 15 else flat, kind="stable")
    run = flat[by]
    start = np.flatnonzero(np.diff(run, prepend=-1))
    of_z, of_h = np.zeros_like(table), np.zeros((len(m.emb), HIDDEN), dtype=np.float32)
    of_z[run[start]] = _run_sums(back.reshape(len(flat), -1).take(by, axis=0), start)
    of_h[run[start]] = _run_sums(gh.take(by, axis=0), start)
    of_z.reshape(len(of_z), HEADS, -1)[:, :, :KEY] *= scale
    g_emb = of_z @ m.qkv.T + of_h @ m.own.T
    return -loss, [g_emb, m.emb.T @ of_z, g_near, m.emb.T @ of_h, _tall(seen, gh), of_h.sum(0), _tall(h, gc), np.ones(len(gc), np.float32) @ gc, g_id, g_ib]


class Adam:
    """Adam steps on a model's arrays, in place."""

    def __init__(self, m: Model) -> None:
        self.m, self.step = m, 0
        self.first, self.second = [np.zeros_like(p) for p in m], [np.zeros_like(p) for p in m]

    def move(self, grads: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for p, g, m1, m2 in zip(self.m, grads, self.first, self.second):
            m1 += 0.1 * (g - m1)
            np.multiply(g, g, out=g)
            m2 += 0.01 * (g - m2)
            by = np.sqrt(np.divide(m2, 1 - 0.99**self.step, out=g), out=g)
            by += 1e-8
            p -= np.divide(m1, by, out=by) * (rate / (1 - 0.9**self.step))


def _batches(flat: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, size: int = BATCH, step: int = SPAN - OVERLAP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of the streams in random order, `size` at once: ids, targets, and which count."""
    lengths, base = sizes - 1, np.cumsum(sizes) - sizes
    flat = np.concatenate([flat, np.zeros(SPAN + 1, np.int32)])
    doc, first, _ = windows(lengths, step)
    order = rng.permutation(len(doc))
    for part in np.split(order, range(size, len(order), size)):
        at = first[part][:, None] + np.arange(SPAN)
        place = np.minimum(base[doc[part]][:, None] + at, len(flat) - 2)
        yield flat[place], flat[place + 1], at < lengths[doc[part]][:, None]


def fit(flat: np.ndarray, sizes: np.ndarray, n_ids: int, totals: np.ndarray | None = None) -> Model:
    """totals: how often each id occurs in all training rows; without them, the streams are counted."""
    m = start(n_ids)
    if not len(sizes):
        return m
    own = np.bincount(flat) if totals is None else totals
    counts = np.pad(own, (0, len(m.class_bias) * CLASS - len(own))) + 0.5
    m.class_bias[:] = np.log(counts.reshape(-1, CLASS).sum(1) / counts.sum())
    m.id_bias[:] = np.log(counts.reshape(-1, CLASS) / counts.reshape(-1, CLASS).sum(1, keepdims=True))
    rng, adam = np.random.default_rng(4), Adam(m)
    steps = EPOCHS * -(-len(windows(sizes - 1)[0]) // BATCH)
    for _ in range(EPOCHS):
        for ids, targets, wanted in _batches(flat, sizes, rng):
            adam.move(_gradients(ids, targets, wanted, m)[1], RATE * (1 - 0.95 * adam.step / steps))
    return m


def _copy(m: Model) -> Model:
    return Model(*[p.copy() for p in m])


def averaged(rows: DataFrame, copies: int, ids_of, model: Model, size: int = BATCH, step: int = SPAN - OVERLAP) -> Model:
    """model, fitted further on all of rows (h, t) by so many copies; the copies' mean by their windows.

    ids_of() gives the task's Ids. A row's copy follows from its hash h, and rows come in the order of their hashes, so neither
    partitions nor reruns matter. Copies leave in parts of their weights, as whole multiples of a small unit, and are added up
    in two steps: sums are exact, and no task and no driver sees more than a part of a bounded number of copies at once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        m, rng, n = _copy(shared.value), np.random.default_rng(6), 0
        adam, salt = Adam(m), table.column(0)[0].as_py() % 64
        ordered = table.sort_by([("h", "ascending"), ("t", "ascending")]).select(["t"]).combine_chunks().to_batches()
        for part in (part for b in ordered for part in slices(b, 0, SLICE)):
            text_ids = ids_of().streams(*split_words(part.column(0)))
            for ids, targets, wanted in _batches(text_ids.flat, text_ids.sizes, rng, size, step):
                adam.move(_gradients(ids, targets, wanted, m)[1], LOCAL_RATE * min(1.0, (adam.step + 1) / 20))
                n += len(ids)
        n = -(-n // 64)
        flat = np.round(np.concatenate([p.ravel() for p in m]).astype(np.float64) * STEPS).astype(np.int64) * n
        return pa.Table.from_batches([_part_row(k, salt, n, flat[a : a + CHUNK_FLOATS]) for k, a in enumerate(range(0, len(flat), CHUNK_FLOATS))], _part_row(0, 0, 0, flat[:0]).schema)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        salt = 0
        for b in batches:
            for k, salt, n, v in zip(*[c.to_pylist() for c in b.columns]):
                own = sums.setdefault(k, [0, 0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(v, dtype=np.int64)
        for k, (n, v) in sums.items():
            yield _part_row(k, salt, n, v)

    dealt = rows.select(F.pmod(F.shiftright("h", 20), F.lit(copies)).cast("int").alias("c"), "h", "t")
    once = dealt.groupBy("c").applyInArrow(run, _PARTS).repartition(64, "salt").mapInArrow(added, _PARTS)
    got: dict[int, list] = {}
    for r in once.repartition(16, "k").mapInArrow(added, _PARTS).collect():  # one row for each part of the weights
        got[r["k"]] = [r["n"], np.frombuffer(r["v"], dtype=np.int64)]
    if not got or not got[0][0]:
        return model
    flat = np.concatenate([got[k][1] / (got[k][0] * STEPS) for k in sorted(got)])
    ends = np.cumsum([p.size for p in model])
    return Model(*[x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, ends[:-1]), model)])


_PARTS = "k int, salt int, n bigint, v binary"


def _part_row(k: int, salt: int, n: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([n], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["k", "salt", "n", "v"])


def counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all rows of train; words are counted in slices of a task's rows before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0, COUNTED):
                seen = pc.value_counts(split_words(part.column(0))[0])
                yield pa.RecordBatch.from_arrays([seen.field(0), seen.field(1)], names=["word", "c"])

    return train.select(text).mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(seen: DataFrame, path: str) -> dict[int, int]:
    """How often each piece of the vocabulary is used in the words of seen: (word, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path, [])
        for b in batches:
            used, sizes = ids.pieces(b.column(0).to_pylist())
            known, place = np.unique(used, return_inverse=True)
            n = np.zeros(len(known), dtype=np.int64)
            np.add.at(n, place, np.repeat(b.column(1).to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["p", "n"])

    got = seen.select("word", "c").mapInArrow(run, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    return {r["p"]: r["n"] for r in got}


def frequent_words(seen: DataFrame) -> dict[str, int]:
    """The most frequent words of seen: (word, c), at most TABLE of TABLE_BYTES in all; whole levels of equal counts."""
    short = seen.filter(F.octet_length("word") <= LONGEST)
    levels = short.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("b")).orderBy(F.desc("c")).limit(TABLE).collect()
    words, size, floor = 0, 0, None
    for r in levels:
        words, size = words + r["n"], size + r["b"]
        if words > TABLE or size > TABLE_BYTES:
            break
        floor = r["c"]
    return {} if floor is None else {r["word"]: r["c"] for r in short.filter(F.col("c") >= floor).collect()}


class Learned(NamedTuple):
    """What scoring needs: (word, c) as a table, N, V, training rows, the words broadcast, the pieces kept, the weights."""

    seen: DataFrame
    n: int
    v: int
    n_docs: int
    top: dict[str, int]
    frequent: list[int]
    model: Model


def learned(train: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Learned:
    """Counts of all rows of train, and a model fitted on them."""
    seen = saved(counts(train, text), "words")
    n_docs = train.count()
    total = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    all_ = train.select(F.xxhash64(key, text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    place = F.pmod("h", F.lit(1 << 40))
    # the least hashes first, so that the rows' order does not depend on the order of a scan; the others are fitted after them
    early = place < min(1 << 40, int(1.2 * MAX_DOCS / max(1, n_docs) * (1 << 40)))
    some = all_.filter(early & (F.octet_length("t") <= MAX_BYTES)).select("h", "t", place.alias("p")).orderBy("p", "t").limit(MAX_DOCS + 1).collect()
    cut = some[-1]["p"] if len(some) > MAX_DOCS else 1 << 40
    first = [r for r in some if r["p"] < cut]
    late = ~early | (F.octet_length("t") > MAX_BYTES) | (place >= cut)
    uses = piece_counts(seen, path)
    sp = Ids(path, []).sp
    frequent = sorted((p for p in uses if not sp.is_byte(p)), key=lambda p: (-uses[p], p))[:PIECES]
    ids = Ids(path, frequent)
    own = ids.streams(*split_words(pa.array([r["t"] for r in first], pa.string())))
    model = fit(own.flat, own.sizes, 257 + PIECES, ids.totals(uses, n_docs))

    def ids_of() -> Ids:
        return ids_for(path, frequent)

    rest, turn = all_.filter(late), F.pmod("h", F.lit(EVERY)) == 1
    n_rest = n_docs - len(first)
    if n_rest:
        model = averaged(rest.filter(turn), max(1, round(n_rest / EVERY / COPY_ROWS)), ids_of, model)
        model = averaged(rest.filter(~turn), max(1, round(n_rest * (1 - 1 / EVERY) / LAST_ROWS)), ids_of, model, WIDE, SPAN)
    return Learned(seen, int(total[0]) + n_docs, int(total[1]) + (n_docs > 0), n_docs, frequent_words(seen), frequent, model)


def scored(docs: DataFrame, by: Learned, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row of docs."""
    # a fixed number of weights, a bounded table of words
    shared = docs.sparkSession.sparkContext.broadcast((by.model, pa.array(list(by.top), pa.string()), np.fromiter(by.top.values(), dtype=np.float64, count=len(by.top))))
    seen, n, n_docs, frequent = by.seen, by.n, by.n_docs, by.frequent
    below = log(n + by.v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, uses = shared.value
        ready, ids = Ready(model), ids_for(path, frequent)
        share = np.append(np.log(uses + 1) - below, np.nan)
        end = log(n_docs + 1) - below
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for part in slices(b, 1, SLICE):
                words, held = split_words(part.column(1))
                x = ids.streams(words, held)
                own = score_streams(x.flat, x.sizes, ready)
                at = np.cumsum(x.wide)
                model_ln = np.add.reduceat(own, at - x.wide) + log(1 - MIX)
                place = pc.fill_null(pc.index_in(x.words, value_set=table), len(table)).to_numpy(zero_copy_only=False)
                is_end = x.token == len(x.words)
                share_ln = np.append(share[place], end)[x.token]
                rare = np.isnan(share_ln)
                knows = ~rare & (~is_end | (n_docs > 0))
                mixed = np.where(knows, np.logaddexp(model_ln, np.where(knows, share_ln, 0) + log(MIX)), model_ln)
                first = np.cumsum(held + 1) - held - 1
                known = np.add.reduceat(knows.astype(np.int64), first)
                base = np.add.reduceat(np.where(rare, -below, share_ln), first) / log(10)
                few = np.add.reduceat(rare.astype(np.int64), first)
                ends = pa.array(np.concatenate([[0], np.cumsum(few)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.arange(row, row + part.num_rows)), pa.array(held + 1, pa.int64()), pa.array(known), pa.array(base),
                        pa.array(np.add.reduceat(mixed, first) / log(10)),
                        pa.ListArray.from_arrays(ends, words.filter(pa.array(rare[~is_end]))), pa.ListArray.from_arrays(ends, pa.array(model_ln[rare])),
                    ],
                    names=[key, "_row", "n_tokens", "_known", "_base", "_score", "_rare", "_ln"],
                )
                row += part.num_rows

    kind = docs.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, _row bigint, n_tokens bigint, _known bigint, _base double, _score double, _rare array<string>, _ln array<double>"
    made = saved(docs.select(key, text).mapInArrow(run, fields), "scored")
    rare = made.select("_row", F.explode(F.arrays_zip("_rare", "_ln")).alias("x")).select("_row", F.col("x._rare").alias("word"), F.col("x._ln").alias("ln"))
    share = F.log(F.col("c") + 1)

    def exact(x: Column) -> Column:
        """The sum of x in whole units of 2^-34, so that its order does not matter; two halves, so that none is too long for a number."""
        u = F.round(x * (1 << 34)).cast("long")
        return (F.sum(F.shiftright(u, 20)).cast("double") * (1 << 20) + F.sum(u.bitwiseAND(F.lit((1 << 20) - 1)))) / (1 << 34)

    more = rare.join(seen, "word").groupBy("_row").agg(
        F.count("*").alias("_more"), exact(share).alias("_add"), exact(F.log1p(F.exp(share + F.lit(log(MIX) - below) - F.col("ln")))).alias("_gain")
    )
    return made.drop("_rare", "_ln").join(more, "_row", "left").select(
        key, "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_add", F.lit(0.0)) / log(10)).alias("base_score"), (F.col("_score") + F.coalesce("_gain", F.lit(0.0)) / log(10)).alias("score"),
    )


def op4_lm(docs: DataFrame, path: str) -> DataFrame:
    held = remainder(F.col("doc_id"), FOLDS) == HELD
    out = scored(docs, learned(docs.filter(~held), path), path)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
