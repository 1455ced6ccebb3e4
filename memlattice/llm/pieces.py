"""SentencePiece encoding and decoding by suffix-array matching.

A text becomes units: runs of the space mark with the word after them; no piece holds a mark behind a letter, so units
are encoded apart. The different units of a slice of texts are concatenated and indexed by a suffix array (sorted to
the length of the longest piece, by rank doubling); every piece of the vocabulary is found by binary search, all pieces
at once; its range in the array gives its occurrences. These edges, sorted by position, form the lattice that is
relaxed by the model's rule: of all edges that span exactly two current symbols the best-scoring one, leftmost first,
becomes one symbol, until none is left. Units up to ``SHORT`` characters are relaxed together in rounds, longer ones
each with a heap over their edges. Nothing is carried from one slice to the next.

Characters without a piece fall back to bytes. Decoding gathers the pieces' bytes of a whole slice at once and drops
the mark put in front of each text.

Defined cases: null and empty texts have no pieces and decode to the empty text; a space mark inside a text decodes to a
space, as in the library; bytes that are no UTF-8 decode to U+FFFD; very long texts are encoded whole, alone in their
slice; repeated rows are equal; an empty table gives an empty result; every column passes through, and a new column
whose name the table has already gets underscores behind it until no column has it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import fresh, positional, ragged, slices

MARK = "▁"
#: Bytes of a slice of texts, and the longest unit relaxed in rounds.
SLICE, SHORT = 2_500_000, 48
#: Stands between units; above every code point.
GAP = 0x110000


class Vocabulary:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {texts[i]: i for i in plain}
        self.byte_ids = {int(texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece spans two words")
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = texts[i].replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.size = np.array([len(x) for x in self.raw])
        self.begin = np.cumsum(self.size) - self.size
        ones = sorted((ord(texts[i]), i) for i in plain if len(texts[i]) == 1)
        self.one_codes, self.one_ids = np.array([c for c, _ in ones], dtype=np.uint32), np.array([i for _, i in ones], dtype=np.int64)
        multi = sorted((i for i in plain if len(texts[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.multi = np.array(multi)
        self.length = np.array([len(texts[i]) for i in multi])
        self.longest = int(self.length.max(initial=1))
        self.codes = np.zeros((len(multi), self.longest), dtype=np.uint32)
        for k, i in enumerate(multi):
            self.codes[k, : self.length[k]] = [ord(c) for c in texts[i]]

    def symbol(self, text: str) -> list[int]:
        got = self.ids.get(text)
        if got is not None:
            return [got]
        return [self.byte_ids.get(b, self.unknown) for b in text.encode("utf-8", "replace")]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of codes in the order of their first `depth` codes (at least); the end sorts last, as GAP does."""
    n = len(codes)
    kinds = np.flatnonzero(np.bincount(codes))
    dense = np.zeros(int(kinds[-1]) + 1 if n else 1, dtype=np.int64)
    dense[kinds] = np.arange(len(kinds))
    # as many codes as fit one number are sorted at once
    base = len(kinds) + 1
    span = max(1, min(depth, int(62 / np.log2(base))))
    padded = np.concatenate([dense[codes], np.full(span, base - 1)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(span):
        key *= base
        key += padded[j : j + n]
    order = np.argsort(key)
    new = np.ones(n, dtype=bool)
    new[1:] = np.diff(key[order]) != 0
    while span < depth:
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)  # only equal ones are sorted on, by the ranks of what follows
        if not len(tied):
            break
        rank = np.empty(n + 1, dtype=np.int64)
        rank[order], rank[n] = group, n + 1
        key = group[tied] * (n + 2) + rank[np.minimum(order[tied] + span, n)]
        by = np.argsort(key)
        order[tied] = order[tied[by]]
        key = key[by]
        new[tied[1:]] |= np.diff(key) != 0
        span *= 2
    return order


def occurrences(codes: np.ndarray, order: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every occurrence of every piece, sorted by position; pieces are numbered best first."""
    n, p = len(codes), len(v.length)
    padded = np.concatenate([codes, np.full(v.longest, GAP, dtype=np.uint32)])
    step = np.arange(v.longest)
    inside = step[None, :] < v.length[:, None]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(p, dtype=np.int64), np.full(p, n, dtype=np.int64)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, n - 1)
            own = padded[order[mid][:, None] + step]
            differs = (own != v.codes) & inside
            at = differs.argmax(axis=1)
            rows = np.arange(p)
            same = ~differs[rows, at]
            less = np.where(same, upper, own[rows, at] < v.codes[rows, at])
            open_ = lo < hi
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    if not p or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = bound(False), bound(True)
    count = hi - lo
    piece = np.repeat(np.arange(p), count)
    place = order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    by = np.argsort(place)
    return place[by], piece[by]


def _rounds(starts: np.ndarray, ends: np.ndarray, best: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """Boundaries after relaxing all units together; an edge is (start, end, rank), best first by rank."""
    mark = np.ones(n + 1, dtype=bool)
    while len(starts):
        seen = np.concatenate(([0], np.cumsum(mark)))
        spanned = seen[ends] - seen[starts]
        alive = mark[starts] & mark[ends] & (spanned >= 2)
        starts, ends, best, unit, spanned = starts[alive], ends[alive], best[alive], unit[alive], spanned[alive]
        ready = np.flatnonzero(spanned == 2)
        if not len(ready):
            break
        key = best[ready] * (n + 1) + starts[ready]
        first = np.flatnonzero(np.concatenate(([True], unit[ready][1:] != unit[ready][:-1])))
        chosen = ready[key == np.repeat(np.minimum.reduceat(key, first), np.diff(np.append(first, len(ready))))]
        s, width = starts[chosen], ends[chosen] - starts[chosen]
        for j in range(1, int(width.max())):
            mark[s[width > j] + j] = False
    return mark


def _heap(length: int, edges: dict[tuple[int, int], int]) -> list[int]:
    """Boundaries of one unit of that length; edges: rank by (start, end)."""
    right = list(range(1, length + 1)) + [length]
    left = [-1, *range(length)]
    heap = [(edges[i, i + 2], i, i + 1, i + 2) for i in range(length - 1) if (i, i + 2) in edges]
    heapq.heapify(heap)
    gone = [False] * (length + 1)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if gone[s] or gone[m] or right[s] != m or right[m] != e:
            continue
        gone[m] = True
        right[s] = e
        if e < length:
            left[e] = s
            if (s, right[e]) in edges:
                heapq.heappush(heap, (edges[s, right[e]], s, e, right[e]))
        if s > 0 and (left[s], e) in edges:
            heapq.heappush(heap, (edges[left[s], e], left[s], s, e))
    return [i for i in range(length) if not gone[i]] + [length]


def match(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units in order, their number in each unit); units are different texts that begin with a mark."""
    if not units:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    codes = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    begin = np.cumsum(lengths + 1) - lengths - 1
    codes[begin[1:] - 1] = GAP
    place, piece = occurrences(codes, suffix_array(codes, v.longest), v)
    unit = np.repeat(np.arange(len(units)), lengths + 1)[: len(codes)][place]
    ends = place + v.length[piece]
    short = lengths[unit] <= SHORT
    mark = _rounds(place[short], ends[short], piece[short], unit[short], len(codes))
    long = {int(u): {} for u in np.flatnonzero(lengths > SHORT)}
    for u, s, e, k in zip(unit[~short].tolist(), place[~short].tolist(), ends[~short].tolist(), piece[~short].tolist()):
        b = int(begin[u])
        long[u][s - b, e - b] = k
    # the id of the symbol that begins at each position, -1 where only bytes do
    at = np.minimum(np.searchsorted(v.one_codes, codes), len(v.one_codes) - 1)
    symbol = np.where(v.one_codes[at] == codes, v.one_ids[at], -1)
    seen = np.concatenate(([0], np.cumsum(mark)))
    done = short & mark[place] & mark[ends] & (seen[ends] - seen[place] == 1)
    symbol[place[done]] = v.multi[piece[done]]
    bounds = np.flatnonzero(mark)
    first, last = np.searchsorted(bounds, begin), np.searchsorted(bounds, begin + lengths)
    ids = symbol[bounds[bounds < len(codes)]].astype(np.int32)
    odd = np.concatenate(([0], np.cumsum(ids < 0)))
    slow = np.flatnonzero((odd[np.minimum(last, len(ids))] > odd[first]) | (lengths > SHORT))
    other = []
    for u in slow.tolist():
        t, b = units[u], int(begin[u])
        cuts = _heap(len(t), long[u]) if u in long else (bounds[first[u] : last[u] + 1] - b).tolist()
        other.append([x for p, q in zip(cuts, cuts[1:]) for x in v.symbol(t[p:q])])
    # the slow units' ids stand behind all others
    sizes = np.array([len(x) for x in other], dtype=np.int64)
    count, start = last - first, first.copy()
    count[slow], start[slow] = sizes, len(ids) + np.cumsum(sizes) - sizes
    pool = np.concatenate([ids, np.array([x for o in other for x in o], dtype=np.int32)])
    return pool[ragged(start, count)], count


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the units of all texts in order, each without the first of its space marks; their number in each text)."""
    plain = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    lists = pc.split_pattern(plain, " ")
    parts, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
    if not empty.any():
        return parts, n
    owner = np.repeat(np.arange(len(n)), n)
    last = np.zeros(len(empty), dtype=bool)
    last[np.cumsum(n)[n > 0] - 1] = True
    none = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)[owner]
    ends = (~empty | last) & ~none  # an empty part is one more mark of the unit that ends next
    before = np.cumsum(empty) - empty
    at = np.flatnonzero(ends)
    begins = np.concatenate(([True], (ends | none)[:-1]))
    own = np.maximum.accumulate(np.where(begins, np.arange(len(empty)), 0))
    marks = before[at] - before[own[at]]
    out = parts.filter(pa.array(ends))
    more = marks > 0
    if more.any():
        joined = pc.binary_join_element_wise(pc.binary_repeat(pa.scalar(MARK), pa.array(marks[more])), out.filter(pa.array(more)), "")
        out = pc.replace_with_mask(out, pa.array(more), joined)
    return out, np.bincount(owner[at], minlength=len(n))


def encode(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, their number in each text)."""
    flat, n = units(texts)
    coded = flat.dictionary_encode()
    ids, count = match([MARK + u for u in coded.dictionary.to_pylist()], v)
    row = coded.indices.to_numpy(zero_copy_only=False)
    size = count[row]
    total = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
    return ids[ragged((np.cumsum(count) - count)[row], size)], np.diff(total)


def decode(ids: np.ndarray, n: np.ndarray, v: Vocabulary) -> pa.Array:
    """The texts of n[0], n[1], ... ids each."""
    size = v.size[ids]
    raw = v.bytes[ragged(v.begin[ids], size)]
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
    drop = ends[:-1][(np.diff(ends) > 0) & (np.append(raw, 0)[ends[:-1]] == 32)]  # the mark in front
    keep = np.ones(len(raw), dtype=bool)
    keep[drop] = False
    ends = ends - np.searchsorted(drop, ends)
    texts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[keep])])
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "ids", back: str | None = None) -> DataFrame:
    """docs with the piece ids of text and, if back is given, with the text that they decode to."""
    names = docs.columns
    at = names.index(text)
    into = fresh(into, names)
    back = back and fresh(back, [*names, into])
    local: list[Vocabulary] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not local:
            local.append(Vocabulary(path))
        for b in batches:
            for part in slices(b, at, SLICE):
                ids, n = encode(part.column(at), local[0])
                made = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids))]
                if back:
                    made.append(decode(ids, n, local[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*names, into, *([back] if back else [])])

    fields = [StructField(into, ArrayType(IntegerType())), *([StructField(back, StringType())] if back else [])]
    return positional(docs).mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def decoded(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of its piece ids; null ids decode to the empty text."""
    names = docs.columns
    at = names.index(ids)
    into = fresh(into, names)
    local: list[Vocabulary] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not local:
            local.append(Vocabulary(path))
        for b in batches:
            for from_ in range(0, b.num_rows, 500):
                part = b.slice(from_, 500)
                n = pc.fill_null(part.column(at).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decode(part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64), n, local[0])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*names, into])

    return positional(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(into, StringType())]))


def op10_pieces(docs: DataFrame, path: str) -> DataFrame:
    """Per document: its number of pieces, a hash of them, and whether decoding gives the text back."""
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = encoded(rows, path, back="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "text_crc32",
        (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"),
    )
