"""Line dedup: hashes in ranges, sorted by document and position, streamed once; keep bitmaps come back instead of text.

A line's key is the line without white space at its ends, A-Z in lower case; 128 bits of it stand for it. A document
sends each of its different keys once, with the lines' positions. The keys are dealt into ranges of (key, document), so
a key that a third of all documents hold fills several ranges, and are sorted within them. Each range is streamed: a
run of one key is known to be frequent as soon as ``min_docs`` documents have passed, so no more than those wait. A run that
touches the range's start or end may go on next door: its rows are passed on undecided, beside its number of documents
and its first and last one. These are two runs a range at most, merged by a small aggregate; then the rows that
must go are gathered as one compressed bitmap for each text. Texts with no such line have no bitmap and keep every line.

Defined cases: a null or empty text is one empty line; blank lines have no key and always stay; documents are told by their
id, so repeated rows of one id count once (null ids are one document too) and get equal results; rows of one id with
different texts are judged line by line each; ``keep_first`` spares the first occurrence, by id (null first), text hash
and position; a text whose lines all go becomes empty; very long texts are taken whole; an empty table gives an empty
result. Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, saved, slices

#: The contract's number of documents from which a line is repeated.
MIN_DOCS = 10
#: Rows of keys in a range, on average.
RANGE_ROWS = 2_000_000


def keys(lines: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.utf8_trim(lines, SPACE_CHARS))


def text_hash(text: Column | str) -> Column:
    """Tells the texts of one id apart; null and empty texts are equal."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def once(b: pa.RecordBatch) -> pa.RecordBatch:
    """b without rows whose key and text hash came before."""
    first = dict(zip(zip(reversed(b.column(0).to_pylist()), reversed(b.column(1).to_pylist())), range(b.num_rows - 1, -1, -1)))
    return b if len(first) == b.num_rows else b.take(pa.array(sorted(first.values())))


def line_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, lo, doc, th, at): each document's different keys and the positions of their lines, ascending, as 32-bit numbers."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (once(part) for whole in batches for part in slices(whole, 2)):
            lists = pc.split_pattern(b.column(2), "\n")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            line = keys(lists.flatten())
            some = pc.greater(pc.binary_length(line), 0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), n)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            digests = b"".join([xxhash.xxh3_128_digest(x) for x in line.filter(pa.array(some)).cast(pa.binary()).to_pylist()])
            h = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            doc, at = doc[some], at[some].astype(np.int32)
            order = np.lexsort((at, h[:, 1], h[:, 0], doc))
            doc, at, h = doc[order], at[order], h[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (np.diff(doc) != 0) | (np.diff(h[:, 0]) != 0) | (np.diff(h[:, 1]) != 0)
            first = np.flatnonzero(new)
            cuts = np.append(first, len(doc)) * 4
            positions = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(at.tobytes())])
            which = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([pa.array(h[first, 0]), pa.array(h[first, 1]), b.column(0).take(which), b.column(1).take(which), positions], names=["hi", "lo", "doc", "th", "at"])

    rows = docs.select(F.col(key).alias("k"), text_hash(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.length("t") > 0)
    return rows.mapInArrow(run, f"hi long, lo long, doc {kind}, th long, at binary")


def changed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where a column differs from the row before; null equals null, and the first row differs."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] = pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


_MORE = [pa.field("sure", pa.bool_()), pa.field("docs", pa.int64())]


def streamed(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted, in; out come rows to drop (sure; docs is -1 in the range's first run), rows of an edge's run that
    is not frequent by itself (not sure), and for each edge's run its number of documents (min_docs if frequent) with its
    first row's document. keep_first spares the first occurrence where the run is not the range's first."""
    wait: pa.RecordBatch | None = None  # rows of the open run, until it ends or is frequent
    head, known, first = None, False, True  # the open run's first row; whether it is frequent; whether no run has ended yet

    def rows(b: pa.RecordBatch, sure: bool, own: np.ndarray | int = 0) -> pa.RecordBatch:
        docs = np.zeros(b.num_rows, dtype=np.int64) + own
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, sure)), pa.array(docs)], schema=pa.schema([*b.schema, *_MORE]))

    def total(row: pa.RecordBatch, docs: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*row.columns[:4], pa.nulls(1, row.schema.field(4).type), pa.array([False]), pa.array([docs])], schema=pa.schema([*row.schema, *_MORE]))

    before = None
    for b in batches:
        if b.num_rows:  # repeated rows lie one behind the other
            new = np.logical_or.reduce([changed(b.column(i)) for i in range(4)])
            new[0] = before is None or any(b.column(i)[0] != before.column(i)[0] for i in range(4))
            before, b = b.slice(b.num_rows - 1), b.filter(pa.array(new))
        if not b.num_rows:
            continue
        if wait is not None:
            b = pa.Table.from_batches([wait, b]).combine_chunks().to_batches()[0]
        run = changed(b.column(0)) | changed(b.column(1))
        goes_on = known and all(b.column(i)[0] == head.column(i)[0] for i in (0, 1))
        if known and not goes_on:
            if first:
                yield total(head, min_docs)
            first = False
        b_rows, start = b.num_rows, np.flatnonzero(run)
        size = np.diff(np.append(start, b_rows))
        docs = np.add.reduceat((run | changed(b.column(2))).astype(np.int64), start)
        often = docs >= min_docs
        often[0] |= goes_on
        drop = np.repeat(often, size)
        if first and len(start) > 1:  # the range's first run has ended
            if not often[0]:
                yield rows(b.slice(0, size[0]), False)
            yield total(b.slice(0, 1) if not goes_on else head, int(docs[0]) if not goes_on else min_docs)
        if drop.any():
            out = b.filter(pa.array(drop))
            if keep_first:  # a run that begins here has its first occurrence here; the range's first run may begin next door
                inner = often.copy()
                inner[0] &= not first and not goes_on
                out = spared(out, np.repeat(inner, size)[drop] & run[drop])
            yield rows(out, True, -((np.arange(b_rows) < size[0]) & first)[drop].astype(np.int64))
        first = first and len(start) == 1
        if not (goes_on and len(start) == 1):
            head = b.slice(int(start[-1]), 1)
        known = bool(often[-1])
        wait = None if known else b.slice(int(start[-1]))
    if wait is not None:
        yield rows(wait, False)
        yield total(head, int(changed(wait.column(2)).sum()))
    elif known:
        yield total(head, min_docs)


def spared(b: pa.RecordBatch, which: np.ndarray) -> pa.RecordBatch:
    """b without the first position of the rows `which`."""
    at = [x[4:] if w else x for x, w in zip(b.column(4).to_pylist(), which)]
    return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(at, b.schema.field(4).type)], schema=b.schema)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc, th, at): positions of lines to drop, a row for each document and key. Runs jobs: the keys and the streams' rows are stored."""
    lines = saved(line_keys(docs, key, text), "line-keys")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // RANGE_ROWS))
    ranges = lines.repartitionByRange(n, "hi", "lo", "doc").sortWithinPartitions("hi", "lo", "doc", "th")
    schema = ", ".join(f"{c} {t}" for c, t in lines.dtypes)
    found = saved(ranges.mapInArrow(lambda it: streamed(it, min_docs, keep_first), f"{schema}, sure boolean, docs long"), "line-runs")
    edges = found.filter("docs > 0").groupBy("hi", "lo").agg(F.sum("docs").alias("n"), F.min(F.struct("doc", "th")).alias("first")).filter(F.col("n") >= min_docs)
    rows = found.filter("docs <= 0")
    out = rows.filter("sure").unionByName(rows.filter("not sure").join(edges.select("hi", "lo"), ["hi", "lo"], "left_semi"))
    if keep_first:
        firsts = edges.select("hi", "lo", F.col("first.doc").alias("_doc"), F.col("first.th").alias("_th"))  # two rows for each range at most
        mine = (out["hi"] == firsts["hi"]) & (out["lo"] == firsts["lo"]) & out["doc"].eqNullSafe(firsts["_doc"]) & (out["th"] == firsts["_th"]) & (~out["sure"] | (out["docs"] < 0))
        out = out.join(firsts, mine, "left").select("doc", out["th"], F.when(F.col("_th").isNotNull(), F.expr("substring(at, 5)")).otherwise(F.col("at")).alias("at"))
    return out.select("doc", "th", "at").filter(F.length("at") > 0)


def bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc, th, keep) of every text that loses a line: a bit for each line, 1 if it stays, compressed; lines behind the last bit stay."""
    rows = repeated(docs, key, text, min_docs, keep_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for parts in b.column(2).to_pylist():
                at = np.frombuffer(b"".join(parts), dtype=np.int32)
                bits = np.ones(at.max() + 1, dtype=bool)
                bits[at] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes() + bytes([-len(bits) % 8]), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["doc", "th", "keep"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.groupBy("doc", "th").agg(F.collect_set("at").alias("at")).mapInArrow(run, f"doc {kind}, th long, keep binary")


def unpacked(keep: bytes | None) -> np.ndarray:
    """A bitmap's bits; none for a text without one."""
    if not keep:
        return np.ones(0, dtype=bool)
    raw = zlib.decompress(keep)
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=len(raw) - 1), count=8 * (len(raw) - 1) - raw[-1]).astype(bool)


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """(text of the lines that stay, lines before, lines dropped)."""
    lines, bits = (text or "").split("\n"), unpacked(keep)
    if not len(bits):
        return text or "", len(lines), 0
    some = [x for x, b in zip(lines, bits) if b] + lines[len(bits) :]
    return "\n".join(some), len(lines), len(lines) - len(some)


def applied(docs: DataFrame, maps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text of the lines that stay, n_lines, n_dropped, kept_sha256) of each row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", text_hash("t"))
    met = rows.join(maps, F.col("k").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("th")), "left").select("k", "t", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            texts, n, gone = zip(*map(kept_text, b.column(1).to_pylist(), b.column(2).to_pylist()))
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)], names=["k", "t", "n", "g", "s"])

    out = met.mapInArrow(run, f"k {kind}, t string, n long, g long, s string")
    return out.toDF(key, text, "n_lines", "n_dropped", "kept_sha256")


def op12_linededup(docs: DataFrame) -> DataFrame:
    return applied(docs, bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
