"""Cross-tokenizer alignment by a dictionary of groups.

A text is cut where tokens of both tokenizers end at one byte: the groups. Two tokens are linked where their bytes
overlap, which only happens inside a group, and a group's links follow from its ids alone. So each task interns its
different groups, expands the links of each once, and keeps a document as group keys with frequencies. The corpus-wide
counts are summed from the tasks' own counts of documents by pair of ids; a group's links, best links and sum of counts
are computed once for each group of the merged dictionary and multiplied by the frequencies. The groups that most
documents hold (``HOT`` of them) reach the documents as a broadcast table, all others by a join on the group's key, in
which no key is frequent any more.

Encoding is cached by unit: a text is cut before each space or line end behind a letter, digit or other printable ASCII
character. Neither tokenizer joins anything across such a place (the first splits at white space, the second has no
piece with a space mark or a line end behind another character, which is checked), so units are encoded apart, and both
tokenizers' tokens end there.

Defined cases: null and empty texts, and texts of which a tokenizer does not give back every byte (a space mark inside
a text, say), have no tokens: zeros, and an empty text in place of a digest. Every row is a document of its own:
repeated rows count each and get equal results. Very long texts are encoded whole; a unit of over ``KEEP`` characters is
not remembered. Strings of special tokens are ordinary text. Two different groups with one 64-bit key stop the run with an
error instead of mixing their links. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ragged, saved, slices

#: Groups in the broadcast table (32 bytes each).
HOT = 50_000
#: Units that a worker remembers before it forgets the rarer half, the longest of them, and groups before it starts anew.
UNITS, KEEP, GROUPS = 150_000, 64, 150_000
#: Units whose groups are found together, and that are encoded as one run.
BATCH, RUN = 8000, 64
#: A place between units: behind a printable ASCII character, letter or digit, before a space or a line end.
CUT = re.compile(r"(?<=[!-~\w])(?=[ \n])")
SAFE_END = re.compile(r"[!-~\w]\Z")
#: Pairs of ids are one number, the first tokenizer's id in front.
SHIFT = 32


class Grown:
    """An array that grows at its end."""

    def __init__(self) -> None:
        self.data, self.size = np.zeros(1024, dtype=np.int64), 0

    def extend(self, values: np.ndarray | list[int]) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(end, dtype=np.int64)])
        self.data[self.size : end] = values
        self.size = end

    @property
    def view(self) -> np.ndarray:
        return self.data[: self.size]


class Ragged:
    """Lists of numbers, one behind the other."""

    def __init__(self) -> None:
        self.flat, self.ends = Grown(), Grown()

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.ends.extend(self.flat.size + np.cumsum(sizes))
        self.flat.extend(values)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the lists `which`, how many of each)."""
        ends = self.ends.view
        start = np.where(which > 0, ends[which - 1], 0)
        n = ends[which] - start
        return self.flat.view[ragged(start, n)], n


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in
    order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Bytes:
    """The bytes of a vocabulary's tokens, by id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[ids], self.size[ids])]


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads have caches and memory of their own
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        table, vocabulary = byte_table(), self.a.get_vocab()
        found = [b""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            found[i] = bytes(table.get(c, 0) for c in text)
        self.bytes_a = Bytes(found)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        text = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = Bytes([bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(text)])
        if any("▁" in t.lstrip("▁") or "\n" in t for t in text):
            raise ValueError("a piece spans two units")
        self.front = self.b.encode("\n")  # the mark put before each text, and a line end

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the first, how many for each unit, ids of the second, how many, whether the unit lost its bytes and so its ids).

        Units are encoded as runs, one behind the other as in a text; those of a run that loses bytes or has a token across
        units are encoded apart. Only a run's last unit may end otherwise than units within a text do.
        """
        size = np.array([len(u.encode()) for u in units])
        last = np.array([SAFE_END.search(u) is None for u in units])
        last[RUN - 1 :: RUN] = last[-1] = True
        to = np.flatnonzero(last) + 1
        n = np.diff(to, prepend=0)
        x, n_x, y, n_y, lost = self.apart(["".join(units[b - k : b]) for b, k in zip(to.tolist(), n.tolist())])
        run = np.repeat(np.arange(len(to)), n)
        ends, across = np.cumsum(size[~lost[run]]), np.zeros(len(to), dtype=bool)
        for ids, table in ((x, self.bytes_a), (y, self.bytes_b)):
            across[run[~lost[run]][~np.isin(ends, np.cumsum(table.size[ids]))]] = True
        odd = (lost | across)[run]
        if across.any():
            x, y = x[~np.repeat(across, n_x)], y[~np.repeat(across, n_y)]
        ends, alone, out = np.cumsum(size[~odd]), self.apart([units[i] for i in np.flatnonzero(odd).tolist()]) if odd.any() else None, []
        for k, (ids, table) in enumerate(((x, self.bytes_a), (y, self.bytes_b))):
            count = np.zeros(len(units), dtype=np.int64)
            count[~odd] = np.diff(np.searchsorted(np.cumsum(table.size[ids]), ends, side="right"), prepend=0)
            if alone is not None:
                count[odd] = alone[2 * k + 1]
                of, both = np.repeat(odd, count), np.empty(count.sum(), dtype=np.int64)
                both[of], both[~of] = alone[2 * k], ids
                ids = both
            out += [ids, count]
        bad = np.zeros(len(units), dtype=bool)
        if alone is not None:
            bad[odd] = alone[4]
        return out[0], out[1], out[2], out[3], bad

    def apart(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same, each of units by itself."""
        k = len(self.front)
        first = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        second = self.b.encode(["\n" + u for u in units], num_threads=1)
        raw = [u.encode() for u in units]
        size = np.array([len(r) for r in raw])
        lost = np.array([y[:k] != self.front for y in second])
        x, n_x = joined(first)
        y, n_y = joined([y[k:] for y in second])
        unit = np.arange(len(units))
        for ids, n, table in ((x, n_x, self.bytes_a), (y, n_y, self.bytes_b)):
            lost |= np.bincount(np.repeat(unit, n), weights=table.size[ids], minlength=len(units)) != size
        whole = np.frombuffer(b"".join(r for r, bad in zip(raw, lost) if not bad), dtype=np.uint8)
        owner = np.repeat(unit[~lost], size[~lost])
        for ids, n, table in ((x, n_x, self.bytes_a), (y, n_y, self.bytes_b)):
            lost[owner[table.of(ids[np.repeat(~lost, n)]) != whole]] = True  # before this, lost units only lack what owner lacks
            if lost[owner].any():
                keep = ~lost[owner]
                whole, owner = whole[keep], owner[keep]
        x, y = x[np.repeat(~lost, n_x)], y[np.repeat(~lost, n_y)]
        return x, np.where(lost, 0, n_x), y, np.where(lost, 0, n_y), lost


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=n.sum()), n


class Groups:
    """Groups of a run of texts, one behind the other: ``rows`` has each group's ids, -1 between the two tokenizers'."""

    def __init__(self, pair: Pair, x: np.ndarray, y: np.ndarray) -> None:
        end_x, end_y = np.cumsum(pair.bytes_a.size[x]), np.cumsum(pair.bytes_b.size[y])
        self.ends = np.intersect1d(end_x, end_y, assume_unique=True)
        of_x, of_y = np.searchsorted(self.ends, end_x), np.searchsorted(self.ends, end_y)
        m = len(self.ends)
        n_x, n_y = np.bincount(of_x, minlength=m), np.bincount(of_y, minlength=m)
        self.size = n_x + n_y + 1
        self.start = np.cumsum(self.size) - self.size
        self.rows = np.full(self.size.sum(), -1, dtype=np.int32)
        self.rows[ragged(self.start, n_x)] = x
        self.rows[ragged(self.start + n_x + 1, n_y)] = y
        # two tokens overlap between two neighbouring ends, of whichever tokenizer, and nowhere else
        steps = np.union1d(end_x, end_y)
        self.links = x[np.searchsorted(end_x, steps)] << SHIFT | y[np.searchsorted(end_y, steps)]
        self.link_ends = np.searchsorted(steps, self.ends) + 1

    def kinds(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(groups, which of the first ones each equals, those first ones), by the groups' length."""
        order = np.argsort(self.size, kind="stable")
        cuts = np.flatnonzero(np.diff(self.size[order])) + 1
        for which in np.split(order, cuts):
            if len(which):
                k = int(self.size[which[0]])
                wide = np.ascontiguousarray(self.rows[ragged(self.start[which], self.size[which])]).view(np.dtype((np.void, 4 * k)))
                _, first, back = np.unique(wide, return_index=True, return_inverse=True)
                yield which, back, which[first]


class Interned:
    """Units and groups by local numbers."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.units, self.keys, self.ids = pair, {}, {}, {}
        self.text: list[str] = []
        self.names: list[str] = []
        self.sizes, self.unit_groups, self.group_links = [Grown() for _ in range(4)], Ragged(), Ragged()
        self.group_ids, self.pairs = Grown(), Grown()
        self.long: list[str] = []
        self.hits = Grown()  # of each unit lately

    def add(self, units: list[str]) -> None:
        """Numbers new units. A unit is written without its space if that is followed by another character."""
        texts = [u if u[0] in " \n" else " " + u for u in units]
        x, n_x, y, n_y, lost = self.pair.encoded(texts)
        found = Groups(self.pair, x, y)
        number = np.zeros(len(found.ends), dtype=np.int64)
        for which, back, first in found.kinds():
            number[which] = np.array([self.group(found, int(i)) for i in first])[back]
        # a unit's bytes end where a group does
        last = np.cumsum(np.bincount(np.repeat(np.arange(len(units)), n_x), weights=self.pair.bytes_a.size[x], minlength=len(units)).astype(np.int64))
        to = np.searchsorted(found.ends, last, side="right")
        groups = np.diff(to, prepend=0)
        self.units.update(zip(units, range(len(self.text), len(self.text) + len(units))))
        self.long += [u for u in units if len(u) > KEEP]
        own, names, at = number.tolist(), self.names, 0
        for end in to.tolist():
            self.text.append(";".join([names[g] for g in own[at:end]]))
            at = end
        self.unit_groups.append(number, groups)
        for to, value in zip((*self.sizes, self.hits), (n_x, n_y, groups, lost, np.zeros(len(units), dtype=np.int64))):
            to.extend(value)

    def group(self, found: Groups, i: int) -> int:
        """The number of a group."""
        row = found.rows[found.start[i] : found.start[i] + found.size[i]]
        key = row.tobytes()
        n = self.keys.get(key)
        if n is None:
            n = self.keys[key] = len(self.keys)
            name = ",".join(map(str, row.tolist())).replace(",-1,", "|")
            links = found.links[found.link_ends[i - 1] if i else 0 : found.link_ends[i]].tolist()
            self.group_links.append(np.array([self.number(p) for p in links]), np.array([len(links)]))
            self.group_ids.extend([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)])
            self.names.append(name)
        return n

    def forget_long(self) -> None:
        """Long units are looked up in their own slice alone."""
        for u in self.long:
            self.text[self.units.pop(u)] = ""
        self.long = []

    def forget_rare(self) -> None:
        """Keeps the units met most often, half of UNITS at most, and those met twice at least. Groups and pairs stay, so do their numbers."""
        numbers = np.fromiter(self.units.values(), dtype=np.int64, count=len(self.units))
        hits = self.hits.view[numbers]
        best = np.argsort(-hits, kind="stable")[: UNITS // 2]
        best = np.sort(best[hits[best] > 1])
        old = numbers[best]
        names = list(self.units)
        self.units = {names[i]: n for n, i in enumerate(best.tolist())}
        self.text = [self.text[i] for i in old.tolist()]
        sizes, hits, lists = [s.view[old] for s in self.sizes], self.hits.view[old] // 2, self.unit_groups.of(old)
        self.sizes, self.hits, self.unit_groups = [Grown() for _ in range(4)], Grown(), Ragged()
        self.unit_groups.append(*lists)
        for to, value in zip((*self.sizes, self.hits), (*sizes, hits)):
            to.extend(value)

    def number(self, pair: int) -> int:
        n = self.ids.get(pair)
        if n is None:
            n = self.ids[pair] = len(self.ids)
            self.pairs.extend([pair])
        return n


def units(text: str) -> list[str]:
    """The units of a space and text; one that is a space and a further character comes without the space."""
    found = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
    if all(map(SAFE_END.search, set(found))):
        return found
    return [u[1:] if u[0] == " " and u[1:2] not in (" ", "\n", "") else u for u in CUT.split(" " + text)]


class Task:
    """What one task has seen of the groups and pairs of its tables."""

    def __init__(self, tables: Interned) -> None:
        self.tables = tables
        self.group_docs, self.pair_docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def slice(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of both and groups of each text, digests, groups in order, their frequencies, how many groups each text has)."""
        t = self.tables
        found = [units(x) if x else [] for x in texts]
        new = list(set().union(*found).difference(t.units))
        for at in range(0, len(new), BATCH):
            t.add(new[at : at + BATCH])
        numbers = [list(map(t.units.__getitem__, x)) for x in found]
        del found
        n = np.array([len(x) for x in numbers])
        u = np.fromiter(chain.from_iterable(numbers), dtype=np.int64, count=n.sum())
        doc = np.repeat(np.arange(len(texts)), n)
        bad = np.zeros(len(texts), dtype=bool)
        bad[doc[t.sizes[3].view[u] > 0]] = True
        digests = [hashlib.sha256(";".join(map(t.text.__getitem__, x)).encode()).hexdigest() if x and not b else "" for x, b in zip(numbers, bad)]
        u, doc = u[~bad[doc]], doc[~bad[doc]]
        counts = np.stack([np.bincount(doc, weights=s.view[u], minlength=len(texts)).astype(np.int64) for s in t.sizes[:3]])
        t.hits.view[:] += np.bincount(u, minlength=len(t.text))
        kinds, times = np.unique(doc * len(t.text) + u, return_counts=True)
        doc, u = kinds // len(t.text), kinds % len(t.text)
        group, k = t.unit_groups.of(u)
        key = np.repeat(doc, k) * (len(t.keys) + 1) + group
        kinds, back = np.unique(key, return_inverse=True)
        freq = np.bincount(back, weights=np.repeat(times, k), minlength=len(kinds)).astype(np.int64)
        doc, group = kinds // (len(t.keys) + 1), kinds % (len(t.keys) + 1)
        pair, k = t.group_links.of(group)
        held = np.unique(np.repeat(doc, k) * (len(t.ids) + 1) + pair) % (len(t.ids) + 1)
        self.group_docs = self.plus(self.group_docs, group, len(t.keys))
        self.pair_docs = self.plus(self.pair_docs, held, len(t.ids))
        return counts, digests, t.group_ids.view[group], freq, np.bincount(doc, minlength=len(texts))

    @staticmethod
    def plus(had: np.ndarray, seen: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(seen, minlength=size)
        out[: len(had)] += had
        return out

    def parts(self, rows: int = 20_000) -> Iterator[tuple[str, dict]]:
        """What to tell of groups and pairs, and nothing seen any more."""
        t = self.tables
        for seen, kind in ((np.flatnonzero(self.group_docs), "group"), (np.flatnonzero(self.pair_docs), "pair")):
            for at in range(0, len(seen), rows):
                which = seen[at : at + rows]
                if kind == "group":
                    link, n = t.group_links.of(which)
                    yield kind, {"gid": t.group_ids.view[which], "gkey": [t.names[i] for i in which], "docs": self.group_docs[which], "links": listed(t.pairs.view[link], n)}
                else:
                    yield kind, {"pair": t.pairs.view[which], "docs": self.pair_docs[which]}
        self.group_docs, self.pair_docs = self.group_docs[:0], self.pair_docs[:0]


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


#: A worker's tokenizers, by their paths.
_own: dict[tuple[str, str], Interned] = {}
_SCHEMA = "kind string, row long, n_a long, n_b long, n_groups long, groups_sha256 string, gids array<long>, freqs array<long>, gid long, gkey string, links array<long>, pair long, docs long"


def interned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document, for each task's different groups, and for its pairs of ids; `kind` tells which."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{_SCHEMA}, doc {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(what: str, columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array([what] * n) if f.name == "kind" else pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in target], schema=target)

        paths, task, row = (path_a, path_b), None, TaskContext.get().partitionId() << SHIFT
        for whole in batches:
            target = pa.schema([*fixed, pa.field("doc", whole.schema.field(0).type)])
            for b in slices(whole, 1):
                if task is None or len(task.tables.names) > GROUPS:
                    if task is not None:
                        yield from (batch(*x) for x in task.parts())
                    if paths not in _own or len(_own[paths].names) > GROUPS:
                        _own[paths] = Interned(_own[paths].pair if paths in _own else Pair(*paths))
                    task = Task(_own[paths])
                counts, digests, gids, freqs, n = task.slice(b.column(1).to_pylist())
                task.tables.forget_long()
                if len(task.tables.text) > UNITS:
                    task.tables.forget_rare()
                yield batch("doc", {"row": np.arange(row, row + b.num_rows), "n_a": counts[0], "n_b": counts[1], "n_groups": counts[2], "groups_sha256": digests, "gids": listed(gids, n), "freqs": listed(freqs, n), "doc": b.column(0)})
                row += b.num_rows
        if task is not None:
            yield from (batch(*x) for x in task.parts())

    number, numbers = pa.int64(), pa.list_(pa.int64())
    kinds = {"kind": pa.string(), "groups_sha256": pa.string(), "gkey": pa.string(), "gids": numbers, "freqs": numbers, "links": numbers}
    fixed = [pa.field(x.split()[0], kinds.get(x.split()[0], number)) for x in _SCHEMA.split(", ")]
    return docs.select(key, text).mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair of ids is linked, and whether no pair of its first id is in more."""
    pairs = found.filter("kind = 'pair'").groupBy("pair").agg(F.sum("docs").alias("n"))
    top = pairs.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("top"))  # a row for each id of the vocabulary at most
    return pairs.join(F.broadcast(top), F.shiftright("pair", SHIFT) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def links(found: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best) of every pair of ids that is linked anywhere; found as interned() gives it."""
    return pair_counts(found).select(F.shiftright("pair", SHIFT).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int").alias("b_id"), "n", "best")


def dictionary(found: DataFrame) -> DataFrame:
    """(gid, docs, n_links, n_best, count_sum) of every different group."""
    merged = found.filter("kind = 'group'").groupBy("gid").agg(F.sum("docs").alias("docs"), F.min("gkey").alias("lo"), F.max("gkey").alias("hi"), F.first("links").alias("links"))
    whole = merged.withColumn("links", F.when(F.col("lo") == F.col("hi"), F.col("links")).otherwise(F.raise_error(F.lit("two groups share a key"))))
    each = whole.select("gid", "docs", F.explode("links").alias("pair")).join(pair_counts(found), "pair")
    return each.groupBy("gid", "docs").agg(F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))


SUMS = ["n_links", "n_best", "count_sum"]


def scored(found: DataFrame, groups: DataFrame, hot: int = HOT) -> DataFrame:
    """Every document's figures; groups as dictionary() gives them, stored."""
    spark = found.sparkSession
    most = groups.orderBy(F.desc("docs"), "gid").limit(hot).toPandas().sort_values("gid")  # `hot` rows at most
    table = spark.sparkContext.broadcast((most["gid"].to_numpy(), most[SUMS].to_numpy(dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = table.value
        for b in batches:
            gids, freqs = b.column(1), b.column(2)
            g, f, n = (x.to_numpy(zero_copy_only=False) for x in (gids.flatten(), freqs.flatten(), gids.value_lengths()))
            doc = np.repeat(np.arange(b.num_rows), n)
            at = np.minimum(np.searchsorted(ids, g), max(len(ids) - 1, 0))
            known = ids[at] == g if len(ids) else np.zeros(len(g), dtype=bool)
            sums = np.zeros((b.num_rows, len(SUMS)), dtype=np.int64)
            np.add.at(sums, doc[known], values[at[known]] * f[known, None])
            left = np.bincount(doc[~known], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in sums.T), listed(g[~known], left), listed(f[~known], left)], names=["row", *SUMS, "gids", "freqs"])

    docs = found.filter("kind = 'doc'")
    first = saved(docs.select("row", "gids", "freqs").mapInArrow(run, f"row long, {', '.join(f'{c} long' for c in SUMS)}, gids array<long>, freqs array<long>"), "alignment-docs")
    rare = first.filter(F.size("gids") > 0).select("row", F.explode(F.arrays_zip("gids", "freqs")).alias("x")).select("row", F.col("x.gids").alias("gid"), F.col("x.freqs").alias("freq"))
    joined = rare.join(groups, "gid").select("row", *[(F.col(c) * F.col("freq")).alias(c) for c in SUMS])
    sums = first.select("row", *SUMS).unionByName(joined).groupBy("row").agg(*[F.sum(c).alias(c) for c in SUMS])
    return docs.select("row", "doc", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row").drop("row")


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(key, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum) of each row. Runs jobs: stores what it interned, then the dictionary."""
    found = saved(interned(docs, path_a, path_b, key), "alignment")
    out = scored(found, saved(dictionary(found), "alignment-groups"), hot)
    return out.withColumnRenamed("doc", fresh(key, [c for c in out.columns if c != "doc"]))


def op11_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return aligned(docs, path_a, path_b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
