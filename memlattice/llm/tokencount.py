"""Token counts: a broadcast table of frequent pre-token lengths, worker caches for the rest.

A text's token count is the sum of its pre-tokens' counts, as merges never cross a pre-token. The first tier is a
table of pre-tokens that are frequent in a bounded sample, broadcast as one byte string and one array of lengths.
What it misses is encoded by the tokenizer itself, each pre-token once for as long as the worker's cache holds it.
No pre-token is ever shuffled. The table only saves work: any table gives the same counts.

Normalising and splitting in Python equals the library's for text of the characters in ``PLAIN`` (Latin) and ``WIDE``
(punctuation, symbols, emoji, Cyrillic, kana, Han, Hangul); a text with any other character, such as combining marks or
letters whose lower case depends on their place, is encoded whole by the library.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens; strings of special tokens inside texts are ordinary
text; very long texts are counted whole; repeated rows count alike; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

LIMIT = 2048
#: Documents and bytes of the sample that the table comes from, and its entries.
SAMPLE_DOCS, SAMPLE_BYTES, TABLE = 600, 32768, 50_000
#: Pre-tokens a worker remembers.
CACHE = 400_000

#: Fixed values of the tokenizer's file: its split pattern, here for the characters of PLAIN alone.
_LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľŀłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
#: Printable ASCII, tab, line ends and precomposed Latin letters: stable under NFC, with one lower-case letter each.
PLAIN = re.compile(r"[\x20-\x7e\t\n\rÀ-ÖØ-öø-ķĹ-ľŁ-ňŊ-ž]*")
#: The same pattern by Unicode classes, and the further characters that are stable under NFC with one lower-case letter.
WIDE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
WIDE = re.compile(
    r"[\x20-\x7e\t\n\r\xa1-\xac\xae-\xb4\xb6-ķĹ-ľŁ-ňŊ-žА-яЁё\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff\u2200-\u22ff\u25a0-\u26ff"
    r"\u3001-\u3003\u3008-\u3011\u3014-\u301b\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001faff]*"
)


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def pretokens(text: str) -> list[str] | None:
    """The pre-tokens of text, or None if only the library can tell."""
    if "İ" in text or "ı" in text:
        return None
    if PLAIN.fullmatch(text):
        return SPLIT.findall(text.lower())
    return WIDE_SPLIT.findall(text.lower()) if WIDE.fullmatch(text) else None


class Counts(dict):
    """Token counts by pre-token; a miss is encoded and remembered."""

    def __init__(self, path: str, table: dict[str, int]) -> None:
        super().__init__(table)
        self.path, self.table, self.encode = path, table, None

    def library(self, text: str) -> int:
        if self.encode is None:
            self.encode = tokenizer(self.path).encode
        return len(self.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        n = self.library(piece)
        if len(self) >= len(self.table) + CACHE:
            self.clear()
            self.update(self.table)
        self[piece] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        found = pretokens(text)
        return self.library(text) if found is None else sum(map(self.__getitem__, found))


def frequent(texts: list[str], path: str, size: int = TABLE) -> tuple[bytes, bytes]:
    """The table in compact form: pre-tokens joined by line ends, and a byte of length for each."""
    seen: Counter = Counter()
    for t in texts:
        seen.update((pretokens(t) if t else None) or [])
    pieces = [p for p, n in seen.most_common(size) if n > 1]
    encoded = tokenizer(path).encode_batch(pieces, add_special_tokens=False) if pieces else []
    pairs = [(p, len(e.ids)) for p, e in zip(pieces, encoded) if len(e.ids) < 256]
    return "\n".join(p for p, _ in pairs).encode(), bytes(n for _, n in pairs)


def counted(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of each row of docs."""
    rows = docs.select(key, text)
    some = rows.select(text).filter(F.octet_length(text) <= SAMPLE_BYTES).filter(F.pmod(F.xxhash64(key), F.lit(97)) == 0).limit(SAMPLE_DOCS)
    table = spark.sparkContext.broadcast(frequent([r[0] for r in some.collect()], path))  # TABLE entries at most
    local: list[Counts] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not local:
            joined, lengths = table.value
            local.append(Counts(path, dict(zip(joined.decode().split("\n"), lengths)) if lengths else {}))
        of = local[0].of
        for b in (part for whole in batches for part in slices(whole, 1)):
            n = np.fromiter((of(x) for x in b.column(1).to_pylist()), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], names=[key, "n_bytes", "n_tokens"])

    sized = rows.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    kind = docs.schema[key].dataType.simpleString()
    return sized.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")


def op5_tokens(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return counted(spark, docs, path).withColumn("over_limit", F.col("n_tokens") > LIMIT)
