"""What the operators share: reading, scratch tables and word rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, run, saved, scratch_dir  # noqa: F401 - the operators take them from here

#: The white space that separates words, as a regular expression class and as characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of text; empty for null and for white space alone.

    Splitting at one plain character avoids the regular expression engine.
    """
    t = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS[1:]:
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def nullable_key(col: Column) -> Column:
    """A join key that is never null and keeps null apart from every text."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col.cast("string")))


def slices(batch: pa.RecordBatch, column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch that hold about `size` bytes of text each (a longer text comes alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. in one array."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until it differs from all those taken (as Spark compares names)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts in order, lower-cased A-Z; their number in each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    del lists
    if full.all():
        return flat, n
    return flat.filter(pa.array(full)), np.bincount(np.repeat(np.arange(len(texts)), n)[full], minlength=len(texts))


def quoted(name: str) -> str:
    """A column's name as Spark takes it literally, dots included."""
    return "`" + name.replace("`", "``") + "`"


def positional(df: DataFrame) -> DataFrame:
    """df with plain names in place of its own, for Python operators: their input is taken by position, whatever the names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
