"""Names within texts: an automaton of all names reads each text once, and no part of a text is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalize_alias, normalized_alias

#: Names, and characters of all names together, that go to the texts at most; beyond that grams meet them by a shuffle.
MANY, LETTERS = 50_000, 2_000_000


def fits(names: DataFrame) -> bool:
    """Whether the names (key) may be sent to every task. Runs a job that counts them."""
    n, letters = names.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    return n <= MANY and letters <= LETTERS


def found(texts: DataFrame, names: DataFrame, fold: bool = True, gram: int = 1, cap: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, *names' columns): each row of names (key, ...) whose key stands in the text, longest keys first, at most `cap` a text.

    texts: (text_id, text), each row a text of its own; with fold, texts are compared as names are normalised. Ties in length go
    by key, then by order. Keys shorter than gram, and null texts, match nothing. Acts: the names are counted, and if they
    fit, collected; beyond that, the text's grams are joined with the keys' first ones and containment is checked.
    """
    names = names.filter(F.length("key") >= gram)
    cols = names.columns
    if fits(names):
        rows = sorted(names.collect(), key=lambda r: (-len(r["key"]), r["key"], *(r[c] for c in order)))
        at = texts.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_at int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema))
        hits = texts.select("text_id", F.explode(_reader(texts, [r["key"] for r in rows], fold, cap)("text")).alias("_at"))
        return hits.join(F.broadcast(at), "_at").select("text_id", *cols)
    t = texts.select(F.monotonically_increasing_id().alias("_row"), "text_id", (normalized_alias("text") if fold else F.col("text")).alias("_t")).filter(F.length("_t") >= gram)
    starts = F.transform(F.sequence(F.lit(1), F.length("_t") - gram + 1), lambda i: F.substring(F.col("_t"), i, F.lit(gram)))
    hits = t.withColumn("_g", F.explode(F.array_distinct(starts))).join(names.withColumn("_g", F.substring("key", 1, gram)), "_g").filter(F.contains("_t", "key"))
    if cap is None:
        return hits.select("text_id", *cols)
    best = F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("_long"), "key", *order, *[c for c in cols if c not in ("key", *order)])))
    few = hits.groupBy("_row").agg(F.first("text_id").alias("text_id"), F.slice(best, 1, cap).alias("_n"))
    return few.select("text_id", F.explode("_n").alias("_n")).select("text_id", *[f"_n.{c}" for c in cols])


def _reader(texts: DataFrame, keys: list[str], fold: bool, cap: int | None):
    """A function text -> places in keys (sorted, repeats possible) of those that it holds, in order, the first `cap` of them."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    @F.pandas_udf("array<int>")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spots: dict[str, list[int]] = {}
        for i, key in enumerate(shared.value):
            spots.setdefault(key, []).append(i)
        machine = ahocorasick.Automaton()
        for key, own in spots.items():
            machine.add_word(key, own)
        if spots:
            machine.make_automaton()

        def one(text: str | None) -> list[int]:
            if not text or not spots:
                return []
            seen = {own[0]: own for _, own in machine.iter(normalize_alias(text) if fold else text)}
            return sorted(i for own in seen.values() for i in own)[:cap]

        for part in parts:
            yield part.map(one)

    return read
