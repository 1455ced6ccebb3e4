"""Outer models behind one rule: a call that fails costs its batch its vectors, or a query its new order, and never the job."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import search_text
from . import store
from .scratch import saved

#: Opens a client within a task: texts -> their vectors, in order.
Embedder = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
#: Opens a client within a task: (query, texts) -> (place in texts, score), in any order.
Reranker = Callable[[], Callable[[str, list[str]], Sequence[tuple[int, float]]]]


def _vector(raw: object, dims: int | None) -> list[float] | None:
    """raw as floats; None unless it is a list of `dims` finite numbers."""
    try:
        v = [float(x) for x in raw] if hasattr(raw, "__len__") and not isinstance(raw, (str, bytes, dict)) else None
    except (TypeError, ValueError):
        return None
    return v if v and (dims is None or len(v) == dims) and all(map(math.isfinite, v)) else None


def _tried(call: Callable[[], object], attempts: int, wait: float) -> object:
    """What call returns, or None after `attempts` failures; waits double from `wait` seconds."""
    for i in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001 - whatever an outer service raises
            if i + 1 < attempts:
                time.sleep(wait * 2**i)
    return None


def _batched(client: Callable[[list[str]], Sequence], texts: list[str | None], dims: int | None, attempts: int, wait: float) -> list[list[float] | None]:
    """The vectors of one batch. Blank texts are not sent; a failed call or an answer of the wrong length voids all of it."""
    asked = [i for i, t in enumerate(texts) if t and t.strip()]
    out: list[list[float] | None] = [None] * len(texts)
    got = _tried(lambda: client([texts[i] for i in asked]), attempts, wait) if asked else None
    if hasattr(got, "__len__") and not isinstance(got, (str, bytes, dict)) and len(got) == len(asked):
        for i, raw in zip(asked, got):
            out[i] = _vector(raw, dims)
    return out


def embedded(rows: DataFrame, client: Embedder | None, dims: int | None = None, size: int = 64, attempts: int = 1, wait: float = 0.5) -> DataFrame:
    """(id, vector) of rows (id, text): a task opens one client and sends it its rows in batches of `size`, in their order.

    Without a client all vectors are null. So are those of blank texts, of vectors that are no `dims` finite numbers, of a whole
    batch whose call failed `attempts` times or gave another number of vectors, and of a task whose client would not open.
    A task that is lost asks again: store the result before reading it twice.
    """
    kind = f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>"
    if client is None:
        return rows.select("id", F.lit(None).cast("array<double>").alias("vector"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = _tried(client, attempts, wait)
        ids: list = []
        texts: list[str | None] = []

        def send(n: int) -> pd.DataFrame:
            vectors = _batched(opened, texts[:n], dims, attempts, wait) if opened is not None else [None] * n
            out = pd.DataFrame({"id": ids[:n], "vector": pd.Series(vectors, dtype=object)})
            del ids[:n], texts[:n]
            return out

        for part in parts:
            ids += part["id"].tolist()
            texts += [t if isinstance(t, str) else None for t in part["text"]]
            while len(ids) >= size:
                yield send(size)
        if ids:
            yield send(len(ids))

    return rows.select("id", "text").mapInPandas(run, kind)


def rerank_scores(candidates: DataFrame, query: str, client: Reranker | None, attempts: int = 1, wait: float = 0.5) -> DataFrame | None:
    """(id, rerank) of a query's candidates (id, content), in the order given, or None where there is no client or its call failed.

    Places out of range and scores that are no numbers are passed over, of a place's repeats the first counts. The
    candidates are a bounded number of rows, as recall's legs give them; one task asks. Runs a job.
    """
    if client is None:
        return None
    kind = f"id {candidates.schema['id'].dataType.simpleString()}, rerank double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if not held:
            return
        all_rows = pd.concat(held, ignore_index=True)
        opened = _tried(client, attempts, wait)
        texts = [t if isinstance(t, str) else "" for t in all_rows["content"]]
        got = _tried(lambda: opened(query, texts), attempts, wait) if opened is not None and texts else None
        scores: dict[int, float] = {}
        try:
            for place, score in got or ():
                if 0 <= int(place) < len(texts) and math.isfinite(float(score)):
                    scores.setdefault(int(place), float(score))
        except (TypeError, ValueError):
            scores = {}
        yield pd.DataFrame({"id": [all_rows["id"].iloc[i] for i in scores], "rerank": list(scores.values())})

    out = saved(candidates.select("id", "content").coalesce(1).mapInPandas(run, kind), "rerank")
    return None if out.isEmpty() else out


def filled(tables: dict[str, DataFrame], client: Embedder | None, dims: int | None = None, limit: int | None = 64, size: int = 64, attempts: int = 1, wait: float = 0.5) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, (name, asked, got)) after one round over summary, fact and cluster: their first `limit` rows without a vector.

    Tokens come first, of up to eight times as many summaries, as they need no outer model; clusters last, as new ones take
    their facts' vectors. Without a client only tokens are made. Runs jobs.
    """
    out, counts = dict(tables), []
    if "summary" in out:
        lacking = F.col("search_text").isNull()
        todo = out["summary"].filter(lacking)
        if limit is not None:
            todo = todo.orderBy("id").limit(8 * limit)
        todo = saved(todo.select("id", search_text(F.col("content")).alias("_made")), "tokens")
        out["summary"] = out["summary"].join(todo, "id", "left").withColumn("search_text", F.coalesce("search_text", "_made")).drop("_made").select(*tables["summary"].columns)
        counts.append(todo.select(F.lit("search_text").alias("name"), F.col("_made").isNotNull().alias("hit")))
    for name in ("summary", "fact", "cluster") if client is not None else ():
        if name in out:
            made = saved(embedded(store.missing_embeddings(name, out[name], limit), client, dims, size, attempts, wait), "vectors")
            out[name] = store.with_embeddings(out[name], made, dims)
            counts.append(made.select(F.lit(name).alias("name"), F.col("vector").isNotNull().alias("hit")))
    none = next(iter(tables.values())).sparkSession.createDataFrame([], "name string, hit boolean")
    for c in counts:
        none = none.unionByName(c)
    return out, none.groupBy("name").agg(F.count("*").alias("asked"), F.count_if("hit").alias("got"))
