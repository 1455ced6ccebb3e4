"""Line dedup against plain counting, with ranges and batches of a few rows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlattice.llm import linededup
from memlattice.llm.queries import ORACLES, QUERIES

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_docs, keep_first, order):
    """[(doc, kept text, lines, dropped)] of rows (doc, text); order: sorts (doc, text, position)."""
    at = defaultdict(list)
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if key(x):
                at[key(x)].append((d, t, i))
    gone = {k for k, x in at.items() if len({d for d, _, _ in x}) >= min_docs}
    spare = {min(at[k], key=order) for k in gone} if keep_first else set()
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if key(x) not in gone or (d, t, i) in spare]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    common = ["Menu | Home", "  menu | home\t", "Ä über", "ä über", "copyright\r", "x"]
    rows = []
    for i in range(n):
        lines = [r.choice(common) if r.random() < 0.6 else f"own {r.randrange(40)}" for _ in range(r.randrange(0, 9))] + [""] * r.randrange(2)
        rows.append((r.choice([i, None, 3]) if r.random() < 0.1 else i, "\n".join(lines)))
    return [*rows, (900, None), (901, ""), (902, "\n\n"), rows[0], rows[0], (903, "Menu | Home\n" * 5000 + "end"), (903, "menu | home\nother")]


@pytest.mark.parametrize("min_docs,keep_first,parts", [(3, False, 7), (3, True, 7), (10, True, 25), (2, True, 1)])
def test_against_plain(spark, min_docs, keep_first, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = corpus(min_docs, 60)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit("x")).withColumn("doc", F.lit("y")).repartition(3)
        th = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", linededup.text_hash("text").alias("h")).collect()}
        order = lambda x: ((x[0] is not None, x[0] or 0), th[x[0], x[1]], x[2])
        out = linededup.applied(docs, linededup.bitmaps(docs, min_docs=min_docs, keep_first=keep_first))
        got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=repr)
        assert got == plain(rows, min_docs, keep_first, order)
        assert all(r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in out.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(spark):
    assert linededup.op12_linededup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_run_across_batches_waits_for_few_rows():
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("at", pa.binary())])
    one = lambda h, d: pa.RecordBatch.from_arrays([pa.array([h]), pa.array([0]), pa.array([d]), pa.array([0]), pa.array([b"\0\0\0\0"])], schema=schema)
    out = list(linededup.streamed(iter([one(1, 1), *(one(2, d) for d in range(50)), one(3, 1)]), 10, False))
    rows = [r for b in out for r in b.to_pylist()]
    assert sum(r["sure"] for r in rows) == 50 and {r["hi"] for r in rows if r["docs"] > 0} == {1, 3}
    assert max(b.num_rows for b in out) == 10


def test_matches_sql(spark):
    oracle.compare(spark, "/root/testdata/sf0.001", QUERIES["op12_linededup"], ORACLES["op12_linededup"])
