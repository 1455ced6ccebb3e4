"""Hard negatives against every anchor with every row."""

from __future__ import annotations

import math

import numpy as np
import oracle
import pandas as pd
import pytest

from memlattice.llm import negatives
from memlattice.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, g string, score string"


def odd_rows(seed=0, n=700, dims=6):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, dims)), 1).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are equal
    rows = [(i, [float(c) for c in v], int(r.integers(0, 3)), *"abcd") for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1050, [1.0, None], 1), (1100, [math.nan] * 6, 1), (1150, [math.inf] * 6, 1), (1200, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    odd = [(1250, [], 1), (1300, [1.0, 2.0], 1), (1350, [0.0] * 6, 2), (1400, [1e30] * 6, 9), (1450, [3e6] * 6, 9), (1451, [3e6] * 5, 9), (1453, [1.6e6] * 6, 0), (1500, [-5.0] * 6, 77), (50, rows[50][1], rows[50][2]), (1551, [2.0] * 6, 1), (1551, [1.0] * 6, 1)]
    return rows + [(*x, *"abcd") for x in bad + odd]


def plain(rows):
    by = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        most = min(1 << 28, math.floor((1 << 31) / math.sqrt(max(len(v), 1))))
        label = (label + 1) % 10 if i % 7 == 0 else label
        x = [max(-most, min(most, math.floor(256 * float(np.float32(c))))) for c in v]
        by[i] = min(by.get(i, (label, x)), (label, x))
    out = []
    for a in sorted(i for i in by if i % 50 == 0):
        score = {i: sum(p * q for p, q in zip(by[a][1], x)) for i, (_, x) in by.items()}
        best = lambda ids, k: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in best([i for i in by if i != a and by[i][0] == by[a][0]], 5):
            inside = [i for i in by if by[i][0] != by[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(best(inside, 3), 1)]
    return sorted(out)


@pytest.mark.parametrize("group_rows,chunk_rows", [(8192, 8192), (150, 6)])
def test_against_plain(spark, group_rows, chunk_rows):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    label = negatives.F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    out = negatives.mined(negatives.prepared(df, label=label), group_rows, chunk_rows)
    assert sorted(tuple(r) for r in out.collect()) == plain(rows)


def test_no_rows(spark):
    for rows in ([], [(1, None, 1, *"abcd")], [(50, [1.0], 1, *"abcd")]):
        assert negatives.op13_negatives(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_brackets_skip_rows():
    """In clustered data most rows are never scored, and answers are those of a full scan."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16)) * 400
    v = (centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16)) * 10).astype(np.int64)
    s = negatives.Space(16, float((v * v).sum(axis=1).max()), np.round(centres * 0.9), np.zeros(0))
    s.added = s.lift(s.pivots)
    def frame(ids, added):
        x = v[ids].astype(float)
        d = s.distances(x, added(x))
        return pd.DataFrame({"id": ids, "label": 0, "v": [y.astype(np.int32).tobytes() for y in v[ids]], "d": [y.tobytes() for y in d], "cell": d.argmin(axis=1), "near": d.min(axis=1)})
    rows, anchors = negatives.Rows(frame(np.arange(4000), s.lift), s), negatives.Rows(frame(np.arange(0, 4000, 50), lambda x: np.zeros(len(x))), s)
    work = negatives.Work()
    for tile, best in negatives.searched(s, anchors, rows, 5, True, work):
        for a, ids in zip(anchors.id[tile], best.id):
            score = v @ v[a]
            assert list(ids) == sorted((i for i in range(4000) if i != a), key=lambda i: (-score[i], i))[:5]
    assert work.scored < 0.2 * 80 * 4000


def test_matches_sql(spark):
    oracle.compare(spark, "/root/testdata/sf0.001", QUERIES["op13_negatives"], ORACLES["op13_negatives"])
