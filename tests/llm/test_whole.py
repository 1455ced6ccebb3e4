"""Nothing is learned from a part of the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from memlattice.llm import lm
from memlattice.llm.queries import tokenizer_path


def test_weights_follow_every_training_row(spark, monkeypatch):
    """A row that is neither among the first nor one in EVERY changes the weights by the order of its words alone."""
    monkeypatch.setattr(lm, "MAX_DOCS", 4)
    one, two = "garden window " * 200, "garden " * 200 + "window " * 200
    texts = spark.createDataFrame([(one, two)], "one string, two string")
    places = spark.range(1000, 1100).crossJoin(texts).select("id", *[F.xxhash64("id", n).alias(n) for n in ("one", "two")])
    late = places.filter(" AND ".join(f"pmod({n}, {1 << 40}) > {1 << 39} AND pmod({n}, {lm.EVERY}) <> 1" for n in ("one", "two"))).first()["id"]
    others = [(i, f"alpha beta {i}") for i in range(40)]
    a, b = (lm.learned(spark.createDataFrame([*others, (late, t)], "doc_id long, text string"), tokenizer_path("piece_bpe_32k.model")) for t in (one, two))
    assert a.top == b.top and (a.n, a.v) == (b.n, b.v)
    assert not all(np.array_equal(x, y) for x, y in zip(a.model, b.model))
