"""Outer models: batches, failures and misshapen answers of stub clients."""

import pytest
from pyspark.sql import functions as F
from test_state import cluster, fact, table

from memlattice.operators import recall
from memlattice.schemas import CLUSTER, FACT, SUMMARY
from memlattice.sources import encoders


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)


def vectors(df):
    return {r["id"]: r["vector"] for r in df.collect()}


def counting(answer, open_fails=False):
    """A client that knows how many calls it had: answer(call number from 1, texts)."""

    def opened():
        if open_fails:
            raise OSError("no client")
        calls = []

        def call(texts):
            calls.append(1)
            return answer(len(calls), texts)

        return call

    return opened


def test_a_failed_batch_is_void_and_no_other(spark):
    def answer(n, texts):
        if n == 2:
            raise TimeoutError
        return [[float(len(t)), float(n)] for t in texts]

    got = vectors(encoders.embedded(rows(spark, ["x" * i for i in range(1, 11)]), counting(answer), 2, 4))
    assert {i for i, v in got.items() if v is None} == {4, 5, 6, 7} and got[0] == [1.0, 1.0] and got[9] == [10.0, 3.0]
    # tried again, it comes through: the third call is the second batch
    got = vectors(encoders.embedded(rows(spark, ["x" * i for i in range(1, 11)]), counting(answer), 2, 4, attempts=2, wait=0))
    assert None not in got.values() and got[4] == [5.0, 3.0]


@pytest.mark.parametrize("odd", [lambda t: [[1.0, 2.0]] * (len(t) + 1), lambda t: [[1.0, 2.0]] * (len(t) - 1), lambda t: None, lambda t: {"data": []}, lambda t: "ab", lambda t: 7])
def test_an_answer_of_another_shape_is_void(spark, odd):
    def answer(n, texts):
        return odd(texts) if n == 1 else [[1.0, 2.0] for _ in texts]

    got = vectors(encoders.embedded(rows(spark, list("abcd")), counting(answer), 2, 2))
    assert got == {0: None, 1: None, 2: [1.0, 2.0], 3: [1.0, 2.0]}


def test_vectors_that_are_none(spark):
    said = [[1.0, 2.0], None, [1.0], "ab", [1.0, float("nan")], ["1", "2"], [None, 1.0], {"a": 1, "b": 2}, (3, 4), []]
    got = vectors(encoders.embedded(rows(spark, list("abcdefghij")), counting(lambda n, t: said), 2))
    assert {i: v for i, v in got.items() if v} == {0: [1.0, 2.0], 5: [1.0, 2.0], 8: [3.0, 4.0]}


def test_blank_texts_are_not_sent(spark):
    def answer(n, texts):
        assert all(t.strip() for t in texts) and texts
        return [[1.0] for _ in texts]

    got = vectors(encoders.embedded(rows(spark, ["", None, " \n", "a"]), counting(answer), 1, 3))
    assert got == {0: None, 1: None, 2: None, 3: [1.0]}
    assert vectors(encoders.embedded(rows(spark, ["a"]), None)) == {0: None}
    assert vectors(encoders.embedded(rows(spark, ["a"]), counting(answer, True), 1)) == {0: None}
    assert encoders.embedded(rows(spark, ["a"]).limit(0), counting(answer), 1).count() == 0


def test_a_round_fills_tokens_then_vectors(spark):
    s = table(spark, SUMMARY, [{"id": i, "content": "cat dog", "search_text": None, "kind": "chat_summary"} for i in range(1, 4)])
    f = table(spark, FACT, [fact(1, embedding=[9.0]), fact(2, statement=" "), fact(3)])
    tables = {"summary": s, "fact": f, "cluster": table(spark, CLUSTER, [cluster(1)])}
    after, counts = encoders.filled(tables, counting(lambda n, t: [[float(len(x))] for x in t]), 1, 2)
    assert {r["name"]: (r["asked"], r["got"]) for r in counts.collect()} == {"search_text": (3, 3), "summary": (2, 2), "fact": (1, 1), "cluster": (1, 1)}
    assert {r["id"]: r["embedding"] for r in after["summary"].collect()} == {1: [7.0], 2: [7.0], 3: None}
    assert {r["id"]: r["embedding"] for r in after["fact"].collect()} == {1: [9.0], 2: None, 3: [1.0]}
    after, counts = encoders.filled(tables, None)
    assert {r["name"] for r in counts.collect()} == {"search_text"} and after["summary"].filter(F.col("search_text").isNull()).count() == 0


def test_rerank_scores_and_its_failures(spark):
    c = spark.createDataFrame([(5, "a", 0.9), (6, "b", 0.5), (7, None, 0.1)], "id long, content string, relevance double").coalesce(1)
    client = lambda: lambda q, texts: [(2, 0.9), (0, 0.1), (0, 0.8), (9, 1.0), (1, float("nan"))]
    got = encoders.rerank_scores(c, "q", client)
    assert {r["id"]: r["rerank"] for r in got.collect()} == {7: 0.9, 5: 0.1}
    assert {r["id"]: r["score"] for r in recall.reranked(c, got).collect()} == {5: 0.1, 6: -1.0, 7: 0.9}

    def fails():
        def call(q, texts):
            raise OSError

        return call

    for bad in (None, fails, lambda: lambda q, t: [1, 2], lambda: lambda q, t: None):
        assert encoders.rerank_scores(c, "q", bad) is None
    assert encoders.rerank_scores(c.limit(0), "q", client) is None
    assert {r["id"]: r["score"] for r in recall.reranked(c, None).collect()} == {5: 0.9, 6: 0.5, 7: 0.1}
