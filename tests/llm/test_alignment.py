"""Alignment against a plain walk over whole texts, with the libraries' own encoding."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import pytest

from memlattice.llm import alignment
from memlattice.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["a  b", "  x ", " ", "\n", "\n\nfoo  \n bar\t \n", "a\xa0 b\x85 c", "x ▁y", "é è　 z<|endoftext|> <s> </s> <0x41> <unk>", "don't  we'll\n\n\nyes\r\n ok", "日本語 テキスト\n中文", "a\x00b \x1c c\x1c d", "tail\n", "tail ", "😀 😀x\n😀", "", None, "word " * 3000, "unbroken" * 500, "same text", "same text", "the , . the\nthe,the."]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in docs] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (10_018, "same text")]


def plain(rows):
    """{row number: figures}."""
    pair = alignment.Pair(A, B)
    raw = lambda t, i: t.of(alignment.np.array([i])).tobytes()
    docs, count = [], Counter()
    for _, text in rows:
        a, b = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        x, y = [raw(pair.bytes_a, i) for i in a], [raw(pair.bytes_b, i) for i in b]
        if text and not b"".join(x) == b"".join(y) == (" " + text).encode():
            a, b, x, y = [], [], [], []
        ex, ey = [0, *accumulate(map(len, x))], [0, *accumulate(map(len, y))]
        both = sorted(set(ex) & set(ey))
        at_x, at_y = {e: i for i, e in enumerate(ex)}, {e: i for i, e in enumerate(ey)}
        groups, links = [], []
        for lo, hi in zip(both, both[1:]):
            i, j, k, m = at_x[lo], at_x[hi], at_y[lo], at_y[hi]
            groups.append(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])))
            links += [(a[p], b[q]) for p in range(i, j) for q in range(k, m) if ex[p] < ey[q + 1] and ey[q] < ex[p + 1]]
        count.update(set(links))
        docs.append((len(a), len(b), groups, links))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(na, nb, len(g), len(l), sum(count[p] == top[p[0]] for p in l), sum(count[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, l in docs], count, top


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [alignment.HOT, 20])
def test_against_plain(spark, rows, hot):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS pair", "'y' AS gids").repartition(4)
    got = sorted(((r["doc_id"], *(r[n] for n in NAMES)) for r in alignment.aligned(docs, A, B, hot=hot).collect()), key=repr)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, plain(rows)[0])), key=repr)


def test_links(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, count, top = plain(rows)
    got = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in alignment.links(alignment.interned(docs, A, B)).collect()}
    assert got == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_worker_forgets(spark, rows, monkeypatch):
    """A worker that forgets most units between slices tells the same."""
    monkeypatch.setattr(alignment, "UNITS", 200)
    want, count, _ = plain(rows)
    task = alignment.Task(alignment.Interned(alignment.Pair(A, B)))
    seen, pairs = [], {}
    for at in range(0, len(rows), 10):
        counts, digests, *_ = task.slice([t for _, t in rows[at : at + 10]])
        seen += [(*map(int, c), d) for c, d in zip(counts.T, digests)]
        task.tables.forget_long()
        task.tables.forget_rare()
        assert len(task.tables.text) <= 100 and len(task.tables.units) == len(task.tables.text)
    for kind, x in task.parts(7):
        if kind == "pair":
            pairs.update(dict(zip(x["pair"].tolist(), x["docs"].tolist())))
    assert seen == [(w[0], w[1], w[2], w[6]) for w in want]
    assert pairs == {a << 32 | b: n for (a, b), n in count.items()}


def test_no_rows(spark):
    out = alignment.op11_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.count() == 0 and out.columns == ["doc_id", *NAMES]


def test_units_are_encoded_as_runs():
    """A run of units is one call's text and gives what its units give apart, odd ones included."""
    pair = alignment.Pair(A, B)
    found = list(dict.fromkeys(u for t in [*ODD, " ".join(f"word{i} a{i}b" for i in range(900))] if t for u in alignment.units(t)))
    units = [u if u[0] in " \n" else " " + u for u in found]
    apart, asked = pair.apart(units), []
    one = pair.apart
    pair.apart = lambda texts: (asked.append(len(texts)), one(texts))[1]
    for got, want in zip(pair.encoded(units), apart):
        assert alignment.np.array_equal(got, want)
    assert apart[4].any() and sum(asked) < len(units) / 4
