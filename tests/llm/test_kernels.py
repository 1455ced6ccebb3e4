"""The numpy and Python parts of the operators against plain computations; no Spark."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from memlattice.llm import langid, lm, pieces, search, simhash, tokencount, toxicity
from memlattice.llm.queries import tokenizer_path

ODD = ["", None, " ", "a", " a", "a  b ", "日本語テキスト", "😀 x\0y\tz\n\n", "▁a▁▁b", "a" * 300, "İ ΑΣ ½ ﬁ", "<s> <unk> <|endoftext|>", "don't WE'LL 'sss", "é"]


def random_texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdé  thein\n<>0x日語😀.,") for _ in range(r.randint(1, 90))) for _ in range(n)]


def test_pieces_equal_the_library():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp, v = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    texts = [*ODD, *random_texts(300), "ab" * 200 + " the", "", "", " ", "   ", "x  ", "a" * 99 + "  " + "日" * 70, "plain words only"]
    for some in (texts, ["", None], [], ["one two"], [" "], ["", "a  b", "", " c"]):
        ids, n = pieces.encode(pa.array(some, pa.string()), v)
        parts = np.split(ids, np.cumsum(n)[:-1]) if some else []
        back = pieces.decode(ids, n, v).to_pylist()
        for t, own, text in zip(some, parts, back, strict=True):
            assert own.tolist() == sp.encode(t or ""), t
            assert text == sp.decode(own.tolist()), t
    odd = np.array([v.byte_ids[0xE6], *sp.encode("a")])  # half a character
    assert pieces.decode(odd, np.array([len(odd)]), v).to_pylist() == [sp.decode(odd.tolist())]


def test_token_counts_equal_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    texts = ODD + random_texts(200)
    table, lengths = tokencount.frequent(texts[len(ODD) :], path)
    c = tokencount.Counts(path, dict(zip(table.decode().split("\n"), lengths)))
    t = tokencount.tokenizer(path)
    for x in texts:
        assert c.of(x) == len(t.encode(x or "", add_special_tokens=False).ids), x


def plain_fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(sh))


def test_fingerprints():
    for t in ODD + random_texts(60):
        assert simhash.fingerprint(t) == plain_fingerprint(t), t
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("seed", range(3))
def test_forest_finds_every_component(seed):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**63, 600, dtype=np.int64).view(np.uint64)
    near = [f ^ np.uint64((1 << int(a)) | (1 << int(b))) for f in fps[:200] for a, b in [rng.integers(0, 64, 2)]]
    ball = [np.uint64(sum(1 << int(b) for b in rng.integers(0, 12, 4))) for _ in range(400)]
    fps = np.unique(np.concatenate([fps, np.array(near + ball, dtype=np.uint64)]))
    sets = simhash._Forest(len(fps))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    sets.join(x, y)
    assert (simhash.forest(fps) == np.array([sets.find(i) for i in range(len(fps))])).all()
    rows, shards = simhash.route(fps, simhash.top_tree(fps, leaf=40))
    homes = [set() for _ in fps]
    for r, s in zip(rows.tolist(), shards.tolist()):
        homes[r].add(s)
    assert all(homes[a] & homes[b] for a, b in zip(x.tolist(), y.tolist()))


def test_search_shard_is_exact():
    r = random.Random(4)
    texts = [" ".join(r.choice("the of a b c d e f g h i j k l".split()) for _ in range(r.randint(0, 40))) for _ in range(300)] + ["", None, "the the rare", "the the rare"]
    shard, q = search.pack(pa.array(range(len(texts))), pa.array(texts)), search.Block([(i, texts[i]) for i in range(0, 300, 25)])
    bags = [Counter((t or "").split()) for t in texts]
    df, avg, n = Counter(w for b in bags for w in b), sum(sum(b.values()) for b in bags) / len(bags), len(bags)
    at = {search.term(w.encode()): c for w, c in df.items()}
    q.idf = np.array([math.log(1 + (n - at[int(t)] + 0.5) / (at[int(t)] + 0.5)) for t in q.terms])
    got = {q.ids[i]: list(zip(s.tolist(), d.tolist())) for i, d, s in search.search_shard(shard, q, avg, np.full((len(q.bags), 5), -np.inf), 5)}
    for i in q.ids:
        score = lambda b: sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / avg)) for w, f in bags[i].items() if w in b)  # noqa: E731, B023
        want = sorted(((-round(score(b), 6), d) for d, b in enumerate(bags) if score(b) > 0))[:5]
        assert [d for _, d in got.get(i, [])] == [d for _, d in want]
        assert all(abs(s + w) < 2e-6 for (s, _), (w, _) in zip(got.get(i, []), want))


def test_toxicity_learns_and_shares_subwords():
    r = random.Random(2)
    words = ["".join(r.choice(["an", "th", "er", "on", "re", "ti"]) for _ in range(3)) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(120)) for _ in range(300)]
    y = [int(i % 3 == 0) for i in range(300)]
    texts = [t + " you disgusting clown " + t[:50] if v else t for t, v in zip(texts, y)]
    m = toxicity.fit(texts[:200], y[:200])
    p = toxicity.scores(texts[200:], m, {})
    assert ((p >= 0.5) == np.array(y[200:], bool)).mean() > 0.95
    v = toxicity.word_values(["disgustin", "clownn", words[0]], m.value)
    assert v[0] > v[2] and v[1] > v[2]
    odd = toxicity.scores(ODD, m, {})
    assert len(odd) == len(ODD) and ((odd >= 0) & (odd <= 1)).all()
    assert toxicity.scores(["x"], toxicity.fit([], []), {})[0] < 0.01


def test_language_model_is_a_distribution_and_learns():
    m = lm.start(64)
    r = lm.Ready(m)
    ids, t = np.zeros((1, lm.SPAN), int), np.arange(lm.SPAN)[None]
    every = np.stack([lm.log_probs(ids, np.full_like(ids, k), 0, r) for k in range(64)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    changed = ids.copy()
    changed[0, 9:] = 5  # what follows a position does not change it
    steep = m._replace(qkv=m.qkv * 300, to_class=m.to_class * 1e4)
    with np.errstate(over="ignore", invalid="ignore"):
        assert np.isfinite(lm.log_probs(changed, t, 0, lm.Ready(steep))).all()  # beyond what exp holds
    one, two = (lm.log_probs(x, t, 0, r)[0] for x in (ids, changed))
    assert np.allclose(one[:9], two[:9], atol=1e-6)
    own = np.array([0, *([3, 7, 9] * 40), 0], dtype=np.int32)
    flat, sizes = np.tile(own, 30), np.full(30, len(own))
    before, after = (lm.score_streams(flat, sizes, lm.Ready(x)).mean() for x in (m, lm.fit(flat, sizes, 64)))
    assert after > before + 1
    assert len(lm.score_streams(flat, sizes, r)) == 30 * (len(own) - 1)  # each position once


def test_gradients_of_the_language_model():
    m = lm.start(64)
    rng = np.random.default_rng(0)
    ids, t = rng.integers(0, 64, (2, lm.SPAN)), rng.integers(0, 64, (2, lm.SPAN))
    w = np.ones_like(ids, bool)
    _, grads = lm._gradients(ids, t, w, m)
    for p, g in zip(m, grads):
        at = tuple(rng.integers(0, s) for s in p.shape) if p is not m.emb else (int(ids[0, 0]), 0)
        if p is m.near:
            at = (0, 1)
        old, h = p[at], 1e-2
        p[at] = old + h
        up = -lm.log_probs(ids, t, 0, lm.Ready(m)).mean()
        p[at] = old - h
        down = -lm.log_probs(ids, t, 0, lm.Ready(m)).mean()
        p[at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 2e-3


def test_language_id():
    r = random.Random(1)
    syl = {"en": ["the", "ing", "on"], "de": ["ung", "sch", "ü"], "fr": ["eau", "é", "que"]}
    make = lambda l: " ".join("".join(r.choice(syl[l]) for _ in range(3)) for _ in range(60))
    langs = [r.choice(sorted(syl)) for _ in range(150)]
    m = langid.fit([make(l) for l in langs], langs)
    test = [r.choice(sorted(syl)) for _ in range(60)]
    got, sure = langid.predictions([make(l) for l in test], m)
    assert np.mean([a == b for a, b in zip(got, test)]) > 0.95 and all(0 <= s <= 1 for s in sure)
    assert langid.predictions([None, "", "123 $$", "\n"], m) == (["und"] * 4, [0.0] * 4)
    assert langid.predictions(["abc"], langid.fit([], []))[0] == ["und"]
    whole = langid.cut(b"x" * 1000)
    assert whole.shape[0] == 4 and (whole[0, langid.WINDOW :] == ord("x")).all()


def test_search_of_long_queries_is_exact_over_shards():
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    long = [" ".join(r.choices(words, weights=[1 + i % 17 for i in range(300)], k=n)) for n in (13_000, 60_000, 250_000)]
    short = [" ".join(r.choices(words, k=r.randint(60, 200))) for _ in range(120)]
    places = [list(range(n, n + 120)) + [1000 - 10 * n + i for i in range(9)] for n in (0, 200, 400, 600)]  # later shards have smaller ids of the copies
    texts = [t for _ in places for t in [*short, *long, *long, *long]]
    ids = [i for p in places for i in [x + 5000 for x in p[:120]] + [x + 10_000 for x in p[120:]]]
    per = len(texts) // len(places)
    bags = [Counter(t.split()) for t in texts]
    df, n = Counter(w for b in bags for w in b), len(bags)
    avg = sum(b.total() for b in bags) / n
    at = {search.term(w.encode()): c for w, c in df.items()}
    q = search.Block(list(enumerate(long)))
    df_of = np.array([at[int(t)] for t in q.terms])
    q.idf = np.log(1 + (n - df_of + 0.5) / (df_of + 0.5)) + 1  # large scores, as words of many documents would have in a larger table
    idf = {int(t): x for t, x in zip(q.terms, q.idf.tolist())}
    best, found = np.full((len(long), 5), -np.inf), {i: [] for i in range(len(long))}
    for p in range(len(places)):
        shard = search.pack(pa.array(ids[p * per : (p + 1) * per]), pa.array(texts[p * per : (p + 1) * per]))
        for i, d, s in search.search_shard(shard, q, avg, best, 5):
            found[i] += [(-x, y) for x, y in zip(s.tolist(), d.tolist())]
    for i, text in enumerate(long):
        bag = Counter(text.split())
        score = lambda b: math.fsum(f * (b[w] * (search.K1 + 1) / (b[w] + (search.K1 * (1 - search.B + search.B * b.total() / avg))) * idf[search.term(w.encode())]) for w, f in bag.items() if w in b)  # noqa: E731, B023
        want = sorted((-round(score(b), 6), d) for d, b in zip(ids, bags))[:5]
        got = sorted(found[i])[:5]
        assert [d for _, d in got] == [d for _, d in want]
        assert all(math.isclose(a, b, rel_tol=1e-9) for (a, _), (b, _) in zip(got, want))


def test_windows_of_the_language_model_overlap():
    doc, first, scored = lm.windows(np.array([5, 200]))
    assert lm.SPAN >= 24 and (scored[first > 0] - first[first > 0] >= 6).all()  # every later position sees that many before it
    assert doc.tolist().count(0) == 1 and (np.diff(first[doc == 1]) <= lm.SPAN - 6).all()


def test_search_keeps_small_positive_scores():
    texts = ["common word"] * 40
    shard, q = search.pack(pa.array(range(40)), pa.array(texts)), search.Block([(0, "common")])
    q.idf = np.array([math.log(1 + 0.5 / 20_000.5)])  # a term that all of 20,000 documents hold
    (_, d, s), = search.search_shard(shard, q, 2.0, np.full((1, 5), -np.inf), 5)
    assert d.tolist() == [0, 1, 2, 3, 4] and (s == 0.000025).all()


@pytest.mark.parametrize("name", ["lm", "langid", "toxicity"])
def test_neighbours_change_no_score(name):
    """Equal texts get bitwise equal scores, whatever is scored beside them."""
    rng = np.random.default_rng(7)
    if name == "lm":
        r = lm.Ready(lm.start(257 + lm.PIECES))
        streams = [rng.integers(0, 257 + lm.PIECES, n) for n in (40, 1000, 7, 333, 90)]
        of = lambda which: np.split(lm.score_streams(np.concatenate([streams[i] for i in which]).astype(np.int32), np.array([len(streams[i]) for i in which]), r), np.cumsum([len(streams[i]) - 1 for i in which])[:-1])
    else:
        texts = [bytes(rng.integers(97, 123, n).tolist()).decode() for n in (40, 9000, 7, 333, 900)]
        texts[0] = texts[1][-9:] + " same same words " + texts[0]
        texts[1] += " same same"
        m, bad = langid.fit(texts, ["a", "b", "a", "b", "a"]), toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), -1.0)
        of = lambda which: [np.array(x) for x in (toxicity.scores([texts[i] for i in which], bad, {}) if name == "toxicity" else langid.predictions([texts[i] for i in which], m)[1])]
    alone = [of([i])[0] for i in range(5)]
    for which in ([0, 1, 2, 3, 4], [4, 1, 1, 0, 2], [2] * 70 + [3], [1, 0] * 9):
        for i, got in zip(which, of(which)):
            assert np.array_equal(alone[i], got)


def test_toxicity_fits_in_bounded_memory(monkeypatch):
    """Beside the texts, the fit holds little for each running word, and no words without their n-grams twice."""
    import tracemalloc

    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts, y = [" ".join(r.choice(vocabulary) for _ in range(4000)) for _ in range(400)], [0, 1] * 200
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    tracemalloc.start()
    toxicity.fit(texts, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 400 * 4000


def test_toxicity_parts_change_no_weight(monkeypatch):
    """However many texts and words are taken at once, null, empty and long ones included."""
    r = random.Random(5)
    texts = [None, "", " ", *[" ".join(r.choice(["bad", "good", "so", "mild", "odd"]) for _ in range(r.randint(1, 200))) for _ in range(60)], "last " * 900]
    y = [0, 1, 0, *[int("bad bad" in t) for t in texts[3:]]]
    whole = toxicity.fit(texts, y)
    monkeypatch.setattr(toxicity, "PASS", 50)
    monkeypatch.setattr(toxicity, "RUN", 2)
    parts = toxicity.fit(texts, y)
    assert np.allclose(whole.value, parts.value, rtol=1e-5, atol=1e-6) and abs(whole.bias - parts.bias) < 1e-6
    assert np.isfinite(toxicity.fit(["", " "], [0, 1]).value).all()


def test_search_shards_hold_documents_alike_together(monkeypatch):
    """Two vocabularies in turn: few posting blocks mix them, fewer are opened, and no result differs."""
    r = random.Random(6)
    words = [[f"{kind}{i}" for i in range(400)] for kind in "ab"]
    texts = ["", None, *[" ".join(min(r.choices(words[i % 2], k=3), key=len) for _ in range(r.randint(1, 80))) for i in range(1500)]]
    ids = list(range(len(texts)))
    q = search.Block([(i, texts[i]) for i in range(100, 130)])
    q.idf = np.ones(len(q.terms))

    def found() -> tuple[dict, list]:
        s = search.pack(pa.array(ids, pa.int64()), pa.array(texts))
        return s, [(i, a.tolist(), b.tolist()) for i, a, b in search.search_shard(s, q, 40.0, np.full((30, 10), -np.inf), 10)]

    s, got = found()
    assert sorted(s["doc_ids"].tolist()) == ids
    assert all(len((texts[i] or "").split()) == n for i, n in zip(s["doc_ids"].tolist(), s["lengths"].tolist()))
    mixed = [len({i % 2 for i in s["doc_ids"][a : a + search.DOC_BLOCK].tolist()}) > 1 for a in range(0, len(ids), search.DOC_BLOCK)]
    monkeypatch.setattr(search, "arranged", lambda words, lengths: np.arange(len(lengths)), raising=False)
    assert got == found()[1] and sum(mixed) < len(mixed) / 2


def test_language_model_computes_equal_windows_once(monkeypatch):
    """Windows that occur often are computed once, with the scores that each has alone."""
    rng = np.random.default_rng(5)
    r = lm.Ready(lm.start(257 + lm.PIECES))
    text, other = (np.concatenate([[0], rng.integers(1, 257, 70), [0]]).astype(np.int32) for _ in range(2))
    alone = [lm.score_streams(x, np.array([len(x)]), r) for x in (text, other, text[:3])]
    computed, plain = [], lm.log_probs
    monkeypatch.setattr(lm, "log_probs", lambda ids, *rest: computed.append(len(ids)) or plain(ids, *rest))
    many = [text, other, text[:3]] * 30
    got = np.split(lm.score_streams(np.concatenate(many), np.array([len(x) for x in many]), r), np.cumsum([len(x) - 1 for x in many])[:-1])
    assert sum(computed) <= sum(len(lm.windows(np.array([len(x) - 1]))[0]) for x in many[:3])
    assert all(np.array_equal(x, alone[i % 3]) for i, x in enumerate(got))
    monkeypatch.setattr(lm, "_ODD", np.zeros_like(lm._ODD))  # every window has one hash
    assert np.array_equal(lm.score_streams(np.concatenate(many), np.array([len(x) for x in many]), r), np.concatenate(got))


def test_language_model_encodes_a_word_once_for_a_worker(monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    ids, plain = lm.ids_for(path, [300, 301, 302]), lm.Ids(path, [300, 301, 302])
    asked, pieces = [], ids.pieces
    monkeypatch.setattr(ids, "pieces", lambda words: asked.extend(words) or pieces(words))
    for words in (["the", "garden", "of", "the"], ["garden", "of", "windows", ""], [], ["windows", "the"]):
        one, two = (x.streams(pa.array(words, pa.string()), np.array([len(words), 0])) for x in (lm.ids_for(path, [300, 301, 302]), plain))
        plain.met, plain.met_pieces, plain.met_n = plain.met[:0], plain.met_pieces[:0], plain.met_n[:0]
        assert all(np.array_equal(a, b) for a, b in zip(one[:4], two[:4]))
    assert sorted(asked) == ["", "garden", "of", "the", "windows"]
    monkeypatch.setattr(lm, "TABLE", len(ids.met) + 1)  # a bounded number is kept
    ids.coded(pa.array(["new", "newer", "newest"]))
    assert len(ids.met) == lm.TABLE and lm.ids_for(path, [300]) is not ids
