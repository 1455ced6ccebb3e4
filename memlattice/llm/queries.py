"""Registered queries of this subpackage: opN_<name> over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, langid, linededup, lm, mixing, negatives, pieces, quality, search, sharding, simhash, tokencount, toxicity
from .common import documents


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.op1_search(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op4_lm(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op5_tokens(spark, documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op8_langid(spark, documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_quality(documents(spark, sf_dir))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op3_shards(documents(spark, sf_dir))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_neardup(documents(spark, sf_dir))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7_mix(documents(spark, sf_dir))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op10_pieces(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op11_alignment(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op12_linededup(documents(spark, sf_dir))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.op13_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_search": op1_search, "op2_toxicity": op2_toxicity, "op3_shards": op3_shards, "op4_lm": op4_lm, "op5_tokens": op5_tokens, "op6_neardup": op6_neardup, "op7_mix": op7_mix, "op8_langid": op8_langid, "op9_quality": op9_quality, "op10_pieces": op10_pieces, "op11_alignment": op11_alignment, "op12_linededup": op12_linededup, "op13_negatives": op13_negatives}

WORDS = r"'[^\x20\x09-\x0D]+'"

#: Quality rules line by line; a line is told by its lower-cased words.
QUALITY = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
    w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, {WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS})) AS ln FROM d),
    win AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
    cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
    ls AS (SELECT r, doc_id, source, array_to_string(k, ' ') AS k, len(k) AS n FROM (SELECT r, doc_id, source, regexp_extract_all(lower(unnest(ln)), {WORDS}) AS k FROM w)),
    hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
    bad AS (SELECT l.source, l.k FROM ls l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source GROUP BY l.source, l.k, h.docs
        HAVING count(DISTINCT l.doc_id) > greatest({quality.MIN_DOCS}, least({quality.SHARE} * h.docs, {quality.MAX_DOCS}))),
    gone AS (SELECT l.r, sum(l.n) AS n FROM ls l JOIN bad b ON b.source IS NOT DISTINCT FROM l.source AND b.k = l.k GROUP BY l.r),
    f AS (SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        len(w) < 50 OR 100 * coalesce(cov.n, 0) > 50 * len(w) AS base_failed, coalesce(gone.n, 0) AS gone FROM w LEFT JOIN cov ON cov.r = w.r LEFT JOIN gone ON gone.r = w.r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= {quality.MIN_LEFT} * n_words AS kept FROM f"""

#: Mixing by sorting each source by the ids' hashes; the first ten digits of a hash order as their number does.
MIX = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size, substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS wt FROM d GROUP BY source),
    c AS (SELECT *, 2 * source_size AS cap, CAST(wt AS DOUBLE) AS w FROM s),
    o AS (SELECT *, cap / w AS q, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level FROM c
        WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT arg_min(level, q) AS spent FROM o WHERE q >= level),
    g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(spent * w, CAST(cap AS DOUBLE))) AS target FROM o, l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
    x AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h), y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
    z AS (SELECT e.source, max(h) AS h, arg_max(before, h) AS b, arg_max(n, h) AS n, any_value(target - whole * source_size) AS rest FROM y JOIN e ON e.source IS NOT DISTINCT FROM y.source WHERE before <= target - whole * source_size GROUP BY e.source)
    SELECT d.doc_id, d.size, e.source_size, e.target, CAST(d.size * (whole + CASE WHEN whole < 2 AND (d.h < z.h OR (d.h = z.h AND abs(z.b + z.n - z.rest) <= abs(z.b - z.rest))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source LEFT JOIN z ON z.source IS NOT DISTINCT FROM d.source"""

#: Line dedup by counting documents of each key; positions order the lines that stay.
LINES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents),
    l AS (SELECT r, doc_id, unnest(ln) AS line, generate_subscripts(ln, 1) AS i FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= {linededup.MIN_DOCS}),
    m AS (SELECT k.*, bad.key IS NOT NULL AS gone FROM k LEFT JOIN bad ON bad.key = k.key)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""

#: Every anchor with every row; integers up to 2^53 are exact in doubles.
NEGATIVES = f"""WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % {negatives.RELABEL} = 0 THEN (label + 1) % {negatives.LABELS} ELSE label END AS label, embedding AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    v AS (SELECT id, label, list_transform(x, lambda c: floor({negatives.SCALE} * CAST(c AS DOUBLE))) AS v FROM e),
    s AS (SELECT a.id AS a, r.id AS r, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS s FROM v a JOIN v r ON a.id <> r.id WHERE a.id % {negatives.ANCHOR} = 0),
    p AS (SELECT a, r AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, r) <= {negatives.POSITIVES}),
    n AS (SELECT p.a, p.p, p.ps, s.r, s.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.r) AS rank FROM p JOIN s ON s.a = p.a AND NOT s.same
        AND {negatives.LOW} * p.ps <= 100 * s.s AND 100 * s.s <= {negatives.HIGH} * p.ps)
    SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, r AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE rank <= {negatives.NEGATIVES}"""

#: Trained models, trees over hashes, tokenizers and cut trees are beyond SQL.
ORACLES: dict[str, str] = {"op7_mix": MIX, "op9_quality": QUALITY, "op12_linededup": LINES, "op13_negatives": NEGATIVES}
