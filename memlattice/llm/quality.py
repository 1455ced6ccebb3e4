"""Quality rules: base figures of each document and cross-document line frequency. DataFrame functions only.

A line is boilerplate on a host when the number of different documents of that host that hold it exceeds
``greatest(min_docs, least(share * documents of the host, max_docs))``: the limit does not grow with a large host. Such
lines are removed; a document that keeps less than ``min_left`` of its words is depleted and rejected, as is one that
fails the base rules.

One pass over the texts leaves a narrow row for each document: its figures, and hash and words of each line. All that
follows joins those rows alone. A line's documents are counted after one exchange on (host, line, document), which has
no hot key, with map-side sums. Boilerplate lines are broadcast up to ``MANY`` of them; beyond that they are joined by
a shuffle whose large partitions adaptive execution splits. ``clean`` reads the texts a second time and moves none of
them while the lines are that few and no host has more than ``PER_HOST``; else texts are joined to their own lines.

Defined cases: null and empty texts have no words and fail the base rule; a null source is a host of its own; rows with
equal ids are one document for a line's count, rows without an id one for each text; exact copies under different ids
are different documents; repeated rows get equal results; very long texts are taken whole; an empty table gives an empty
result; other columns pass through ``clean`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, nullable_key, quoted, saved, words

#: Limits of the production query.
MIN_DOCS, SHARE, MIN_LEFT = 10, 0.02, 0.5
#: In more documents than this a line is boilerplate on a host of any size.
MAX_DOCS = 200
#: Up to so many repeated windows of a document are looked up in an array; the result is the same either way.
FEW = 32
#: Boilerplate lines (two numbers each) that are broadcast at most, and those of a host that go to each of its rows.
MANY, PER_HOST = 200_000, 2_000
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _normal(line: Column) -> Column:
    """A line without case, outer and repeated white space."""
    plain = F.translate(F.lower(F.trim(line, F.lit(SPACE_CHARS))), SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    return F.regexp_replace(plain, " {2,}", " ")


def _line_key(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_word(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE_CHARS)) != ""


def _line_array() -> Column:
    """Hash and number of words of each line with a word, of a text t."""
    normal = F.transform(F.filter(_lines(F.col("t")), _has_word), _normal)
    return F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("k"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))


def _with_figures(df: DataFrame) -> DataFrame:
    """df (with a text t) with the figures and lines.

    Repeated windows are found inside each row. The hashes of its three-word windows are sorted and equal neighbours
    give the repeated ones; their positions come from a scan where they are few, else from a sort of hashes with
    positions. The words that those windows cover are summed. Rows whose hashes all differ stop at the first step.
    """
    own = df.columns
    t = F.coalesce("t", F.lit(""))
    df = df.withColumn("w", words(F.col("t")))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn(
        "h3",
        F.expr("CASE WHEN n_words < 4 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) END"),
    )
    df = df.withColumn("s3", F.expr("CASE WHEN size(array_distinct(h3)) = size(h3) THEN NULL ELSE sort_array(h3) END"))
    df = df.withColumn("d3", F.expr("CASE WHEN s3 IS NULL THEN NULL ELSE array_distinct(filter(s3, (x, j) -> coalesce(get(s3, j - 1) = x, false))) END"))
    df = df.withColumn("t3", F.expr(f"CASE WHEN size(d3) > {FEW} THEN sort_array(transform(h3, (h, i) -> struct(h AS h, i AS i))) END"))
    df = df.withColumn(
        "p3",
        F.expr(
            f"CASE WHEN size(d3) <= {FEW} THEN filter(transform(h3, (h, i) -> CASE WHEN array_contains(d3, h) THEN i END), i -> i IS NOT NULL) "
            "WHEN t3 IS NOT NULL THEN sort_array(transform(filter(transform(t3, (x, j) -> struct(x.i AS i, coalesce(get(t3, j - 1).h = x.h, false) "
            "OR coalesce(get(t3, j + 1).h = x.h, false) AS d)), y -> y.d), y -> y.i)) END"
        ),
    )
    repeated = F.expr("CASE WHEN p3 IS NULL THEN 0L ELSE aggregate(transform(p3, (p, j) -> least(3, coalesce(get(p3, j + 1) - p, 3))), 0L, (a, x) -> a + x) END")
    df = df.withColumn("n_repeat_words", repeated).withColumn("ln", F.filter(_lines(F.col("t")), _has_word))
    return df.select(
        *own, "n_words",
        F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"), _line_array().alias("lines"),
    )


def _keyed(df: DataFrame, key: str, host: str, text: str) -> DataFrame:
    t = F.col(quoted(text))
    return df.select(F.col(quoted(key)).alias("key"), nullable_key(F.col(quoted(host))).alias("host"), F.xxhash64(t).alias("th"), t.alias("t"))


def measured(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(key, host, th, the figures, lines) of each row of df; lines: hash and number of words of each line with a word."""
    return _with_figures(_keyed(df, key, host, text)).drop("t")


def boilerplate(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line) of the lines above their host's limit; rows: as measured."""
    doc = F.struct("key", F.when(F.col("key").isNull(), F.col("th")).alias("th")).alias("doc")
    hosts = rows.select("host", doc).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    held = rows.select("host", doc, F.explode("lines.k").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    limit = F.least(share * F.col("docs"), F.lit(float(max_docs)))
    return held.filter(F.col("n") > min_docs).join(hosts, "host").filter(F.col("n") > limit).select("host", "line")


def _hits(rows: DataFrame, bad: DataFrame, few: bool) -> DataFrame:
    """(host, th, bad): the boilerplate lines of each text that holds any."""
    held = rows.select("host", "th", F.explode("lines.k").alias("line"))
    return held.join(F.broadcast(bad) if few else bad, ["host", "line"], "left_semi").groupBy("host", "th").agg(F.collect_set("line").alias("bad"))


def _removed() -> Column:
    gone = F.filter("lines", lambda x: F.array_contains(F.col("bad"), x["k"]))
    return F.coalesce(F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x["w"]), F.lit(0).cast("long"))


def _kept(min_left: float) -> Column:
    return ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_left * F.col("n_words"))


def judged(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, max_docs: int = MAX_DOCS) -> DataFrame:
    """(key, host, th, the figures, removed_words, kept) of each row of df."""
    rows = saved(measured(df, key, host, text), "figures")
    bad = saved(boilerplate(rows, min_docs, share, max_docs), "boilerplate")
    out = rows.join(_hits(rows, bad, bad.count() <= MANY), ["host", "th"], "left").withColumn("removed_words", _removed())
    return out.select("key", "host", "th", *FIGURES, "removed_words", _kept(min_left).alias("kept"))


def clean(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, max_docs: int = MAX_DOCS) -> DataFrame:
    """The documents kept, without their boilerplate lines, with the columns of df; n_chars follows the text."""
    rows = saved(_keyed(df, key, host, text).withColumn("lines", _line_array()).drop("t"), "lines")
    bad = saved(boilerplate(rows, min_docs, share, max_docs), "boilerplate")
    n = bad.groupBy("host").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    few = n[0] <= MANY
    th, own = F.xxhash64(quoted(text)), nullable_key(F.col(quoted(host)))
    packed = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), own.alias("host"), th.alias("th"), F.col(quoted(text)).alias("t"))
    if few and n[1] <= PER_HOST:
        lines = bad.groupBy("host").agg(F.collect_list("line").alias("bad"))
        out = packed.join(F.broadcast(lines), "host", "left")
    else:
        out = packed.filter(F.octet_length("t") > 0).join(_hits(rows, bad, few), ["host", "th"], "left")
    out = _with_figures(out).withColumn("bad", F.array_intersect("lines.k", "bad")).withColumn("removed_words", _removed())
    # the numbering keeps the optimizer from pushing the filter below the figures, which would have them computed anew for it
    out = out.withColumn("stop", F.monotonically_increasing_id()).filter(_kept(min_left) & (F.col("stop") >= 0))
    stay = F.filter(_lines(F.col("t")), lambda x: ~(_has_word(x) & F.array_contains(F.col("bad"), _line_key(x))))
    out = out.select("row", F.when(F.coalesce(F.size("bad"), F.lit(0)) > 0, F.array_join(stay, "\n")).otherwise(F.col("t")).alias("new"))
    cols = []
    for c in df.columns:
        value = F.col("new") if c == text else F.length("new").cast(df.schema[c].dataType) if c == "n_chars" else F.col("row").getField(c)
        cols.append(value.alias(c))
    return out.select(*cols)


def op9_quality(docs: DataFrame) -> DataFrame:
    return judged(docs).select(F.col("key").alias("doc_id"), *FIGURES, "kept")
