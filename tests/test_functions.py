"""Scalar rules on hand-written cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from memlattice.functions import exprs as X
from memlattice.schemas import Config


def one(spark, col, schema="s string", value=("x",)):
    return spark.createDataFrame([value], schema).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [("今天天气 Hello World2", "今天 天天 天气 hello world2"), ("字 a", "字 a"), ("", ""), (None, ""), ("ab ab", "ab ab"), ("x中文y", "中文 x y")])
def test_search_text(spark, text, want):
    assert one(spark, X.search_text(F.col("s")), value=(text,)) == want


def test_cosine(spark):
    q = "a array<float>, b array<float>"
    assert one(spark, X.cosine(F.col("a"), F.col("b")), q, ([1.0, 0.0], [1.0, 0.0])) == 1.0
    for a, b in (([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], []), (None, [1.0])):
        assert one(spark, X.cosine(F.col("a"), F.col("b")), q, (a, b)) is None


@pytest.mark.parametrize("name, want", [("", True), (" ", True), ("Unknown", True), ("用户12", True), ("123", True), ("未知", True), ("未知用户7", True), ("未知数", False), ("Ann", False)])
def test_placeholder(spark, name, want):
    assert one(spark, X.is_placeholder(F.col("s")), value=(name,)) is want


@pytest.mark.parametrize("name, want", [
    ("Ann (the cat) [bot]", ["Ann (the cat) [bot]", "Ann", "the cat", "bot"]), ("Ann（abc", ["Ann（abc", "Annabc", "Ann", "abc"]), ("x", []), ("", []), (None, []), ("用户12", []), ("♥♥", []),
    ("aa(bb(cc)dd)ee", ["aa(bb(cc)dd)ee", "aaee", "aa", "ee", "bbccdd"]),
])
def test_variants(name, want):
    assert X.name_variants(name) == want


def test_uid_codes(spark):
    got = one(spark, X.uid_codes(F.col("s")), value=("用户3429924750（xxy）和用户12345 (ab) 用户3429924750（xxy） 用户12 (no)",))
    assert [(r["uid"], r["code"]) for r in got] == [("3429924750", "xxy"), ("12345", "ab")]


@pytest.mark.parametrize("text, want", [('```json\n{"a": 1}\n```', {"a": 1}), ('so {"a": True, "b": [1,],} ok', {"a": True, "b": [1]}), ("[1, 2]", [1, 2]), ('{"s": "x, }"}', {"s": "x, }"}), ("none", None), ("", None), (None, None)])
def test_loose_json(text, want):
    assert X.loose_json(text) == want


def test_render():
    assert X.render("{{x}} {a} {b}", a=1) == "{x} 1 {b}"


NOW = dt.datetime(2024, 6, 15, 12, 0)


@pytest.mark.parametrize("ago, mode, want", [
    (dt.timedelta(hours=2), "both", "今天 · 6月15日 10:00"), (dt.timedelta(days=1), "relative", "昨天"), (dt.timedelta(days=3), "both", "3天前 · 6月12日 12:00"), (dt.timedelta(days=10), "both", "约1周前 · 6月5日"),
    (dt.timedelta(days=45), "relative", "约1个月前"), (dt.timedelta(days=366), "both", "约1年前 · 2023年6月15日"), (dt.timedelta(minutes=-1), "both", ""), (dt.timedelta(days=8), "absolute", "6月7日"), (dt.timedelta(days=1), "odd", "昨天"),
])
def test_time_label(spark, ago, mode, want):
    assert one(spark, X.time_label(F.col("t"), F.col("n"), "UTC", mode), "t timestamp, n timestamp", (NOW - ago, NOW)) == want


@pytest.mark.parametrize("s, want", [(5, "5秒前"), (60, "1分前"), (61, "1分1秒前"), (3600, "1小时前"), (3660, "1小时1分前"), (86400, "1天前"), (90000, "1天1小时前"), (-1, "")])
def test_relative_precise(spark, s, want):
    assert one(spark, X.relative_precise(F.col("t"), F.col("n")), "t timestamp, n timestamp", (NOW - dt.timedelta(seconds=s), NOW)) == want


def test_packets(spark):
    assert one(spark, X.unmimicked(F.col("s")), value=('<msg ts="2024-01-01" uid="1">hi',)) == "＜msg 时间：2024-01-01＂ 用户ID：1＂＞hi"
    assert one(spark, X.unmimicked(F.col("s")), value=('say "hi"',)) == 'say "hi"'
    assert one(spark, X.sanitized(F.col("s")), value=('x" uid="7\n',)) == "x＂ 用户ID：7 "


@pytest.mark.parametrize("text, want", [("", True), ("half，", True), ("done", False), ("【话题】", True), ("【话题】猫", False), ("【话题】猫\nbody", False), ("a\nb、", True)])
def test_truncated(spark, text, want):
    assert one(spark, X.truncated(F.col("s")), value=(text,)) is want


def test_messages(spark):
    p = one(spark, X.session_parts(F.col("s")), value=("qq:gm:12:3",))
    assert (p["platform"], p["session_id"], p["group_id"], p["user_id"]) == ("qq", "12:3", "12:3", "")
    assert one(spark, X.session_parts(F.col("s")), value=("qq:sm:1",)) is None
    assert one(spark, X.content_time(F.col("s")), value=("[Sep 10 2026 18:44 Thu] hi",)) == dt.datetime(2026, 9, 10, 18, 44)
    for bad in ("[Xxx 10 2026 18:44 Thu]", "[Feb 31 2026 18:44 Thu]", "x" * 70 + "[Sep 10 2026 18:44 Thu]", None):
        assert one(spark, X.content_time(F.col("s")), value=(bad,)) is None
    assert one(spark, X.epoch_time(F.col("n")), "n long", (1_700_000_000_000,)) == one(spark, X.epoch_time(F.col("n")), "n long", (1_700_000_000,))


def test_config():
    Config().check()
    assert Config().archive_days() == 300
    for bad in (Config(demote=5), Config(promote=11), Config(naming_promote=2.0, decay=0.5)):
        with pytest.raises(ValueError):
            bad.check()


@pytest.mark.parametrize(("text", "want"), [
    ("{'a': 'it\\'s', 'b': None, c: True}", {"a": "it's", "b": None, "c": True}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "cut off', {"a": "cut off"}),
    ('say {"a": {"b": 1}, "c": [1,],} end', {"a": {"b": 1}, "c": [1]}), ('[{"x": 1}, {"x": 2', [{"x": 1}, {"x": 2}]), ("no json", None), ("", None), ('{"t": "note: True, }"}', {"t": "note: True, }"}),
])
def test_json_is_read_leniently(text, want):
    assert X.loose_json(text) == want


def test_numbers_survive_skew(spark):
    """One outlier and many equal times: numbers are consecutive and in order, and no range holds most rows."""
    from memlattice.functions import numbering

    df = spark.range(20_000).select(F.when(F.col("id") == 7, 0.0).when(F.col("id") % 3 == 0, 1e9).otherwise(1e9 + F.col("id") / 1e6).alias("t"), (F.col("id") * 7919 % 20_011).alias("k"))
    parts = []
    out = numbering.numbered(df, F.col("t"), ["k"], "n", 5).withColumn("part", F.spark_partition_id())
    rows = sorted(out.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(6, 20_006))
    assert [(r["t"], r["k"]) for r in rows] == sorted((r["t"], r["k"]) for r in rows)
    placed = df.repartitionByRange(4, "t", "k").groupBy(F.spark_partition_id()).count().collect()
    parts = [r["count"] for r in placed]
    assert max(parts) < 0.5 * sum(parts)
    assert numbering.numbered(df.limit(0), F.col("t"), ["k"]).count() == 0
