"""Scalar functions as Column expressions; pandas UDFs only where Unicode tables or nesting need them."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the rules: placeholder names, fallback names, labels.
PLACEHOLDER = r"(?i)^(unknown|undefined|用户[0-9]+|[0-9]+|未知(用户)?[0-9]*)$"
FALLBACK = r"^用户\d+$"
FACT_CODE = r"用户(\d{4,})\s*[（(]\s*([^()（）]{1,24}?)\s*[）)]"
SESSION = r"^([^:]+):(dm|gm):(.+)$"
NOTICE = r"Notice\s*\[[^\]]*user_id:\s*system[\w-]*"
CONTENT_TIME = r"\[([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{4})\s+(\d{2}):(\d{2})(?::(\d{2}))?\s+[A-Z][a-z]{2}\]"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
PACKET_KEYS = (('ts="', "时间："), ('uid="', "用户ID："), ('name="', "昵称："), ('self="true"', "本人发言"), ('at_bot="true"', "@了机器人"), ('quote name="', "引用："))
PACKET_MARK = r'<msg\s+ts="\d{4}-\d{2}-\d{2}|<msg\s[^>\n]*|</msg\s*>|<quote\s+name="[^">\n]*">'
BRACKETS = {"(": ")", "（": "）", "[": "]", "【": "】", "〔": "〕", "<": ">", "《": "》"}


# -- keys -------------------------------------------------------------------------------------------------------


def hash12(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def summary_key(session: Column, content: Column) -> Column:
    return F.concat(session, F.lit("-"), hash12(content))


def document_key(kind: Column, session: Column, content: Column) -> Column:
    """The id of a stored summary, by its kind."""
    h = hash12(content)
    return F.when(kind == "chat_summary", F.concat(session, F.lit("-"), h)).when(kind == "bot_self", F.concat(F.lit("bot-self-"), h)).otherwise(F.concat(kind, F.lit("-"), session, F.lit("-"), h))


def local_date(ts: Column, tz: str = "UTC", fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), fmt)


def evidence_key(session: Column, ts: Column, tz: str = "UTC") -> Column:
    return F.concat(session, F.lit("|"), local_date(ts, tz))


def fact_key(uids: Column, session: Column, ts: Column, statement: Column, tz: str = "UTC") -> Column:
    people = F.array_join(F.array_sort(F.array_distinct(F.filter(uids, lambda u: F.trim(u) != ""))), "-")
    return F.concat(people, F.lit("@"), evidence_key(session, ts, tz), F.lit("-"), hash12(statement))


def correction_key(uids: Column, session: Column, ts: Column, statement: Column, cluster: Column, tz: str = "UTC") -> Column:
    return fact_key(uids, session, ts, F.concat(statement, F.lit("#r"), cluster.cast("string")), tz)


def backfill_key(cluster: Column) -> Column:
    return F.concat(F.lit("backfill|"), cluster.cast("string"))


def relation_key(subject: Column, object_: Column, session: Column, ts: Column, statement: Column, tz: str = "UTC") -> Column:
    pair = F.array_join(F.array_sort(F.array(subject, object_)), "-")
    return F.concat(F.lit("rel-"), pair, F.lit("-"), session, F.lit("-"), local_date(ts, tz, "yyyyMMdd"), F.lit("-"), hash12(statement))


def composite(platform: Column, uid: Column) -> Column:
    return F.concat(platform, F.lit(":"), uid)


# -- text and vectors -------------------------------------------------------------------------------------------


def search_tokens(text: Column) -> Column:
    """Overlapping pairs of each CJK run (a single character stays), then lower-cased ASCII words; repeats stay."""
    t = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(t, F.lit("[\\x{4e00}-\\x{9fff}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(pairs, F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))


def search_text(text: Column) -> Column:
    return F.array_join(search_tokens(text), " ")


def _dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column) -> Column:
    """Null for a missing, empty or zero vector, or for different lengths."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(norm > 0, _dot(x, y) / norm))


def cosine_to(a: Column, query: list[float]) -> Column:
    """The cosine of a to a given vector, whose length is taken once; null as in cosine."""
    norm = sum(x * x for x in query) ** 0.5
    if not query or norm == 0:
        return F.lit(None).cast("double")
    x = a.cast("array<double>")
    own = _dot(x, x)
    return F.when((F.size(a) == len(query)) & (own > 0), _dot(x, F.array(*[F.lit(float(q)) for q in query])) / (F.sqrt(own) * F.lit(norm)))


def parse_vector(text: Column) -> Column:
    """A vector from its text form; malformed text is null."""
    v = F.from_json(text, "array<float>")
    return F.when(F.exists(v, lambda x: x.isNull()), None).otherwise(v)


def packed_vector(raw: Column, dims: Column | None = None) -> Column:
    """A vector from little-endian 32-bit floats; a length that is no multiple of 4, or not dims, is null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or not len(b) or len(b) % 4 else np.frombuffer(b, dtype="<f4"))

    v = read(raw)
    return v if dims is None else F.when(F.size(v) == dims, v)


def iso_time(ts: Column) -> Column:
    """A time as the text that the row store keeps: UTC, microseconds."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def json_list(text: Column) -> Column:
    """An array of strings from its JSON text; anything else is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def without_nul(text: Column) -> Column:
    """Text that every store takes: NUL characters become U+FFFD."""
    return F.replace(text, F.lit("\0"), F.lit("\ufffd"))


def message_line(name: Column, content: Column, ts: Column, uid: Column, is_self: Column, at_bot: Column, quote: Column) -> Column:
    """One message as a line of a packet: time, owner and flags as attributes, then the quote and the content."""

    def attr(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'{key}="'), value, F.lit('"'))

    known = F.coalesce(uid, F.lit("")) != ""
    named = attr("name", sanitized(F.coalesce(name, F.lit(""))))
    parts = [
        F.when(ts.isNotNull(), attr("ts", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))),
        F.when(~is_self & known, attr("uid", sanitized(uid))),
        named,
        F.when(is_self, F.lit('self="true"')).when(known & at_bot, F.lit('at_bot="true"')),
    ]
    return F.concat(F.lit("<msg "), F.concat_ws(" ", *parts), F.lit(">"), F.coalesce(quote, F.lit("")), unmimicked(F.coalesce(content, F.lit(""))), F.lit("</msg>"))


def like_contains(keyword: str) -> str:
    """LIKE pattern for a literal part of a text."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", keyword) + "%"


def is_placeholder(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n == "") | n.rlike(PLACEHOLDER)


def uid_codes(statement: Column) -> Column:
    """Array of (uid, code) named by a statement, each once, in order."""
    s = F.coalesce(statement, F.lit(""))
    return F.array_distinct(F.arrays_zip(F.regexp_extract_all(s, F.lit(FACT_CODE), F.lit(1)).alias("uid"), F.regexp_extract_all(s, F.lit(FACT_CODE), F.lit(2)).alias("code")))


def sanitized(value: Column) -> Column:
    """Field text without packet syntax."""
    for key, label in PACKET_KEYS:
        value = F.replace(value, F.lit(key), F.lit(label))
    return F.translate(value, '<>"\r\n', "＜＞＂  ")


def unmimicked(content: Column) -> Column:
    """Content that imitates a packet, made harmless; any other content unchanged."""
    out = content
    for key, label in PACKET_KEYS:
        out = F.replace(out, F.lit(key), F.lit(label))
    return F.when(content.rlike(PACKET_MARK), F.translate(out, '<>"', "＜＞＂")).otherwise(content)


def truncated(summary: Column) -> Column:
    """Whether a summary stops early: it ends in a comma or an opening bracket, or is a bare anchor."""
    t = F.trim(F.coalesce(summary, F.lit("")), F.lit(" \t\r\n"))
    lines = F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x) != "")
    tail = F.right(F.trim(F.element_at(lines, -1)), F.lit(1))
    return (t == "") | tail.isin(*"，、：；,;:（「『“‘《【(['") | ((F.size(lines) == 1) & F.rtrim(t, F.lit("】")).endswith("【话题"))


def is_notice(role: Column, sender: Column, content: Column) -> Column:
    return (role == "user") & (F.trim(F.coalesce(sender, F.lit(""))) == "") & F.substring(F.coalesce(content, F.lit("")), 1, 200).rlike(NOTICE)


def session_parts(session: Column) -> Column:
    """struct(platform, session_id, group_id, user_id) of a session name, or null."""
    p, kind, sid = (F.regexp_extract(session, SESSION, i) for i in (1, 2, 3))
    return F.when(session.rlike(SESSION), F.struct(p.alias("platform"), sid.alias("session_id"), F.when(kind == "gm", sid).otherwise("").alias("group_id"), F.when(kind == "dm", sid).otherwise("").alias("user_id")))


def content_time(content: Column) -> Column:
    """The time named within the first 64 characters of a message, or null."""
    head = F.substring(F.coalesce(content, F.lit("")), 1, 64)
    part = [F.regexp_extract(head, CONTENT_TIME, i) for i in range(7)]
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part[1]).cast("int")
    second = F.when(part[6] == "", F.lit(0)).otherwise(part[6].try_cast("int"))
    made = F.try_make_timestamp(part[3].try_cast("int"), month, part[2].try_cast("int"), part[4].try_cast("int"), part[5].try_cast("int"), second.cast("decimal(8,6)"))
    return F.when((part[0] != "") & (month > 0), made)


def epoch_time(ts: Column) -> Column:
    """Seconds or milliseconds since 1970, told apart at 1e12."""
    return F.timestamp_micros(F.when(ts > 1e12, ts * 1000).otherwise(ts * 1_000_000).cast("long"))


def importance_confidence(importance: Column) -> Column:
    return F.when(F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(importance, F.lit(5)))) >= 7, "high").otherwise("medium")


# -- time labels ------------------------------------------------------------------------------------------------


def days_between(ts: Column, now: Column, tz: str) -> Column:
    return F.datediff(F.from_utc_timestamp(now, tz).cast("date"), F.from_utc_timestamp(ts, tz).cast("date"))


def relative_part(days: Column) -> Column:
    def about(n: int, unit: str) -> Column:
        return F.concat(F.lit("约"), F.floor(days / n).cast("string"), F.lit(unit))

    return F.when(days <= 0, "今天").when(days == 1, "昨天").when(days < 7, F.concat(days.cast("string"), F.lit("天前"))).when(days < 30, about(7, "周前")).when(days < 365, about(30, "个月前")).otherwise(about(365, "年前"))


def relative_precise(ts: Column, now: Column) -> Column:
    s = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    sec = F.floor(s / 1_000_000).cast("long")

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    m, h, d = F.floor(sec / 60).cast("long"), F.floor(sec / 3600).cast("long"), F.floor(sec / 86400).cast("long")
    return (
        F.when(ts.isNull() | (s < 0), "").when(sec < 60, text(sec, "秒前"))
        .when(m < 60, F.when(sec % 60 == 0, text(m, "分前")).otherwise(text(m, "分", sec % 60, "秒前")))
        .when(h < 24, F.when(m % 60 == 0, text(h, "小时前")).otherwise(text(h, "小时", m % 60, "分前")))
        .otherwise(F.when(h % 24 == 0, text(d, "天前")).otherwise(text(d, "天", h % 24, "小时前")))
    )


def absolute_part(ts: Column, now: Column, tz: str) -> Column:
    local, today = F.from_utc_timestamp(ts, tz), F.from_utc_timestamp(now, tz)
    year = F.when(F.year(local) != F.year(today), F.concat(F.year(local).cast("string"), F.lit("年"))).otherwise("")
    date = F.concat(year, F.month(local).cast("string"), F.lit("月"), F.dayofmonth(local).cast("string"), F.lit("日"))
    return F.when(days_between(ts, now, tz) < 7, F.concat(date, F.lit(" "), F.date_format(local, "HH:mm"))).otherwise(date)


def time_label(ts: Column, now: Column, tz: str = "UTC", mode: str = "both") -> Column:
    """Empty for null and future times; an unknown mode counts as relative."""
    rel, ab = relative_part(days_between(ts, now, tz)), absolute_part(ts, now, tz)
    label = {"absolute": ab, "both": F.concat(rel, F.lit(" · "), ab)}.get(mode, rel)
    return F.when(ts.isNull() | (ts > now), "").otherwise(label)


def edge_qualifier(ts: Column, tz: str = "UTC") -> Column:
    local = F.from_utc_timestamp(ts, tz)
    return F.when(ts.isNull(), "").otherwise(F.concat(F.lit("截至"), F.month(local).cast("string"), F.lit("月"), F.dayofmonth(local).cast("string"), F.lit("日")))


def decay_factor(ts: Column, now: Column, half_life_days: float) -> Column:
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000)
    return F.when(ts.isNull(), 1.0).otherwise(F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / F.lit(half_life_days)))


def append_once(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


# -- Unicode and nesting ------------------------------------------------------------------------------------------


def normalize_alias(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").casefold()


def clean_alias(name: str | None) -> str:
    out = (name or "").strip()
    return "" if len(out) < 2 or re.match(FALLBACK, out) or sum(c.isalnum() for c in out) < 2 else out


def _by_brackets(text: str) -> tuple[list[str], list[str]]:
    """(parts outside of any bracket, parts inside an outermost pair), each without inner brackets, blank ones left out."""
    outside, inside = [""], [""]
    depth = 0
    for c in text:
        if c in BRACKETS:
            depth += 1
            if depth == 1:
                outside.append("")
                inside.append("")
        elif depth and c in BRACKETS.values():
            depth -= 1
        else:
            (inside if depth else outside)[-1] += c
    if depth:  # never closed: what follows the bracket is a part of the outside
        outside.append(inside.pop())
    return [p.strip() for p in outside if p.strip()], [p.strip() for p in inside if p.strip()]


def name_variants(name: str | None) -> list[str]:
    """The name, its text outside brackets, each outer part and each bracketed part; cleaned, each once."""
    whole = (name or "").strip()
    outer, inner = _by_brackets(whole)
    forms = [whole, "".join(outer).replace(" ", ""), *outer, *inner]
    cleaned = [clean_alias(f) for f in forms if f]
    return list(dict.fromkeys(c for c in cleaned if c))


class _Lenient:
    """Reads what is meant as JSON: either quote, Python's literals, bare words, stray commas, and an end that is missing."""

    LITERALS = {"true": True, "false": False, "null": None, "none": None}

    def __init__(self, text: str, at: int) -> None:
        self.text, self.at = text, at

    def peek(self, skip: str = " \t\r\n") -> str:
        while self.at < len(self.text) and self.text[self.at] in skip:
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self):
        c = self.peek()
        if c == "{":
            return self.members()
        if c == "[":
            return self.items()
        if c in ("'", '"'):
            return self.string(c)
        word = self.bare(",]}")
        if word.lower() in self.LITERALS:
            return self.LITERALS[word.lower()]
        try:
            return json.loads(word)
        except ValueError:
            return word

    def string(self, quote: str) -> str:
        start = self.at = self.at + 1
        while self.at < len(self.text) and self.text[self.at] != quote:
            self.at += 2 if self.text[self.at] == "\\" else 1
        raw = self.text[start : self.at]
        self.at += 1
        body = raw.replace('\\\'', "'") if quote == "'" else raw
        try:
            return json.loads('"' + (body.replace('"', '\\"') if quote == "'" else body) + '"', strict=False)
        except ValueError:
            return body

    def bare(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops:
            self.at += 1
        return self.text[start : self.at].strip()

    def items(self) -> list:
        self.at, out = self.at + 1, []
        while (c := self.peek(" \t\r\n,")) and c != "]":
            if c == "}":  # closes an object that is further out
                return out
            out.append(self.value())
        self.at += 1
        return out

    def members(self) -> dict:
        self.at, out = self.at + 1, {}
        while (c := self.peek(" \t\r\n,")) and c != "}":
            if c == "]":
                return out
            key = self.string(c) if c in ("'", '"') else self.bare(":,}")
            if self.peek() == ":":
                self.at += 1
                out[key] = self.value()
            elif key:
                out[key] = None
        self.at += 1
        return out


def loose_json(text: str | None):
    """JSON from a model's answer: as it is without its fence, else read leniently from the first bracket; None if there is none."""
    body = re.sub(r"^```\w*|```$", "", (text or "").strip()).strip()
    try:
        return json.loads(body)
    except ValueError:
        pass
    # an answer that starts with a list is one; in prose, an object tells more than a list before it
    starts = [0] if body.startswith("[") else [i for i in (body.find("{"), body.find("[")) if i >= 0]
    return _Lenient(body, starts[0]).value() if starts else None


def matches(pattern: str, value: Column) -> Column:
    """1 where the pattern is found in value, in any case; 0 for null and, whatever the value, for a pattern that is none."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(0)
    return F.coalesce(value.rlike(f"(?i){pattern}").cast("int"), F.lit(0))


def render(template: str, **values: object) -> str:
    """{name} is replaced, {{ and }} are braces; unknown names stay."""
    return re.sub(r"\{\{|\}\}|\{(\w+)\}", lambda m: {"{{": "{", "}}": "}"}.get(m[0]) or str(values.get(m[1], m[0])), template)


@F.pandas_udf(T.StringType())
def normalized_alias(s: pd.Series) -> pd.Series:
    return s.map(normalize_alias)


@F.pandas_udf(T.StringType())
def cleaned_alias(s: pd.Series) -> pd.Series:
    return s.map(clean_alias)


@F.pandas_udf(T.ArrayType(T.StringType()))
def variants(s: pd.Series) -> pd.Series:
    return s.map(name_variants)


@F.pandas_udf(T.StringType())
def repaired_json(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if (v := loose_json(t)) is None else json.dumps(v, ensure_ascii=False))
