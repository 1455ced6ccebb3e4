"""Import of chat histories: session files, fact files and profile files become rows of the memory tables."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import content_time, importance_confidence, is_notice, session_parts, summary_key

MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "content", "sender_id", "sender_name")])
SESSIONS = T.MapType(T.StringType(), T.StructType([T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("memory", T.ArrayType(T.ArrayType(MESSAGE)))]))
FACT_FILE = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("importance", T.IntegerType()), T.StructField("session", T.StringType()), T.StructField("time", T.StringType()), T.StructField("meta_ts", T.DoubleType())])


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_key, chunk_no, chunk) of session files: a JSON map from session to its chunks of messages."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", SESSIONS).alias("m"))
    return files.select(F.explode("m").alias("session_key", "s")).select("session_key", F.posexplode("s.memory").alias("chunk_no", "chunk"))


def host_sessions(rows: DataFrame) -> DataFrame:
    """(session_key, chunk_no, chunk) of host sessions (adapter, kind, sid, memory as JSON)."""
    chunks = F.from_json("memory", T.ArrayType(T.ArrayType(MESSAGE)))
    return rows.select(F.concat_ws(":", "adapter", "kind", "sid").alias("session_key"), F.posexplode(chunks).alias("chunk_no", "chunk"))


def _notice(m: Column) -> Column:
    return is_notice(m["role"], m["sender_id"], m["content"])


def _speaks(m: Column) -> Column:
    return (m["role"] == "user") & ~_notice(m) & (F.trim(F.coalesce(m["content"], F.lit(""))) != "")


def with_checks(chunks: DataFrame) -> DataFrame:
    """Adds notices (messages of the system) and importable (a user says something)."""
    return chunks.withColumns({"notices": F.size(F.filter("chunk", _notice)), "importable": F.exists("chunk", _speaks)})


def composed(chunk: Column, bot: str = "") -> Column:
    """The chunk's text: a line for each message but notices, with the speaker."""
    said = F.filter(chunk, lambda m: ~_notice(m) & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    who = lambda m: F.when(m["role"] == "assistant", F.lit(bot or "bot")).otherwise(F.coalesce(F.nullif(F.trim(m["sender_name"]), F.lit("")), F.nullif(F.trim(m["sender_id"]), F.lit("")), F.lit("user")))
    return F.array_join(F.transform(said, lambda m: F.concat(who(m), F.lit(": "), F.trim(m["content"]))), "\n")


def summary_rows(chunks: DataFrame, fallback: Column, bot: str = "") -> DataFrame:
    """Unencoded summaries of importable chunks: latest time named in the messages, people in order of appearance."""
    ok = with_checks(chunks).filter("importable").withColumn("p", session_parts(F.col("session_key"))).filter("p IS NOT NULL")
    senders = F.filter(F.transform(F.filter("chunk", lambda m: m["role"] == "user"), lambda m: F.trim(F.coalesce(m["sender_id"], F.lit("")))), lambda s: s != "")
    first = F.when(F.col("p.user_id") != "", F.col("p.user_id")).otherwise(F.coalesce(F.get("_s", F.lit(0)), F.lit("")))
    times = F.array_max(F.transform("chunk", lambda m: content_time(m["content"])))
    out = ok.withColumn("_s", senders).withColumn("content", composed(F.col("chunk"), bot)).filter("content <> ''").withColumn("user_id", first)
    people = F.array_distinct(F.transform(F.filter(F.concat(F.array("user_id"), "_s"), lambda u: u != ""), lambda u: F.concat("p.platform", F.lit(":"), u)))
    return out.select(
        summary_key(F.col("p.session_id"), F.col("content")).alias("document_id"), F.lit("chat_summary").alias("kind"), "p.platform", "p.session_id", "p.group_id", "user_id", people.alias("participants"), "content",
        F.coalesce(times, fallback).alias("occurred_at"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("summarized"),
    )


def preview(chunks: DataFrame) -> DataFrame:
    """One row: sessions, importable chunks and their messages, notices and chunks skipped."""
    c = with_checks(chunks)
    return c.agg(
        F.count_distinct("session_key").alias("sessions"), F.count("*").alias("chunks_total"), F.count_if("importable").alias("chunks"), F.count_if(~F.col("importable")).alias("bot_only"),
        F.coalesce(F.sum(F.when(F.col("importable"), F.size("chunk"))), F.lit(0)).alias("messages"), F.coalesce(F.sum("notices"), F.lit(0)).alias("notices"),
    )


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Fact files (TOML), a row each; files that do not parse are left out."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for raw in pdf["content"]:
                try:
                    d = tomllib.loads(bytes(raw).decode())
                except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                    rows.append({})
                    continue
                src, meta = d.get("source") or {}, d.get("meta") or {}
                rows.append({"id": d.get("id"), "type": d.get("type"), "text": d.get("text"), "importance": d.get("importance"), "session": src.get("session"), "time": None if src.get("time") is None else str(src["time"]), "meta_ts": meta.get("timestamp")})
            out = {"path": pd.Series(list(pdf["path"]), dtype=object), "modificationTime": pdf["modificationTime"].reset_index(drop=True)}
            yield pd.DataFrame(out | {f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in FACT_FILE})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.toml").load(path).select("path", "modificationTime", "content")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), *FACT_FILE.fields])
    return files.mapInPandas(parse, schema).filter(F.trim("text") != "")


def fact_rows(files: DataFrame, platform: str, user_id: str, display_name: str = "") -> DataFrame:
    """Raw facts of one person: the named time, else the source's, else the file's; importance from 7 on is high."""
    at = F.coalesce(F.timestamp_micros((F.col("meta_ts") * 1_000_000).cast("long")), F.try_to_timestamp("time"), "modificationTime")
    p = session_parts(F.col("session"))
    sid = F.coalesce(p["session_id"], F.lit("import"))
    return files.select(
        F.concat(F.lit(user_id + "@"), sid, F.lit("|"), F.date_format(at, "yyyy-MM-dd"), F.lit("-"), F.substring(F.md5(F.trim("text").cast("binary")), 1, 12)).alias("document_id"), F.lit(platform).alias("platform"), F.lit(user_id).alias("user_id"),
        F.array().cast("array<string>").alias("related_user_ids"), F.lit(display_name).alias("display_name"), F.lit("stable").alias("category"), F.trim("text").alias("statement"), importance_confidence(F.col("importance")).alias("confidence"),
        sid.alias("session_id"), F.coalesce(p["group_id"], F.lit("")).alias("group_id"), F.concat(sid, F.lit("|"), F.date_format(at, "yyyy-MM-dd")).alias("evidence_key"), at.alias("occurred_at"),
    )


def read_profiles(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """Names of profile files (JSON) as observations (platform, uid, name)."""
    schema = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("entity_type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("nickname", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    names = F.array_distinct(F.filter(F.concat(F.array("name", "nickname"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: F.trim(F.coalesce(n, F.lit(""))) != ""))
    return rows.filter("entity_type = 'user'").select(F.lit(platform).alias("platform"), F.col("entity_id").alias("uid"), F.explode(names).alias("name"))
