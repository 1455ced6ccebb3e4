"""Memory tables derived from the driver's tables by SQL that Spark and DuckDB both run.

Tokens in braces differ by engine; names in braces are views. ``frame`` gives a view as a DataFrame, ``oracle`` puts
the views that a DuckDB query names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources import scratch

#: The clock of every query: a literal, so that results are replayable.
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS = {
    "v_summary": """
        SELECT d.doc_id AS id, concat(d.source, '-', substring(md5(d.text), 1, 12)) AS document_id,
            CASE WHEN e.event_type = 'error' THEN 'bot_self' ELSE 'chat_summary' END AS kind, d.lang AS platform, d.source AS session_id,
            CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE d.source END AS group_id, CAST(e.user_id AS STRING) AS user_id,
            {array}(concat(d.lang, ':', CAST(e.user_id AS STRING)), concat(d.lang, ':', CAST(coalesce(f.user_id, e.user_id) AS STRING))) AS participants,
            d.text AS content, e.ts AS occurred_at, e.ts AS written_at, (d.doc_id % 11 <> 0) AS summarized, (d.doc_id % 17 = 0) AS archived,
            CASE WHEN d.doc_id % 5 = 0 THEN e.ts ELSE NULL END AS last_recall_at, v.embedding AS embedding
        FROM {documents} d JOIN {events} e ON e.event_id = d.doc_id LEFT JOIN {events} f ON f.event_id = d.doc_id + 1
            LEFT JOIN {embeddings} v ON v.vec_id = d.doc_id""",
    "v_fact": """
        SELECT event_id AS id, concat('f', CAST(event_id AS STRING)) AS document_id, 'qq' AS platform, CAST(user_id AS STRING) AS user_id,
            CASE WHEN event_id % 4 = 0 THEN {array}(CAST(user_id + 1 AS STRING)) ELSE {empty} END AS related_user_ids,
            CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('name', CAST(user_id AS STRING)) END AS display_name,
            CASE event_id % 8 WHEN 0 THEN 'identity' WHEN 1 THEN 'stable' WHEN 2 THEN 'preference' WHEN 3 THEN 'commitment' WHEN 4 THEN 'interaction'
                WHEN 5 THEN 'naming' WHEN 6 THEN 'recent' ELSE 'uncertain' END AS category,
            concat(event_type, ' ', props) AS statement, event_type, CASE WHEN value > 60 THEN 'high' ELSE 'medium' END AS confidence,
            concat('s', CAST(user_id % 10 AS STRING)) AS session_id, concat('s', CAST(user_id % 10 AS STRING), '|', CAST(CAST(ts AS DATE) AS STRING)) AS evidence_key,
            ts AS occurred_at, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS extracted_flag
        FROM {events}""",
    "v_evidence": """
        SELECT platform, user_id, category, event_type, evidence_key, max(CASE WHEN confidence = 'high' THEN 3.0 ELSE 2.0 END) AS points,
            min(id) AS first_id, min(occurred_at) AS first_at, max(occurred_at) AS last_at
        FROM {v_fact} GROUP BY platform, user_id, category, event_type, evidence_key""",
    "v_cluster": """
        SELECT id, platform, user_id, category, canonical_statement, score,
            CASE WHEN id % 29 = 0 THEN 'dead' WHEN id % 13 = 0 THEN 'pending_uncertain' WHEN id % 31 = 0 THEN 'replaced'
                WHEN score >= CASE category WHEN 'recent' THEN 4.0 WHEN 'naming' THEN 3.0 ELSE 6.0 END AND id % 3 <> 0 THEN 'profiled' ELSE 'active' END AS status,
            evidence_count, evidence_keys, last_evidence_at, occurred_at, last_evidence_at AS updated_at,
            CASE WHEN id % 13 = 0 THEN occurred_at ELSE NULL END AS demoted_at, CASE WHEN id % 17 = 0 THEN last_evidence_at ELSE NULL END AS contradicted_at,
            CASE WHEN id % 4 = 0 THEN {array}(CAST(CAST(user_id AS INT) + 1 AS STRING)) ELSE {empty} END AS related_user_ids
        FROM (SELECT min(first_id) AS id, platform, user_id, category, event_type AS canonical_statement, CAST(least(10.0, sum(points)) AS DOUBLE) AS score,
            CAST(count(*) AS INT) AS evidence_count, {sorted}(evidence_key)) AS evidence_keys, max(last_at) AS last_evidence_at, min(first_at) AS occurred_at
            FROM {v_evidence} GROUP BY platform, user_id, category, event_type) g""",
    "v_profile": """
        SELECT id, platform, user_id, category, id AS cluster_id, canonical_statement AS statement, score, occurred_at AS created_at, updated_at, related_user_ids
        FROM {v_cluster} WHERE status = 'profiled'""",
    "v_alias": """
        SELECT c.c_custkey AS id, 'qq' AS platform, CAST(c.c_custkey % 150 AS STRING) AS user_id,
            CASE WHEN c.c_custkey % 7 = 0 THEN 'unknown' WHEN c.c_custkey % 11 = 0 THEN CAST(c.c_custkey AS STRING) ELSE concat(c.c_mktsegment, ' ', CAST(c.c_custkey % 400 AS STRING)) END AS name,
            min(o.o_orderdate) AS first_seen, max(o.o_orderdate) AS last_seen, 'batch' AS source
        FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_mktsegment""",
    "v_edge": """
        SELECT row_number() OVER (ORDER BY subject_uid, object_uid, relation_label) AS id, 'qq' AS platform, subject_uid, object_uid,
            CASE WHEN n % 5 = 0 THEN 'unknown' ELSE concat('old', subject_uid) END AS subject_name, concat('old', object_uid) AS object_name, relation_label,
            concat(subject_uid, ' ', relation_label, ' ', object_uid) AS statement,
            CASE WHEN n % 7 = 0 THEN 'superseded' WHEN n % 3 = 0 THEN 'pending' ELSE 'active' END AS status,
            CASE WHEN n > 4 THEN 'high' ELSE 'medium' END AS confidence, CAST(n AS INT) AS evidence_count,
            CASE WHEN n % 4 = 0 THEN {array}(concat('backfill|', CAST(lo AS STRING)), concat('backfill|', CAST(hi AS STRING))) ELSE {array}(concat('s|', CAST(lo AS STRING))) END AS evidence_keys,
            first_seen, last_seen, last_seen AS occurred_at, last_seen AS updated_at
        FROM (SELECT CAST(o.o_custkey % 150 AS STRING) AS subject_uid, CAST(l.l_suppkey % 150 AS STRING) AS object_uid, lower(substring(o.o_orderpriority, 1, 9)) AS relation_label,
            count(DISTINCT o.o_orderkey) AS n, min(o.o_orderkey) AS lo, max(o.o_orderkey) AS hi, min(o.o_orderdate) AS first_seen, max(o.o_orderdate) AS last_seen
            FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey % 150 <> l.l_suppkey % 150
            GROUP BY o.o_custkey % 150, l.l_suppkey % 150, lower(substring(o.o_orderpriority, 1, 9))) g""",
    "v_line": """
        SELECT conv_id, turn, role, text, concat('qq:', CASE WHEN conv_id % 2 = 0 THEN 'gm:' ELSE 'dm:' END, CAST(conv_id % 20 AS STRING)) AS session_key,
            CASE WHEN role = 'assistant' THEN 'bot' ELSE CAST(conv_id % 7 AS STRING) END AS uid
        FROM {conversations}""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SPARK = {"array": "array", "empty": "cast(array() AS array<string>)", "sorted": "array_sort(collect_set"}
DUCK = {"array": "list_value", "empty": "CAST([] AS VARCHAR[])", "sorted": "list_sort(list"}
_TOKEN = re.compile(r"\{(\w+)\}")


def _fill(sql: str, words: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: words[m[1]], sql)


_stored: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or a view, as a DataFrame. A view is stored once for an application and tables, as memory tables are."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:

        def text(view: str) -> str:
            words = SPARK | {b: f"parquet.`{sf_dir}/{b}.parquet`" for b in BASE}
            return _fill(VIEWS[view], words | {v: f"({text(v)})" for v in VIEWS if "{" + v + "}" in VIEWS[view]})

        made = spark.sql(text(name))
        path = scratch.path(spark, name)
        made.write.parquet(path)
        _stored[key] = (path, made.schema)
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it uses in front; {now} is the clock."""
    used: list[str] = []

    def want(text: str) -> None:
        for m in re.findall(r"\bv_\w+", text):
            if m in VIEWS and m not in used:
                want(VIEWS[m])
                used.append(m)

    want(sql)
    heads = [f"{v} AS ({_fill(VIEWS[v], DUCK | {b: b for b in BASE} | {x: x for x in VIEWS})})" for v in used]
    body = sql.replace("{now}", NOW).strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body[: len(start)].upper() == start:
            return start + ", ".join([*heads, body[len(start) :]])
    return f"WITH {', '.join(heads)} {body}" if heads else body
