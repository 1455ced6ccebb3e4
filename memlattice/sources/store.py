"""A versioned store of the memory tables: Parquet snapshots, a pointer to the current one, idempotent writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import search_text
from ..functions.numbering import hash_order, numbered
from ..schemas import TABLES


def backend(name: str, dsn: str = "") -> str:
    """auto means postgres with a dsn, else sqlite; both map to one snapshot store."""
    if name == "auto":
        return "postgres" if dsn else "sqlite"
    if name not in ("postgres", "sqlite"):
        raise ValueError(f"unknown backend: {name}")
    return name


class Store:
    """Tables under a root that any Spark file system serves. A commit writes a new snapshot, then one small pointer row."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_pointers")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.schema("name string, version long, path string").json(f"{self.root}/_pointers") if fs.exists(p) else None

    def version(self, name: str) -> tuple[int, str | None]:
        at = self._pointers()
        row = at.filter(F.col("name") == name).orderBy(F.desc("version")).first() if at is not None else None
        return (row["version"], row["path"]) if row else (0, None)

    def read(self, name: str) -> DataFrame:
        path = self.version(name)[1]
        return self.spark.createDataFrame([], TABLES[name]) if path is None else self.spark.read.schema(TABLES[name]).parquet(path)

    def write(self, name: str, df: DataFrame) -> int:
        """Typed to the table's schema (missing columns are null); readers of the snapshot before go on undisturbed."""
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]]
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.select(*cols).write.parquet(path)
        v = self.version(name)[0] + 1
        self.spark.createDataFrame([(name, v, path)], "name string, version long, path string").coalesce(1).write.mode("append").json(f"{self.root}/_pointers")
        return v

    # -- key-value and log ------------------------------------------------------------------------------------

    def get(self, key: str) -> str | None:
        row = self.read("kv").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def put(self, key: str, value: str, now: Column) -> None:
        one = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), now.alias("updated_at"))
        self.write("kv", self.read("kv").filter(F.col("key") != key).unionByName(one))

    def log(self, events: DataFrame, name: str = "recall_log") -> None:
        """Appends search and inject events as JSON lines."""
        events.write.mode("append").json(f"{self.root}/{name}")

    # -- versions of the schema -------------------------------------------------------------------------------

    def migrate(self, steps: list[tuple[int, str]], now: Column) -> list[int]:
        """Records forward-only versions that are not in the ledger yet."""
        done = {r["version"] for r in self.read("migrations").select("version").collect()}
        new = [(v, n) for v, n in sorted(steps) if v not in done]
        if new:
            rows = self.spark.createDataFrame(new, "version int, name string").withColumn("applied_at", now)
            self.write("migrations", self.read("migrations").unionByName(rows))
        return [v for v, _ in new]


def _next_ids(rows: DataFrame, old: DataFrame, at: Column, ties: list[str]) -> DataFrame:
    """rows with ids behind the last one of old, in the order of at and ties."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return numbered(rows.crossJoin(F.broadcast(top)), at, ties, "id", F.col("_top")).drop("_top")  # top: one row


def _insert(old: DataFrame, new: DataFrame, now: Column, extra: dict[str, Column]) -> DataFrame:
    """old and the rows of new whose document_id is unknown (of equal ones the earliest); future times become now."""
    w = Window.partitionBy("document_id").orderBy("occurred_at", F.xxhash64(*[c for c in new.columns if c != "participants"]))
    fresh = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(old.select("document_id"), "document_id", "left_anti")
    fresh = fresh.withColumn("occurred_at", F.least("occurred_at", now)).withColumns(extra)
    return old.unionByName(_next_ids(fresh, old, F.unix_micros(F.col("occurred_at").cast("timestamp")), ["document_id"]).select(*[c for c in old.columns if c in fresh.columns or c == "id"]), allowMissingColumns=True)


def insert_summaries(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    return _insert(old, new, now, {"written_at": now, "search_text": search_text(F.col("content")), "archived": F.lit(False), "recall_count": F.lit(0)})


def insert_facts(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    return _insert(old, new, now, {"written_at": now, "extracted_flag": F.lit(0)})


def upsert_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """As insert, but a known document takes the new display name unless that is empty; times stay as they are."""
    name = new.select("document_id", F.col("display_name").alias("_n"))
    kept = old.join(name, "document_id", "left").withColumn("display_name", F.coalesce(F.nullif("_n", F.lit("")), "display_name")).select(*old.columns)
    fresh = new.join(old.select("document_id"), "document_id", "left_anti").withColumn("extracted_flag", F.lit(0))
    return kept.unionByName(_next_ids(fresh, old, hash_order("document_id"), ["document_id"]), allowMissingColumns=True)


# -- scans for background work --------------------------------------------------------------------------------


_TEXT = {"summary": "content", "fact": "statement", "cluster": "canonical_statement"}


def missing_embeddings(table: str, rows: DataFrame, limit: int | None) -> DataFrame:
    """(id, text) of rows without a vector whose text is not blank: the first `limit` in id order, or all."""
    if table not in _TEXT:
        raise ValueError(f"no vectors in {table}")
    lacking = rows.filter(F.col("embedding").isNull() & (F.trim(F.col(_TEXT[table]), F.lit(" \t\r\n")) != "")).select("id", F.col(_TEXT[table]).alias("text"))
    return lacking if limit is None else lacking.orderBy("id").limit(limit)


def with_embeddings(rows: DataFrame, vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """rows with the vectors (id, vector) they lack; a vector of another length counts as none."""
    v = vectors.select("id", F.when(F.lit(True) if dims is None else F.size("vector") == dims, F.col("vector")).alias("_v"))
    return rows.join(v, "id", "left").withColumn("embedding", F.coalesce("embedding", F.col("_v").cast("array<float>"))).select(*rows.columns)


def vectors_of(rows: DataFrame, ids: list[int]) -> DataFrame:
    return rows.filter(F.col("id").isin(*ids) & F.col("embedding").isNotNull()).select("id", "embedding")


def unsummarized(rows: DataFrame, limit: int) -> DataFrame:
    return rows.filter(~F.col("summarized") & (F.col("kind") != "bot_self")).orderBy("id").limit(limit)


def encoded_back(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows with the encoded content and vector of (id, content, embedding); the document id stays."""
    j = rows.join(done.select("id", F.col("content").alias("_c"), F.col("embedding").alias("_e"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return j.withColumns({"content": F.coalesce("_c", "content"), "embedding": F.when(hit, F.col("_e").cast("array<float>")).otherwise(F.col("embedding")), "search_text": F.when(hit, search_text(F.coalesce("_c", "content"))).otherwise(F.col("search_text")), "summarized": F.col("summarized") | hit}).select(*rows.columns)


def with_search_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("search_text", F.coalesce("search_text", search_text(F.col("content"))))


def pending_facts(rows: DataFrame, limit: int) -> DataFrame:
    return rows.filter("extracted_flag = 0").orderBy("id").limit(limit)


# -- copying another store in ---------------------------------------------------------------------------------


def id_map(source: DataFrame, target: DataFrame, unique: list[str]) -> DataFrame:
    """(old_id, new_id): rows with a known unique key keep the target's id, the others go behind its last."""
    known = target.select(*unique, F.col("id").alias("_have"))
    j = source.select(F.col("id").alias("old_id"), *unique).join(known, unique, "left")
    fresh = _next_ids(j.filter(F.col("_have").isNull()).select("old_id"), target, F.col("old_id"), ["old_id"])
    have = j.filter(F.col("_have").isNotNull()).select("old_id", F.col("_have").cast("long").alias("new_id"))
    return have.unionByName(fresh.select("old_id", F.col("id").alias("new_id")))


def remapped(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """rows with column passed through an id map; unknown ids become null."""
    return rows.join(ids.select(F.col("old_id").alias(column), "new_id"), column, "left").withColumn(column, F.col("new_id")).drop("new_id")


def remapped_keys(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges whose backfill keys name the new cluster ids; keys of unknown clusters stay."""
    keys = edges.select("id", F.posexplode("evidence_keys").alias("pos", "k")).withColumn("old_id", F.when(F.col("k").rlike(r"^backfill\|[0-9]+$"), F.substring("k", 10, 20).cast("long")))
    new = keys.join(ids, "old_id", "left").withColumn("k", F.when(F.col("new_id").isNotNull(), F.concat(F.lit("backfill|"), F.col("new_id").cast("string"))).otherwise(F.col("k")))
    arr = new.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k"))), lambda x: x["k"]).alias("_keys"))
    return edges.join(arr, "id", "left").withColumn("evidence_keys", F.coalesce("_keys", "evidence_keys")).drop("_keys")


def payload_type() -> T.StructType:
    """A retain batch as stored JSON."""
    return T.StructType.fromDDL("session_id string, platform string, group_id string, user_id string, timestamp string, first_ts string, participants array<struct<platform:string,uid:string,name:string>>, history_lines array<string>, batch_lines array<string>, bot_lines array<string>, rounds int, failed string")


def parsed_pending(rows: DataFrame, now: Column) -> DataFrame:
    """Pending rows with a tolerant reading of their payload: malformed parts are empty, bad times now, rounds at least 1, failed only when said so."""
    p = F.from_json("payload", payload_type(), {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    return rows.withColumn("p", p).select(
        "session_key", *[F.coalesce(f"p.{c}", F.lit("")).alias(c) for c in ("session_id", "platform", "group_id", "user_id")],
        F.coalesce(F.try_to_timestamp("p.timestamp"), now).alias("timestamp"), F.coalesce(F.try_to_timestamp("p.first_ts"), F.try_to_timestamp("p.timestamp"), now).alias("first_ts"),
        F.coalesce("p.participants", F.array().cast("array<struct<platform:string,uid:string,name:string>>")).alias("participants"),
        *[F.coalesce(f"p.{c}", none).alias(c) for c in ("history_lines", "batch_lines", "bot_lines")],
        F.greatest(F.lit(1), F.coalesce("p.rounds", F.lit(1))).alias("rounds"), F.lower(F.coalesce("p.failed", F.lit(""))).isin("true", "1", "yes").alias("failed"),
    )


def copied(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report) after all of source is copied into target: ids are mapped, references and backfill keys follow.

    Rows whose unique key the target has are skipped. report: (name, source, skipped, copied, missing), where missing counts
    the keys of the source that the result lacks, 0 if all went well.
    """
    unique = {"summary": ["document_id"], "fact": ["document_id"], "cluster": ["platform", "user_id", "category", "canonical_statement"], "alias": ["platform", "user_id", "name"], "edge": ["platform", "subject_uid", "object_uid", "relation_label"], "kv": ["key"]}
    ids = {n: id_map(source[n], target[n], unique[n]) for n in ("summary", "fact", "cluster", "alias", "edge")}
    out, report = dict(target), None
    for name, key in unique.items():
        fresh = source[name].join(target[name].select(*key), key, "left_anti")
        if name in ids:
            fresh = remapped(fresh, ids[name])
        if name == "cluster":
            fresh = remapped(fresh, ids["cluster"], "replaced_by")
            facts_ = fresh.select("id", F.posexplode("source_fact_ids").alias("p", "old_id")).join(ids["fact"], "old_id")
            arr = facts_.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "new_id"))), lambda x: x["new_id"]).alias("_f"))
            fresh = fresh.join(arr, "id", "left").withColumn("source_fact_ids", F.coalesce("_f", F.array().cast("array<bigint>"))).drop("_f")
        if name == "edge":
            fresh = remapped_keys(fresh, ids["cluster"])
        out[name] = target[name].unionByName(fresh.select(*[c for c in target[name].columns if c in fresh.columns]), allowMissingColumns=True)
        n = source[name].agg(F.count("*").alias("source"))
        c = fresh.agg(F.count("*").alias("copied"))
        lost = source[name].join(out[name].select(*key), key, "left_anti").agg(F.count("*").alias("missing"))
        row = n.crossJoin(c).crossJoin(lost).select(F.lit(name).alias("name"), "source", (F.col("source") - F.col("copied")).alias("skipped"), "copied", "missing")  # one row each
        report = row if report is None else report.unionByName(row)
    new = remapped(source["profile"], ids["cluster"], "cluster_id").filter(F.col("cluster_id").isNotNull()).join(target["profile"].select("cluster_id"), "cluster_id", "left_anti")
    new = _next_ids(new.drop("id"), target["profile"], F.col("cluster_id"), [])
    out["profile"] = target["profile"].unionByName(new, allowMissingColumns=True)
    return out, report
