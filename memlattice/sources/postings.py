"""Stored postings for the lexical leg: tokens are counted once, when a summary is written, and read by a pushed-down filter."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import search_tokens

#: Directories of the posting table; a query reads those of its tokens.
BUCKETS = 64
#: Text that one task makes postings of, in bytes: it writes a file for each bucket.
TASK_BYTES = 64 << 20


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def postings(rows: DataFrame, text: str = "content") -> DataFrame:
    """(bucket, token, id, tf, len) of rows (id, text): a row's sorted tokens are cut into runs, so nothing is exchanged."""
    tokens = rows.select("id", F.array_sort(search_tokens(F.col(text))).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = tokens.filter(F.size("t") > 0).select("id", "t", F.size("t").alias("len"), starts.alias("s"))
    each = runs.select("id", "len", F.explode(F.transform("s", lambda x, k: F.struct(F.get("t", x).alias("token"), (F.coalesce(F.get("s", k + 1), F.col("len")) - x).alias("tf")))).alias("p"))
    return each.select(F.pmod(F.crc32(F.col("p.token").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"), "p.token", "id", "p.tf", "len")


def stats(rows: DataFrame, text: str = "content") -> DataFrame:
    """One row (n, avg) of all rows, those without a token included."""
    return rows.select(F.size(search_tokens(F.col(text))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))


def write(rows: DataFrame, root: str, text: str = "content") -> None:
    """Writes both under root; postings lie by bucket, and within a file by token, so that its statistics prune the rest.

    Each task writes what its own rows hold: postings outweigh the texts, so they are sorted where they are made and never
    exchanged. A token that every row holds lies in as many files as there are tasks.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    few = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    made = postings(rows.select("id", text).coalesce(few), text).sortWithinPartitions("bucket", "token", "id")
    made.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings")
    stats(rows, text).coalesce(1).write.mode("overwrite").parquet(f"{root}/stats")


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/stats")
