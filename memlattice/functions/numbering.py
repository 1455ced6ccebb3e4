"""Consecutive numbers over a whole table without putting the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved

#: Bits of a row's place within its range, as Spark numbers rows by partition.
PLACE = 33


def numbered(df: DataFrame, at: Column, ties: list[str], into: str = "id", after: Column | int = 0) -> DataFrame:
    """df with `into`: after + 1, after + 2, ... in the order of at (a number, null as the least), then of ties.

    Rows are dealt into ranges of (at, ties) of about equal size, whatever at's distribution, sorted there and stored with their
    place; the ranges' sizes then shift the places. Ties make an order without equal rows, so a value of at that many rows
    share fills as many ranges as it needs. Runs a job.
    """
    order = [at.cast("double").asc_nulls_first(), *ties]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", PLACE)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))  # a row for each range
    first = F.lit(after) if isinstance(after, int) else after
    place = F.col("_place").bitwiseAND(F.lit((1 << PLACE) - 1))
    out = placed.join(F.broadcast(starts), part == F.col("_part")).withColumn(into, (first + F.col("_from") + place + 1).cast("long"))
    return out.drop("_part", "_from", "_place")


def hash_order(*cols: str) -> Column:
    """A number that orders rows by a hash of cols, for tables whose order does not matter."""
    return F.xxhash64(*cols)
