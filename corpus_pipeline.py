"""A training-data pipeline over documents: quality, toxicity, near copies, mixing, pieces.

Defined cases, stage by stage as its operator states them: null, empty and blank texts fail the quality rules and go; a
null source is a source of its own, a null id a document of its own that is never a near copy; rows with equal ids are
judged each by its text, and of those with the smallest id of a group of near copies one stays; very long texts are
taken whole in every stage; of a group of equal or near copies the smallest id wins; an empty table gives an empty
result in every stage; other columns, whatever their names, pass all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm import mixing, pieces, quality, simhash, toxicity
from memlattice.llm.common import documents, drop, run as scratch_run, saved
from memlattice.llm.queries import tokenizer_path
from memlattice.sources.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their host's boilerplate lines."""
    return quality.clean(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    return toxicity.clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of copies and near copies."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces) of each document."""
    out = pieces.encoded(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")).drop("text")
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [("quality", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("mixing", mix_sources), ("pieces", encode_pieces)]

#: A trained classifier, fingerprints and pieces are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again. A stage's own scratch tables go with it, those of
    other results stay."""
    ship(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch_run() as keep:
            after = saved(stage(spark, docs, sf_dir), name)
            keep.append(after)
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
