"""Scratch tables in the cluster's shared folder: they cut lineage, and a lost executor costs no recomputing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: The paths of the tables that the innermost open run has made, and where a DataFrame keeps its own.
_run: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("run", default=None)
_PATH = "_scratch_path"


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it.

    Where none is set, a session of one process (a local master, as in tests) gets a temporary folder; a cluster is
    refused, as its executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="memlattice-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new table's path; the table is deleted with its run, or when the application ends."""
    out = f"{scratch_dir(spark)}/memlattice/{name}-{uuid.uuid4().hex}"
    _made.append((spark, out))
    return out


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage; a lost executor costs no recomputing."""
    spark = df.sparkSession
    at = path(spark, name)
    if (own := _run.get()) is not None:
        own.append((spark, at))
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    setattr(out, _PATH, at)
    return out


def _delete(spark: SparkSession, at: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.remove((spark, at))


def drop(df: DataFrame) -> None:
    """Deletes the scratch table that saved() returned as df; nothing may read it any more."""
    at = getattr(df, _PATH, None) if isinstance(getattr(df, _PATH, None), str) else None
    if at and (df.sparkSession, at) in _made:
        _delete(df.sparkSession, at)


@contextlib.contextmanager
def run() -> Iterator[list[DataFrame]]:
    """Owns the scratch tables made inside: they are deleted at its end, but for those of the DataFrames put into the list that
    it gives. Tables of other runs, and of results that were made outside of any, stay as they are."""
    own: list[tuple[SparkSession, str]] = []
    keep: list[DataFrame] = []
    token = _run.set(own)
    try:
        yield keep
    finally:
        _run.reset(token)
        stays = {getattr(df, _PATH, None) for df in keep}
        outer = _run.get()
        for x in own:
            if x[1] not in stays:
                if x in _made:
                    _delete(*x)
            elif outer is not None:
                outer.append(x)


@atexit.register
def _at_end() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                for _, at in [x for x in _made if x[0] is spark]:
                    _delete(spark, at)
        except Exception:  # noqa: BLE001 - the JVM is gone already
            return
