"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.sources.tables import shared_base

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of ours in the one that driver and executors share (see `shared_base`)."""
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"{shared_base(spark)}/veilspan-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _own_dirs[app])
    return _own_dirs[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session ended before the interpreter did
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder. This cuts the lineage: a lost
    executor costs a read of the table, not the work that made it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_memo() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.__dict__.setdefault("_veilspan_memo", {})


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
