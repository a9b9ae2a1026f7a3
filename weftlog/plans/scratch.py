"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A session on one machine that names none gets a new folder of
    that machine; on a cluster, whose executors could not see it, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weftlog-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within go at its end, unless they are kept: their job is then done."""
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, keep: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Write df once to the shared folder and read it back: what follows starts from files.

    This cuts the lineage in a way that survives the loss of executors. Files are divided by the
    values of the columns in ``by``, which should have few.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    if not keep and (passing := _PASSING.get()) is not None:
        passing.append(path)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, *measures: Column, keep: bool = False) -> tuple[DataFrame, dict]:
    """materialize() with aggregates over its rows that the write counts on its way."""
    seen = Observation()
    out = materialize(df.observe(seen, *measures), name, keep)
    return out, seen.get
