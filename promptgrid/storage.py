"""Tables that cut lineage, in the folder all executors share.

A lazy result reads such tables when it is used, so they outlive the call that made them. They go when a ``scope`` ends,
for work that is done within it, and all others when the driver's JVM does. What is to be kept, such as an index or a
ledger for later batches, must be written elsewhere.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset, which only happens in local tests, one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = os.path.join(tempfile.gettempdir(), f"promptgrid-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if (paths := _scope.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete(df: DataFrame) -> None:
    """Remove the files behind a table from ``written``."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession, keep: bool = False) -> Iterator[list[str]]:
    """Tables that ``written`` makes within it go when it ends, by which time nothing may read them any more."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)
        for path in () if keep else paths:
            delete_path(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not use, in any letter case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name
