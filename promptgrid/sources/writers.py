"""Sinks: JSON Lines, CSV, Parquet, and a folder ready for a dataset hub."""

from __future__ import annotations

import os
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from promptgrid.logs import log
from promptgrid.operators.split import train_test
from promptgrid.sources.card import card_text


def _mode(append: bool) -> str:
    return "append" if append else "errorifexists"


def to_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line, nulls kept, keys in the columns' order. No rows: no files."""
    if not df.isEmpty():
        df.write.mode(_mode(append)).option("ignoreNullFields", "false").json(path)


def to_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """Flat columns as they are, others as JSON; nulls are blank, empty texts ``""``. A null that is a row's only cell is
    written as an empty text, since a blank line is no row."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name) for f in df.schema.fields]
    if len(flat) == 1:
        flat = [F.coalesce(flat[0].cast("string"), F.lit("")).alias(df.columns[0])]
    df.select(*flat).write.mode(_mode(append)).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_parquet(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode(_mode(append)).parquet(path)


def cleaned(df: DataFrame) -> DataFrame:
    """For publication: empty ``metadata`` and ``confidence_scores`` are null, and gone where all rows' are."""
    for c in ("confidence_scores", "metadata"):
        if c in df.columns and isinstance(df.schema[c].dataType, MapType):
            df = df.withColumn(c, F.when(F.size(c) > 0, F.col(c)))
            if df.where(F.col(c).isNotNull()).isEmpty():
                df = df.drop(c)
    return df


def _files(spark: SparkSession, path: str):
    """(the path, its file system), wherever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str:
    place, files = _files(spark, path)
    if not files.exists(place):
        return ""
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    place, files = _files(spark, path)
    stream = files.create(place, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def export(df: DataFrame, path: str, repo_id: str, train_size: float | None = None, key: str = "uuid", seed: int = 42, shuffle: bool = True, card: bool = True) -> str:
    """A folder of Parquet shards, by split if ``train_size`` is given, with a card, on any file system that Spark writes."""
    spark = df.sparkSession
    rows = cleaned(df)
    if train_size is None:
        rows.write.mode("errorifexists").parquet(f"{path}/data/train")
        splits = {"train": spark.read.parquet(f"{path}/data/train").count()} if card else {}
    else:
        split = train_test(rows, train_size, key, seed, shuffle)
        split.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/data")
        splits = {r["split"]: r["count"] for r in spark.read.parquet(f"{path}/data").groupBy("split").count().collect()} if card else {}
    if card:
        _write_text(spark, f"{path}/README.md", card_text(repo_id, _read_text(spark, f"{path}/README.md"), rows.schema, splits))
    return path


class HubTransport(Protocol):
    """What an upload needs of a hub's client; ``huggingface_hub.HfApi`` has these methods."""

    def create_repo(self, repo_id: str, private: bool, repo_type: str, exist_ok: bool): ...
    def upload_folder(self, repo_id: str, folder_path: str, repo_type: str, commit_message: str, allow_patterns: list[str]): ...


def _client(token: str) -> HubTransport:
    try:
        from huggingface_hub import HfApi
    except ImportError as e:
        raise RuntimeError("an upload needs the package huggingface_hub, or a transport of your own") from e
    return HfApi(token=token)


def push(
    df: DataFrame, repo_id: str, path: str, token: str | None = None, private: bool = True, commit_message: str | None = None, train_size: float | None = None, key: str = "uuid", seed: int = 42, shuffle: bool = True, card: bool = True,
    transport: HubTransport | None = None,
) -> str:
    """Exports to ``path``, a folder that the driver can read as a local one, and uploads it; the dataset's id on the hub.

    The token is an argument or HF_TOKEN. ``transport`` stands in for the hub's client. A card that can't be uploaded is
    a warning; rows that can't be are an error.
    """
    if df.isEmpty():
        raise ValueError("there are no rows to push")
    token = token or os.environ.get("HF_TOKEN")
    if not token:
        raise ValueError("give a token or set HF_TOKEN")
    hub = transport or _client(token)
    export(df, path, repo_id, train_size, key, seed, shuffle, card)
    local = path.removeprefix("file://")
    hub.create_repo(repo_id, private=private, repo_type="dataset", exist_ok=True)
    message = commit_message or "New version of the data"
    hub.upload_folder(repo_id=repo_id, folder_path=local, repo_type="dataset", commit_message=message, allow_patterns=["data/**/*.parquet"])
    if card:
        try:
            hub.upload_folder(repo_id=repo_id, folder_path=local, repo_type="dataset", commit_message=message, allow_patterns=["README.md"])
        except Exception as e:
            log.warning("the card was not uploaded: %s", e)
    return repo_id
