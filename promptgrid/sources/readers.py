"""Sources: frames, local files by their extension, mirrored hub datasets."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from promptgrid.config import Source
from promptgrid.functions.text import strip
from promptgrid.operators.filters import head
from promptgrid.operators.order import numbered

#: Where hub datasets are mirrored, on any file system that Spark reads: <mirror>/<dataset>/<split>/*.parquet.
MIRROR = "PROMPTGRID_HUB_MIRROR"
__all__ = ["load_source", "numbered", "read_csv", "read_file", "read_hub", "read_jsonl", "read_txt", "source_name", "texts_only"]
EXTENSIONS = ("csv", "txt", "parquet", "jsonl", "json")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Header, line ends inside quotes; blank cells are null, quoted blank ones empty texts. Without a ``schema`` types are
    inferred in a pass of their own. ``multi_line=False`` lets large files be split, where no cell holds a line end."""
    # The parser gives blank cells this text. Were it blank too, empty texts would be null as well.
    blank = f"null-{uuid.uuid4().hex}"
    # By default a NUL would escape a quote and be lost beside one.
    options = {"header": True, "multiLine": multi_line, "escape": '"', "charToEscapeQuoteEscaping": '"', "nullValue": blank, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spark.read.csv(path, schema=schema, **options) if schema is not None else spark.read.csv(path, inferSchema=True, **options)


def read_txt(spark: SparkSession, path: str, text_column: str = "text") -> DataFrame:
    """Every line that isn't blank, stripped."""
    return spark.read.text(path).select(strip(F.col("value")).alias(text_column)).where(F.col(text_column) != "")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One JSON value a line, under either extension; a malformed line fails the read. Without a ``schema`` it is inferred
    in a pass of its own."""
    return spark.read.json(path, schema=schema, mode="FAILFAST", multiLine=False)


def read_file(spark: SparkSession, path: str, text_column: str = "text", schema: StructType | str | None = None) -> DataFrame:
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind == "txt":
        return read_txt(spark, path, text_column)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("jsonl", "json"):
        return read_jsonl(spark, path, schema)
    raise ValueError(f"unsupported file extension: {kind}; supported are {', '.join(EXTENSIONS)}")


def read_hub(spark: SparkSession, name: str) -> DataFrame:
    """The split ``train`` of a mirrored dataset, or its first by name."""
    root = os.environ.get(MIRROR)
    if not root:
        raise ValueError(f"{MIRROR} must name the folder in which hub datasets are mirrored")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    splits = sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory())
    if not splits:
        raise ValueError(f"no splits in {name}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/{'train' if 'train' in splits else splits[0]}")


def load_source(spark: SparkSession, source: Source, sample_count: int | None = None, text_column: str = "text", key: str | None = None) -> DataFrame:
    """The rows of a source, the first ``sample_count`` of them; in the order of ``key`` if it is given."""
    try:
        source.check()
        if source.frame is not None:
            rows = source.frame
        elif source.hf_dataset_name:
            rows = read_hub(spark, source.hf_dataset_name)
        else:
            rows = read_file(spark, source.local_file_path, text_column, source.schema)
        return head(rows, sample_count, *([key] if key else []))
    except Exception as e:
        raise ValueError(f"error loading dataset: {e}") from e


def texts_only(rows: DataFrame, column: str = "text") -> DataFrame:
    """The text column of the rows that have one."""
    return rows.where(F.col(column).isNotNull()).select(column)


def source_name(source: Source) -> str:
    if source.hf_dataset_name:
        return source.hf_dataset_name
    if source.local_file_path:
        return f"local_file:{source.local_file_path.split('/')[-1]}"
    return "unknown_source"
