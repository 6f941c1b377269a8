"""What the pipelines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from promptgrid import storage
from promptgrid.functions import hashing

NO_MAP = "map<string,string>"


def metadata(**values: Column | str) -> Column:
    if not values:
        return F.create_map().cast(NO_MAP)
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))]
    return F.create_map(*pairs)


def chosen_values(df: DataFrame, about: Column) -> Column:
    """``about`` with the placeholder values that the prompt was made with; its own keys win."""
    if "values" not in df.columns:
        return about
    own = F.map_keys(about)
    return F.map_concat(F.map_filter("values", lambda k, v: ~F.array_contains(own, k)), about)


def typed(df: DataFrame, schema: StructType, **columns: Column) -> DataFrame:
    """Exactly a row type's columns, in its order; what is neither given nor there is null."""
    have = set(df.columns)
    if "metadata" in columns:
        columns["metadata"] = chosen_values(df, columns["metadata"])
    return df.select(*(columns.get(f.name, F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def numbered_texts(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` written once, with a number ``row_id`` for each row, by which its text is found again: stages carry the
    number and leave the text behind. Any rows may repeat each other."""
    return storage.written(docs.withColumn("row_id", F.monotonically_increasing_id()), name)


def lineage(*parts: Column | str) -> Column:
    return hashing.row_uuid(*parts)
