"""Seeded draws and ids from MD5: the same for a row whatever its partition, attempt or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts: Column | str | int) -> Column:
    """MD5 of the parts joined by bars; nulls are empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(_text(p), F.lit("")) for p in parts)))


def draw(*parts: Column | str | int) -> Column:
    """32 bits as a long."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1)."""
    return draw(*parts) / F.lit(float(2**32))


def pick(values: Column, *parts: Column | str | int) -> Column:
    """An element of an array, by a seeded draw; null for an empty array."""
    return F.try_element_at(values, (F.floor(uniform(*parts) * F.size(values)) + 1).cast("int"))


def row_uuid(*parts: Column | str | int) -> Column:
    """An id in UUID form from the parts, so that a repeated task makes the same one."""
    whole = digest(*parts)
    return F.concat_ws("-", *(F.substring(whole, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid_sql(*parts: str) -> str:
    return f"regexp_replace({digest_sql(*parts)}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def digest_sql(*parts: str) -> str:
    """DuckDB SQL of ``digest`` over SQL expressions."""
    return "md5(" + " || '|' || ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts) + ")"


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr({digest_sql(*parts)}, 1, 8))::BIGINT / 4294967296.0)"
