"""Text functions that agree with Python's ``str`` where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType

_OUTER = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(c: Column) -> Column:
    """Without outer white space, every code point of ``str.isspace`` counted."""
    return F.regexp_replace(c, _OUTER, "")


def strip_fences(c: Column) -> Column:
    """Without a leading code fence (and the rest of its line) and without a closing one."""
    opened = F.regexp_replace(strip(c), r"^`{3}(?:[^\n]*\n)?", "")
    return strip(F.regexp_replace(opened, r"`{3}\z", ""))


def strip_fences_py(content: str) -> str:
    """``strip_fences`` for one Python string."""
    content = content.strip()
    if content.startswith("```"):
        line, newline, rest = content.partition("\n")
        content = rest if newline else line[3:]
    return content.removesuffix("```").strip()


def py_str(c: Column, kind: DataType) -> Column:
    """``str(value)``: ``None`` for null, ``True``/``False``, and Python's shortest form of floating point numbers."""
    if isinstance(kind, BooleanType):
        shown = F.initcap(c.cast("string"))
    elif isinstance(kind, (DoubleType, FloatType)):
        shown = _py_float(c.cast("double"))
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("None"))


def _py_float(c: Column) -> Column:
    """Java's digits are Python's; only the place of the point and the exponent's form differ."""
    java = c.cast("string")
    digits = F.regexp_replace(F.regexp_extract(java, r"^-?([0-9.]+)", 1), r"\.0$", "")
    sign = F.when(java.startswith("-"), "-").otherwise("")
    exponent = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int")
    bare = F.regexp_replace(digits, r"\.", "")
    plain = F.when(exponent >= 0, F.concat(F.rpad(bare, exponent + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), bare))
    # with as many digits as the exponent has places the point falls inside
    inside = F.concat(F.substring(bare, 1, exponent + 1), F.lit("."), F.when(F.length(bare) > exponent + 1, F.substring(bare, exponent + 2, F.lit(40))).otherwise("0"))
    far = F.concat(digits, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), "0"))
    shown = F.when((exponent >= 16) | (exponent < -4), far).when((exponent >= 0) & (F.length(bare) > exponent + 1), inside).otherwise(plain)
    special = F.when(F.isnan(c), "nan").when(java == "Infinity", "inf").when(java == "-Infinity", "-inf")
    return F.coalesce(special, F.when(exponent.isNull(), java).otherwise(F.concat(sign, shown)))
