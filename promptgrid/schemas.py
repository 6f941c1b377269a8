"""Row types, reply shapes and the types built from a configuration."""

from __future__ import annotations

import json
import types
import typing
from dataclasses import dataclass
from typing import Any

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from promptgrid.functions.text import strip_fences_py

#: Values of every ``*_source`` column.
SOURCES = ("synthetic", "verified", "human", "consensus")

_S = StringType()
_META = MapType(_S, _S)
MESSAGES = ArrayType(StructType([StructField("role", _S), StructField("content", _S)]))


def _row(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


def _strings(*names: str) -> list[tuple[str, DataType]]:
    return [(n, _S) for n in names]


TEXT_ROW = _row(*_strings("text", "text_source", "model_id", "language", "uuid"), ("metadata", _META))
CHAT_ROW = _row(("opening_question", _S), ("messages", MESSAGES), *_strings("model_id", "language", "uuid"), ("metadata", _META), ("persona", _S))
CLASSIFICATION_ROW = _row(*_strings("text", "label", "model_id", "label_source"), ("confidence_scores", MapType(_S, DoubleType())), *_strings("language", "uuid"), ("metadata", _META))
MCQ_ROW = _row(
    *_strings("source_document", "question", "correct_answer", "incorrect_answer_1", "incorrect_answer_2", "incorrect_answer_3", "model_id", "mcq_source", "language", "uuid"), ("metadata", _META)
)
PREFERENCE_ROW = _row(
    *_strings("input_document", "question", "chosen_response", "rejected_response", "preference_source", "chosen_model_id", "rejected_model_id", "language"),
    ("chosen_response_score", IntegerType()),
    ("rejected_response_score", IntegerType()),
    *_strings("chosen_response_assessment", "rejected_response_assessment", "uuid"),
    ("metadata", _META),
)


def generic_row(input_columns: list[str], forward_columns: list[str] | None = None, output_columns: list[str] | None = None) -> StructType:
    """The generic pipeline's row: id, outputs, provenance, inputs, forwarded columns, metadata; a name's first place counts."""
    names = ["uuid", *(output_columns or ["generated_text"]), "model_id", "pipeline_source", "language", *input_columns, *(forward_columns or [])]
    return _row(*_strings(*dict.fromkeys(names)), ("metadata", _META))


@dataclass(frozen=True)
class Maybe:
    """A field that may be absent or null; ``default`` then."""

    shape: Any
    default: Any = None


@dataclass(frozen=True)
class Checked:
    """A shape whose values a user's model class must accept as well, such as a Pydantic one with constraints."""

    shape: Any
    model: Any


class Long:
    """A whole number of 64 bits, where ``int`` stands for 32."""


#: Reply shapes: a dict is an object, a list of one shape an array; ``str``, ``int``, ``float``, ``bool`` and ``Long``
#: themselves. ``shape_of`` makes one of a user's own type.
Shape = Any
TEXT_ENTRIES: Shape = {"entries": [str]}
TEXT_EXAMPLES: Shape = {"list_of_text_examples": [{"text": str}]}
QA_ENTRIES: Shape = {"entries": [{"question": str, "answer": str}]}
USER_QUESTIONS: Shape = {"questions": [str]}
QUESTION: Shape = {"question": str}
ANSWER: Shape = {"answer": str}
JUDGEMENT: Shape = {"assessment": str, "score": int}


def generic_reply(output_columns: list[str] | None = None) -> Shape:
    return {"entries": [{c: str for c in output_columns or ["generated_text"]}]}


_SCALARS = {str: _S, int: IntegerType(), Long: LongType(), float: DoubleType(), bool: BooleanType()}
_SIMPLE = {"string": str, "integer": int, "smallint": int, "tinyint": int, "long": Long, "double": float, "float": float, "boolean": bool}


def shape_of(kind: Any) -> Shape | None:
    """The shape of a reply type: a shape as it is, a Spark type or its DDL, or a model class with ``model_fields``."""
    if kind is None or isinstance(kind, (dict, list, Maybe, Checked)) or kind in _SCALARS:
        return kind
    if isinstance(kind, str):
        return shape_of(DataType.fromDDL(kind))
    if isinstance(kind, StructType):
        return {f.name: Maybe(shape_of(f.dataType)) if f.nullable else shape_of(f.dataType) for f in kind.fields}
    if isinstance(kind, ArrayType):
        return [shape_of(kind.elementType)]
    if isinstance(kind, DataType):
        if kind.typeName() in _SIMPLE:
            return _SIMPLE[kind.typeName()]
        raise TypeError(f"a reply can't hold a {kind.simpleString()}")
    if hasattr(kind, "model_fields"):
        fields = {}
        for name, f in kind.model_fields.items():
            inner = _annotated(f.annotation)
            inner = inner.shape if isinstance(inner, Maybe) and f.is_required() is False else inner
            fields[f.alias or name] = inner if f.is_required() else Maybe(inner, f.get_default(call_default_factory=True))
        return Checked(fields, kind)
    raise TypeError(f"unsupported reply type: {kind!r}")


def _annotated(kind: Any) -> Shape:
    """The shape of a model's annotation, where whole numbers are long."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind is int:
        return Long
    if origin is list:
        return [_annotated(args[0])]
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return Maybe(_annotated(rest[0])) if len(rest) < len(args) else _annotated(rest[0])
    if origin is typing.Literal and all(isinstance(a, str) for a in args) or isinstance(kind, type) and issubclass(kind, str):
        return str
    return shape_of(kind)


def spark_type(shape: Shape) -> DataType:
    if isinstance(shape, (Maybe, Checked)):
        return spark_type(shape.shape)
    if isinstance(shape, dict):
        return StructType([StructField(k, spark_type(v)) for k, v in shape.items()])
    if isinstance(shape, list):
        return ArrayType(spark_type(shape[0]))
    return _SCALARS[shape]


def json_schema(shape: Shape) -> dict[str, Any]:
    """The shape as a JSON schema, for services that hold their replies to one."""
    if isinstance(shape, Checked):
        return json_schema(shape.shape)
    if isinstance(shape, Maybe):
        inner = json_schema(shape.shape)
        return inner | {"type": [inner["type"], "null"]}
    if isinstance(shape, dict):
        return {"type": "object", "properties": {k: json_schema(v) for k, v in shape.items()}, "required": list(shape), "additionalProperties": False}
    if isinstance(shape, list):
        return {"type": "array", "items": json_schema(shape[0])}
    return {"type": {str: "string", float: "number", bool: "boolean"}.get(shape, "integer")}


def _plain(value: Any) -> Any:
    """A default or a model's value as JSON would have it."""
    return value.model_dump(mode="json") if hasattr(value, "model_dump") else value


def validate(shape: Shape, value: Any, at: str = "reply") -> Any:
    """``value`` in a shape, or ValueError: keys must be there (others are passed over), strings must be strings that
    UTF-8 can hold, an integer may come as a whole float, a boolean or a string of digits and must fit its width."""
    if shape is str and isinstance(value, str) and value.isascii():
        return value
    if isinstance(shape, Checked):
        try:
            shape.model.model_validate(value)
        except Exception as e:
            raise ValueError(f"{at}: {e}") from e
        return validate(shape.shape, value, at)
    if isinstance(shape, Maybe):
        return _plain(shape.default) if value is None else validate(shape.shape, value, at)
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            raise ValueError(f"{at}: not an object")
        missing = [k for k, s in shape.items() if k not in value and not isinstance(s, Maybe)]
        if missing:
            raise ValueError(f"{at}: missing {', '.join(missing)}")
        return {k: validate(s, value.get(k), f"{at}.{k}") for k, s in shape.items()}
    if isinstance(shape, list):
        if not isinstance(value, list):
            raise ValueError(f"{at}: not a list")
        return [validate(shape[0], v, f"{at}[{i}]") for i, v in enumerate(value)]
    if shape in (int, Long):
        return _whole(value, 31 if shape is int else 63, at)
    if shape is float:
        if isinstance(value, str):
            try:
                value = float(value)
            except ValueError:
                pass
        if isinstance(value, (int, float)) and abs(value) < 1e308:
            return float(value)
        raise ValueError(f"{at}: not a number")
    if shape is bool:
        words = {"true": True, "false": False}
        if isinstance(value, bool) or isinstance(value, str) and value.lower() in words:
            return value if isinstance(value, bool) else words[value.lower()]
        raise ValueError(f"{at}: not true or false")
    if not isinstance(value, str):
        raise ValueError(f"{at}: not a string")
    try:
        value.encode()
    except UnicodeEncodeError as e:
        raise ValueError(f"{at}: half a character") from e
    return value


def _whole(value: Any, bits: int, at: str) -> int:
    if isinstance(value, str) and len(value) < 40:
        try:
            value = int(value.strip())
        except ValueError:
            pass
    if isinstance(value, (bool, int)) or (isinstance(value, float) and value.is_integer()):
        if -(2**bits) <= value < 2**bits:
            return int(value)
        raise ValueError(f"{at}: not an integer of {bits + 1} bits")
    raise ValueError(f"{at}: not an integer")


def parse(shape: Shape | None, content: str) -> Any:
    """A reply's content in a shape; without one, its stripped text."""
    if shape is None:
        return validate(str, content.strip())
    try:
        return validate(shape, json.loads(strip_fences_py(content)))
    except RecursionError as e:
        raise ValueError("a reply nested too deeply") from e
    except ValueError as e:
        raise ValueError(f"{e}; content begins: {content[:200]}") from e
