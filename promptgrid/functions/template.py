"""Prompt templates: parsed once on the driver, filled as one ``concat``.

Filling has two phases. ``{name}`` takes a value in the first, when ``{{name}}`` turns into ``{name}``, which the second
fills from the expansion's placeholders if the template uses any of them, and leaves alone if not. Braces inside values
mean nothing in either phase.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """Literal text, or the name of a field."""

    text: str
    field: bool = False


def _parse(text: str) -> list[Part]:
    parts: list[Part] = []
    for literal, name, spec, conversion in Formatter().parse(text):
        if literal:
            parts.append(Part(literal))
        if name is not None:
            if spec or conversion or not name.isidentifier():
                raise ValueError(f"unsupported field in template: {name!r}")
            parts.append(Part(name, True))
    merged: list[Part] = []
    for p in parts:
        if merged and not p.field and not merged[-1].field:
            merged[-1] = Part(merged[-1].text + p.text)
        else:
            merged.append(p)
    return merged


def used_keys(template: str, placeholders: Iterable[str]) -> list[str]:
    """Placeholders that occur in a template, in the placeholders' order; ``{{key}}`` contains ``{key}`` too."""
    return [k for k in placeholders if f"{{{k}}}" in template]


def _first_phase(template: str, fields: Iterable[str]) -> list[Part]:
    known = set(fields)
    parts = _parse(template)
    unknown = [p.text for p in parts if p.field and p.text not in known]
    if unknown:
        raise ValueError(f"template names unknown fields: {', '.join(unknown)}")
    return parts


def residual(template: str, fields: Iterable[str]) -> str:
    """What the second phase sees of a template: its literal text, a mark in place of each value."""
    return "".join("\0" if p.field else p.text for p in _first_phase(template, fields))


def compile_template(template: str, fields: Iterable[str], placeholders: Iterable[str] = (), always: bool = False) -> list[Part]:
    """Parts of a template whose mandatory fields are ``fields``. ``always``: the second phase runs in any case."""
    optional = list(placeholders)
    parts: list[Part] = []
    first = _first_phase(template, fields)
    if not always and not used_keys(residual(template, fields), optional):
        return first
    for p in first:
        parts.extend([p] if p.field else _parse(p.text))
    unknown = [p.text for p in parts if p.field and p not in first and p.text not in optional]
    if unknown:
        raise ValueError(f"template names unknown placeholders: {', '.join(unknown)}")
    return parts


def fill(parts: list[Part], values: Mapping[str, Column]) -> Column:
    """The filled template; a null value fills as ``None``."""
    if not parts:
        return F.lit("")
    return F.concat(*(F.coalesce(values[p.text].cast("string"), F.lit("None")) if p.field else F.lit(p.text) for p in parts))


def bound(parts: list[Part], texts: Mapping[str, object], columns: Mapping[str, str]) -> list[Part]:
    """A template's parts with the fields in ``texts`` filled; the others name the columns that fill them."""
    return [Part(columns[p.text], True) if p.field and p.text in columns else Part(str(texts[p.text])) if p.field else p for p in parts]


def fill_text(parts: list[Part], values: Mapping[str, object]) -> str:
    return "".join(str(values[p.text]) if p.field else p.text for p in parts)


def fill_sql(parts: list[Part], values: Mapping[str, str]) -> str:
    """DuckDB SQL of ``fill``."""
    quoted = [f"coalesce(({values[p.text]})::VARCHAR, 'None')" if p.field else "'" + p.text.replace("'", "''") + "'" for p in parts]
    return "(" + (" || ".join(quoted) or "''") + ")"
