"""Scalar values out of JSON text, and one text form in which values of any type compare.

The comparable form keeps the type: strings are quoted JSON, numbers are plain (5.0 is 5), booleans are 1 and 0.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number_text(text: Column) -> Column:
    """The shortest form of a number's text."""
    value = text.try_cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def member(args: Column, key: str) -> Column:
    """The comparable form of a top-level or dotted key of JSON text; null where it is missing or not a scalar."""
    path = "$." + ".".join(key.split(".")) if key.replace(".", "").replace("_", "").isalnum() else f"$['{key}']"
    text = F.to_json(F.try_variant_get(F.try_parse_json(args), path, "variant"))
    return F.when(text.startswith('"'), text).when(text.isin("true"), "1").when(text.isin("false"), "0").when(text.rlike(r"^-?[0-9]"), _number_text(text))


def member_text(args: Column, key: str) -> Column:
    """The plain text of a key's value, as ``get_json_object`` gives it."""
    return F.get_json_object(args, "$." + key)


def comparable(value: Column, kind: T.DataType) -> Column:
    """The comparable form of a native column."""
    if isinstance(kind, T.StringType):
        inside = F.to_json(F.array(value))
        return F.when(value.isNotNull(), F.substring(inside, 2, F.length(inside) - 2))
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(kind, T.NumericType):
        return _number_text(value.cast("string"))
    return comparable(value.cast("string"), T.StringType())


def comparable_constant(value: object) -> str:
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else str(value)


def plain(text: Column) -> Column:
    """The comparable form without the quotes of strings."""
    return F.when(text.startswith('"'), F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(text)


def number(text: Column) -> Column:
    """The number of a comparable form; null for strings."""
    return text.try_cast("double")


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys at every level; text that is not JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def pointer(text: Column, path: str) -> Column:
    """The scalar that an RFC 6901 pointer leads to, as text; null for objects, arrays and missing leaves."""
    if path and not path.startswith("/"):
        raise ValueError("a pointer starts with /")
    out = "$"
    for part in path.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if part.isdigit() else "['" + part.replace("'", "\\'") + "']"
    found = F.try_variant_get(F.try_parse_json(text), out, "variant")
    shown = F.to_json(found)
    scalar = ~(shown.startswith("{") | shown.startswith("["))
    return F.when(scalar, F.coalesce(F.try_variant_get(F.try_parse_json(text), out, "string"), shown))
