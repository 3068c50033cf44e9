"""Shapes of JSON rows (variants): required and optional fields, types and choices, with a reason for each fault.

A shape maps a field to a type (string, number, int, boolean, object, array, uuid, iso), with a ? behind it if it may be missing
or null, or to a list of choices, with None among them if it may.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = dict[str, str | list]

# The forms of ids and of times.
UUID = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def _fits(kind: str, value: Column, type_: Column) -> Column:
    """Whether a variant, whose Spark type is named by ``type_``, is of a kind."""
    text = value.try_cast("string")
    whole = type_ == "BIGINT"
    number = whole | (type_ == "DOUBLE") | F.startswith(type_, F.lit("DECIMAL")) | (type_ == "FLOAT")
    double = value.try_cast("double")
    return {
        "string": type_ == "STRING",
        "number": number,
        "int": whole | number & (double == F.floor(double)),
        "boolean": type_ == "BOOLEAN",
        "object": F.startswith(type_, F.lit("OBJECT")),
        "array": F.startswith(type_, F.lit("ARRAY")),
        "uuid": (type_ == "STRING") & text.rlike(UUID),
        "iso": (type_ == "STRING") & text.rlike(ISO),
    }[kind]


def problems(row: Column, shape: Shape) -> Column:
    """array<string>: what is wrong with a variant, field by field; one entry if it is no object."""
    found = []
    for field, rule in shape.items():
        value = F.try_variant_get(row, f"$.{field}", "variant")
        type_ = F.schema_of_variant(value)
        missing = value.isNull() | (type_ == "VOID")
        text = F.coalesce(value.try_cast("string"), F.to_json(value))
        if isinstance(rule, list):
            choices = [c for c in rule if c is not None]
            wrong = F.when(missing, F.lit(None) if None in rule else F.lit(f"{field}: missing (expected one of {'|'.join(choices)})"))
            found.append(wrong.when(~missing & ~F.coalesce(text.isin(choices), F.lit(False)), F.concat(F.lit(f"{field}: "), text, F.lit(f" is not one of {'|'.join(choices)}"))))
            continue
        kind = rule.rstrip("?")
        wrong = F.when(missing, F.lit(None) if rule.endswith("?") else F.lit(f"{field}: missing ({kind})"))
        found.append(wrong.when(~missing & ~F.coalesce(_fits(kind, value, type_), F.lit(False)), F.concat(F.lit(f"{field}: expected {kind}, got "), text)))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(row), F.lit("OBJECT")), F.lit(False))
    return F.when(is_object, F.array_compact(F.array(*found))).otherwise(F.array(F.lit("payload is not an object")))
