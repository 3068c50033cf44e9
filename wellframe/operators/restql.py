"""A small REST filter language over DataFrames: ``col=op.value``, ``order``, ``limit``, ``offset``, ``select``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(df: DataFrame, name: str, text: str) -> Column:
    """eq, neq, gt, gte, lt, lte, in.(a,b), is.null/true/false, like, ilike, cs.{a,b}, and not. before any.

    Null follows SQL: a comparison with null drops the row, negated or not.
    """
    op, _, value = text.partition(".")
    col, kind = F.col(name), df.schema[name].dataType
    if op == "not":
        return ~predicate(df, name, value)
    if op == "is":
        return {"null": col.isNull(), "true": col.eqNullSafe(True), "false": col.eqNullSafe(False)}[value]
    if op == "in":
        return col.isin([F.lit(v.strip()).cast(kind) for v in value.strip("()").split(",")])
    if op in ("like", "ilike"):
        pattern = value.replace("*", "%")
        return col.like(pattern) if op == "like" else col.ilike(pattern)
    if op == "cs":
        want = F.array(*[F.lit(v.strip()).cast(kind.elementType) for v in value.strip("{}").split(",")])
        return F.size(F.array_except(want, col)) == 0
    v = F.lit(value).cast(kind)
    return {"eq": col == v, "neq": col != v, "gt": col > v, "gte": col >= v, "lt": col < v, "lte": col <= v}[op]


def query(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """Apply a request's parameters; nulls come last in either order."""
    out = df
    for k, v in params.items():
        if k not in ("order", "limit", "offset", "select"):
            out = out.where(predicate(df, k, v))
    if "order" in params:
        keys = [x.split(".") for x in params["order"].split(",")]
        out = out.orderBy(*[F.col(k[0]).desc_nulls_last() if "desc" in k[1:] else F.col(k[0]).asc_nulls_last() for k in keys])
    if "offset" in params:
        out = out.offset(int(params["offset"]))
    if "limit" in params:
        out = out.limit(int(params["limit"]))
    return out.select(*params["select"].split(",")) if "select" in params else out
