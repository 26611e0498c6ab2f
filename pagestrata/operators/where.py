"""Metadata predicates: a small filter language compiled to columns.

``{key: value}`` is equality, several keys are a conjunction, an empty filter is none. Operators are
``$eq $ne $gt $gte $lt $lte $in $nin`` on a key and ``$and $or`` on lists of filters. Metadata are
strings; numbers are compared as their text for equality and as numbers for order. A missing key
matches nothing but ``$ne`` and ``$nin``. Keys with a column of their own are compared there, so that
the predicate reaches the scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.errors import ValidationError
from pagestrata.schemas import STORED

TYPED = {f.name: f.dataType.simpleString() for f in STORED.fields if f.name not in ("id", "text", "embedding", "metadata")}


def _value(key: str) -> Column:
    return F.col(key) if TYPED.get(key) == "string" else F.col("metadata")[key]


def _text(x) -> str:
    return "" if x is None else str(x)


def _compare(key: str, op: str, x) -> Column:
    if TYPED.get(key) == "int" and op in ("$eq", "$gt", "$gte", "$lt", "$lte") and str(x).lstrip("-").isdigit():
        v, x = F.col(key), int(x)
    elif op in ("$gt", "$gte", "$lt", "$lte"):
        v = _value(key)
        v, x = (v.try_cast("double"), float(x)) if isinstance(x, (int, float)) else (v, _text(x))
    else:
        v = _value(key)
        x = [_text(i) for i in x] if isinstance(x, (list, tuple, set)) else _text(x)
    match op:
        case "$eq":
            return v == x
        case "$ne":
            return ~v.eqNullSafe(F.lit(x))
        case "$gt":
            return v > x
        case "$gte":
            return v >= x
        case "$lt":
            return v < x
        case "$lte":
            return v <= x
        case "$in":
            return v.isin(x)
        case "$nin":
            return ~F.coalesce(v.isin(x), F.lit(False))
    raise ValidationError("unknown operator", operator=op)


def compile_where(where: Mapping | None) -> Column | None:
    """The column of a filter, or null for none."""
    if not where:
        return None
    parts = []
    for key, x in where.items():
        if key in ("$and", "$or"):
            inner = [c for c in map(compile_where, x) if c is not None]
            if inner:
                out = inner[0]
                for c in inner[1:]:
                    out = out & c if key == "$and" else out | c
                parts.append(out)
        elif key.startswith("$"):
            raise ValidationError("unknown operator", operator=key)
        elif isinstance(x, Mapping):
            parts += [_compare(key, op, y) for op, y in x.items()]
        else:
            parts.append(_compare(key, "$eq", x))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out
