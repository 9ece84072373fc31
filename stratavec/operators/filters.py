"""The metadata filter language as a Spark predicate.

A filter is an object of fields with operators, and of ``$and`` / ``$or`` with lists of filters; everything side by
side must hold.  Predicates are three-valued: a missing field makes a comparison null, so ``$ne`` and ``$nin`` leave
rows without the field out.  ``$eq``, ``$ne``, ``$in`` and ``$nin`` compare texts (5 isn't 5.0); the order operators
compare as timestamps where the operand is a string, else as numbers, and a stored value that isn't one makes them null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.errors import EngineError
from stratavec.functions.geo import great_circle
from stratavec.functions.jsonpath import contains_elements, dotted, field_text, field_variant, json_text


def _malformed(message: str) -> EngineError:
    return EngineError("FILTER_MALFORMED", message)


def _all(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts)


_ORDER: dict[str, Callable[[Column, Column], Column]] = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}


def _ordered(op: str, text: Column, operand) -> Column:
    compare = _ORDER[op]
    if isinstance(operand, str):
        return compare(text.try_cast("timestamp"), F.lit(operand).try_cast("timestamp"))
    if isinstance(operand, bool) or not isinstance(operand, (int, float)):
        raise _malformed(f"{op} needs a number or a date-time string")
    number = F.lit(json_text(operand))
    exact, bound = text.try_cast("decimal(38,18)"), number.try_cast("decimal(38,18)")
    wide = compare(text.try_cast("double"), number.try_cast("double"))
    return F.when(exact.isNotNull() & bound.isNotNull(), compare(exact, bound)).otherwise(wide)


def _list(op: str, operand) -> list:
    if not isinstance(operand, list):
        raise _malformed(f"{op} needs an array")
    if not operand:
        raise _malformed(f"{op} needs an array that isn't empty")
    return operand


def _scalars(op: str, values: list) -> list:
    if any(v is None or isinstance(v, (list, dict)) for v in values):
        raise _malformed(f"{op} takes strings, numbers and booleans")
    return values


def _numbers(op: str, operand, names: tuple[str, ...]) -> list[float]:
    if not isinstance(operand, dict):
        raise _malformed(f"{op} needs {{{', '.join(names)}}}")
    out = []
    for name in names:
        value = operand.get(name)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise _malformed(f"{op}.{name} must be a number")
        out.append(float(value))
    return out


def _geo_point(metadata: Column, field: str) -> tuple[Column, Column]:
    return tuple(field_text(metadata, [*dotted(field), k]).try_cast("double") for k in ("lat", "lon"))


def _field(metadata: Column, field: str, op: str, operand) -> Column:
    text = field_text(metadata, dotted(field))
    if op == "$eq":
        return text == F.lit(json_text(operand))
    if op == "$ne":
        return text != F.lit(json_text(operand))
    if op in _ORDER:
        return _ordered(op, text, operand)
    if op == "$in":
        return text.isin([json_text(v) for v in _list(op, operand)])
    if op == "$nin":
        return ~text.isin([json_text(v) for v in _list(op, operand)])
    if op == "$exists":
        if not isinstance(operand, bool):
            raise _malformed("$exists needs a boolean")
        return text.isNotNull() if operand else text.isNull()
    if op == "$geoRadius":
        lat, lon, radius = _numbers(op, operand, ("lat", "lon", "radiusMeters"))
        return great_circle(*_geo_point(metadata, field), lat, lon) <= F.lit(radius)
    if op == "$geoBBox":
        low_lat, high_lat, low_lon, high_lon = _numbers(op, operand, ("minLat", "maxLat", "minLon", "maxLon"))
        lat, lon = _geo_point(metadata, field)
        return lat.between(low_lat, high_lat) & lon.between(low_lon, high_lon)
    array = field_variant(metadata, dotted(field))
    if op == "$elemMatch":
        if not isinstance(operand, dict):
            raise _malformed("$elemMatch needs an object")
        return contains_elements(array, [operand])
    if op == "$contains":
        return contains_elements(array, _scalars(op, [operand]))
    if op == "$containsAny":
        return _any([contains_elements(array, [v]) for v in _scalars(op, _list(op, operand))])
    if op == "$containsAll":
        return contains_elements(array, _scalars(op, _list(op, operand)))
    raise EngineError("FILTER_UNSUPPORTED_OPERATOR", f"unsupported filter operator {op}", operator=op)


def predicate(filter_: dict, metadata: Column | str = "metadata") -> Column:
    """The predicate of a filter; null counts as not met.  An empty filter, list or operator object is malformed."""
    metadata = F.col(metadata) if isinstance(metadata, str) else metadata
    if not isinstance(filter_, dict):
        raise _malformed("a filter must be an object")
    parts: list[Column] = []
    for name, value in filter_.items():
        if name in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise _malformed(f"{name} needs an array that isn't empty")
            inner = [predicate(f, metadata) for f in value]
            parts.append(_all(inner) if name == "$and" else _any(inner))
        else:
            if not isinstance(value, dict) or not value:
                raise _malformed(f"field {name!r} needs an object of operators")
            parts.extend(_field(metadata, name, op, operand) for op, operand in value.items())
    if not parts:
        raise _malformed("a filter must not be empty")
    return _all(parts)


def apply_filter(records: DataFrame, filter_: dict | None) -> DataFrame:
    return records if filter_ is None else records.where(predicate(filter_))
