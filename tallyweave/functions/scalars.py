"""Small functions of columns that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sigmoid(a: Column) -> Column:
    """The logistic function; neither side's exponential can overflow."""
    low = F.exp(F.least(a, F.lit(0.0)))
    return F.when(a >= 0, 1 / (1 + F.exp(-F.greatest(a, F.lit(0.0))))).otherwise(low / (1 + low))


def logit(p: Column, eps: float = 1e-6) -> Column:
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(clipped / (1 - clipped))


def calibrated(p: Column, slope: float, intercept: float) -> Column:
    return sigmoid(F.lit(slope) * logit(p) + F.lit(intercept))


def finite(x: Column) -> Column:
    """x, or null where it is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def json_safe(value: Column, kind: T.DataType) -> Column:
    """The value with every number that isn't finite null, however deep in arrays, maps and structs."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def to_utc(text: Column) -> Column:
    """A time of a text with or without offset as a timestamp; without one it is UTC. Null if it is none."""
    t = F.trim(text)
    zoned = t.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))))


def split_at(ts: Column, first: Column, second: Column) -> Column:
    """Which third a time is in; a boundary belongs to the later one, and all that follows to the last."""
    return F.when(ts < first, "train").when(ts < second, "val").otherwise("test")
