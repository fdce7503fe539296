"""Casts of schema evolution (O-90 to O-112), the same whatever the session's ANSI mode is.

Integers wrap, floating point numbers truncate towards zero into integers (beyond the target's range they stop at its
bounds), decimals out of range become null, text that doesn't parse is an error. Nested types don't evolve.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import wrapped

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
STAMPS = (T.TimestampType, T.TimestampNTZType)
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
#: Texts that are booleans, in any case.
TRUE, FALSE = ("t", "true", "y", "yes", "1"), ("f", "false", "n", "no", "0")


class UnsupportedCast(ValueError):
    pass


def _family(t: T.DataType) -> str:
    for name, kinds in (("bool", T.BooleanType), ("int", INTS), ("float", FLOATS), ("decimal", T.DecimalType), ("string", T.StringType), ("binary", T.BinaryType), ("date", T.DateType), ("stamp", STAMPS)):
        if isinstance(t, kinds):
            return name
    return "nested"


#: Which families cast to which.
PAIRS = {
    "bool": {"int", "float", "decimal", "string"}, "int": {"int", "float", "decimal", "string", "bool", "stamp"}, "float": {"int", "float", "decimal", "string"},
    "decimal": {"int", "float", "decimal", "string"}, "string": {"bool", "int", "float", "decimal", "binary", "date", "stamp"}, "binary": {"string"}, "date": {"string", "stamp"}, "stamp": {"date", "int", "string", "stamp"},
}


def supported(source: T.DataType, target: T.DataType) -> bool:
    if source == target:
        return True
    a, b = _family(source), _family(target)
    if {a, b} == {"int", "stamp"}:  # seconds, in 32 or 64 bits only
        return isinstance(source if a == "int" else target, (T.IntegerType, T.LongType))
    return b in PAIRS.get(a, ())


def _error(c: Column, bad: Column, what: str, good: Column) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(bad, F.raise_error(F.concat(F.lit("cannot cast '"), c.cast("string"), F.lit(f"' to {what}"))).cast("string")).otherwise(good)


def cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """The column as the target type."""
    if source == target:
        return c
    if not supported(source, target):
        raise UnsupportedCast(f"no cast from {source.simpleString()} to {target.simpleString()}")
    a, b, name = _family(source), _family(target), target.simpleString()
    if a == "bool":
        return c.cast("int").try_cast(target) if b in ("int", "float", "decimal") else c.cast(target)
    if b == "int":
        if a == "int":
            return wrapped(c, target)
        if a == "float":
            bits = BITS[type(target)]
            low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
            whole = F.when(F.isnan(c), 0).when(c >= float(high), high).when(c <= float(low), low)
            return whole.otherwise(F.when(F.abs(c) < 9.0e18, c).cast("bigint")).cast(target)
        if a == "decimal":
            whole = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
            return wrapped(whole, target)
        if a == "string":
            return _error(c, ~c.rlike(r"^[+-]?[0-9]+$") | c.try_cast(target).isNull(), name, c.try_cast(target)).cast(target)
        stamp = c.cast("timestamp") if isinstance(source, T.TimestampNTZType) else c
        return wrapped(F.unix_seconds(stamp), target)
    if b == "bool":
        if a == "int":
            return c != 0
        low = F.lower(c)
        return _error(c, ~low.isin(*TRUE, *FALSE), name, low.isin(*TRUE).cast("string")).cast("boolean")
    if b == "float":
        if a == "string":
            number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
            return _error(c, ~c.rlike(number) | c.try_cast(target).isNull(), name, c.try_cast(target).cast("string")).cast(target)
        return c.cast(target)
    if b == "decimal":
        if a == "float":
            return _error(c, F.isnan(c) | (F.abs(c) == float("inf")), name, c.try_cast(target).cast("string")).cast(target)
        if a == "string":
            number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
            return _error(c, ~c.rlike(number), name, c.try_cast(target).cast("string")).cast(target)
        return c.try_cast(target)
    if b == "date":
        if a == "string":
            days, iso = r"^[+-]?[0-9]+$", F.when(c.rlike(r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$"), c.try_cast("date"))
            value = F.when(c.rlike(days), F.date_from_unix_date(F.when(c.rlike(days), c).try_cast("int"))).otherwise(iso)
            return _error(c, value.isNull(), name, value.cast("string")).cast("date")
        return c.cast("date")
    if b == "stamp":
        if a == "int":
            stamp = F.timestamp_seconds(c)
            return stamp.cast(target)
        if a == "string":
            return _error(c, c.try_cast(target).isNull(), name, c.try_cast(target).cast("string")).cast(target)
        return c.cast(target)
    return c.cast(target)


def truncated(c: Column, precision: int) -> Column:
    """A timestamp cut to 0, 3, 6 or 9 digits of a second; Spark keeps microseconds, so 9 is 6."""
    return F.date_trunc({0: "second", 3: "millisecond"}.get(precision, "microsecond"), c)
