"""Merge engines: versioned records of a key become one row (O-40 to O-58).

Input is any DataFrame with the key columns, value columns, `_SEQUENCE_NUMBER` (bigint) and `_VALUE_KIND` (tinyint: 0 +I,
1 -U, 2 +U, 3 -D), and `_LEVEL` for the lookup rule. Records of a key are ordered by the user's sequence fields (nulls
first in either direction), then by `_SEQUENCE_NUMBER`. Every engine is one hash aggregation with map-side combination, so
a hot key shrinks before the shuffle; only sequence groups that retract, or that fold order-dependent aggregates, sort a
key's records into an array and fold that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SEQUENCE, KIND, LEVEL = "_SEQUENCE_NUMBER", "_VALUE_KIND", "_LEVEL"
INSERT, UPDATE_BEFORE, UPDATE_AFTER, DELETE = 0, 1, 2, 3
ENGINES = ("deduplicate", "first-row", "aggregation", "partial-update")
AGGREGATES = ("sum", "min", "max", "bool_and", "bool_or", "last_value", "last_non_null_value", "first_value", "first_non_null_value", "primary-key")
#: Aggregates whose result doesn't depend on the order of records.
FREE = ("sum", "min", "max", "bool_and", "bool_or")


@dataclass
class MergeSpec:
    keys: list[str]
    engine: str = "deduplicate"
    sequence_fields: list[str] = field(default_factory=list)
    descending: bool = False
    ignore_delete: bool = False
    remove_on_delete: bool = False
    #: sequence fields of a group -> the columns it governs
    groups: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    remove_on_group: list[str] = field(default_factory=list)
    aggregates: dict[str, str] = field(default_factory=dict)
    default_aggregate: str | None = None
    ignore_retract: set[str] = field(default_factory=set)
    lookup: bool = False
    #: the caller knows that no record retracts (file counts say so), which spares sequence groups the ordered fold
    insert_only: bool = False

    def __post_init__(self) -> None:
        if self.engine not in ENGINES:
            raise ValueError(f"unknown merge engine {self.engine!r}")
        if self.remove_on_delete and self.ignore_delete:
            raise ValueError("ignore-delete and partial-update.remove-record-on-delete conflict")
        if self.remove_on_delete and self.groups:
            raise ValueError("sequence groups and partial-update.remove-record-on-delete conflict")
        own = {f for g in self.groups for f in g}
        if stray := [f for f in self.remove_on_group if f not in own]:
            raise ValueError(f"fields {stray} of partial-update.remove-record-on-sequence-group are in no sequence group")
        for c, f in self.aggregates.items():
            if f not in AGGREGATES:
                raise ValueError(f"unknown aggregate function {f!r} for field {c!r}")

    def aggregate_of(self, column: str) -> str:
        """Sequence fields keep their last value; then the column's own function, the default one, the last non-null value."""
        if column in self.sequence_fields:
            return "last_value"
        if column in self.keys:
            return "primary-key"
        return self.aggregates.get(column) or self.default_aggregate or "last_non_null_value"


def retracts(kind: Column) -> Column:
    return kind.isin(UPDATE_BEFORE, DELETE)


def wrapped(x: Column, kind: T.DataType) -> Column:
    """An integer of any size wrapped into a narrower type, as two's complement does."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}.get(kind.simpleString())
    if bits is None:
        return x.cast(kind)
    half, whole = (F.lit(str(2**n)).cast("decimal(38,0)") for n in (bits - 1, bits))
    return (F.pmod(x.cast("decimal(38,0)") + half, whole) - half).cast(kind)


def _descending(name: str, kind: T.DataType) -> Column | None:
    """A value that sorts ascending as the column sorts descending, nulls aside; None if the type has none."""
    c = F.col(name)
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.bitwise_not(c)
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(kind, T.DecimalType):
        return -c
    return None


def with_order(df: DataFrame, spec: MergeSpec) -> DataFrame:
    """Adds _order: a struct that is never null and sorts a key's records."""
    parts: list[Column] = []
    types = {f.name: f.dataType for f in df.schema}
    for i, f in enumerate(spec.sequence_fields):
        if not spec.descending:
            parts.append(F.col(f).alias(f"_o{i}"))
            continue
        flipped = _descending(f, types[f])
        if flipped is None:  # rank by the field within the key; any type has an order
            rank = F.dense_rank().over(Window.partitionBy(*spec.keys).orderBy(F.desc_nulls_first(f)))
            df = df.withColumn(f"_rank{i}", rank)
            flipped, present = F.col(f"_rank{i}"), F.lit(True)
        else:
            present = F.col(f).isNotNull()
        parts += [present.alias(f"_p{i}"), flipped.alias(f"_o{i}")]
    return df.withColumn("_order", F.struct(*parts, F.col(SEQUENCE).alias("_seq")))


def newest_upper_level(df: DataFrame, spec: MergeSpec) -> DataFrame:
    """The lookup rule (O-46b): all of level 0, and of higher levels only the newest record of a key."""
    upper = F.max(F.when(F.col(LEVEL) > 0, F.col("_order"))).over(Window.partitionBy(*spec.keys))
    return df.withColumn("_upper", upper).filter((F.col(LEVEL) <= 0) | (F.col("_order") == F.col("_upper"))).drop("_upper")


def _failing(wrong: Column, message: str, then: Column) -> Column:
    return F.when(wrong, F.raise_error(F.lit(message)).cast(T.NullType())).otherwise(then)


def _folded(column: str, kind: T.DataType, function: str, retract: Column, message_of: Callable[[str], str], ignored: bool) -> tuple[Column, Column | None]:
    """The aggregate of a column over a key's records, and a condition under which the key's retracts are an error."""
    c, order = F.col(column), F.col("_order")
    keep = ~retract
    if function == "sum":
        signed = F.when(retract, F.lit(None) if ignored else -_wide(c, kind)).otherwise(_wide(c, kind))
        total = F.sum(signed)
        return (wrapped(total, kind) if isinstance(kind, T.IntegralType) else total.cast(kind)), None
    if function == "last_value":
        return (F.max_by(F.when(keep, c), F.when(keep, order)) if ignored else F.max_by(F.when(keep, c), order)), None
    if function == "last_non_null_value":
        seen = c.isNotNull() & (keep if ignored else F.lit(True))
        return F.max_by(F.when(keep, c), F.when(seen, order)), None
    if function == "primary-key":
        return F.max_by(c, order), None
    native = {"min": lambda: F.min(F.when(keep, c)), "max": lambda: F.max(F.when(keep, c)), "bool_and": lambda: F.bool_and(F.when(keep, c)), "bool_or": lambda: F.bool_or(F.when(keep, c)),
              "first_value": lambda: F.min_by(c, F.when(keep, order)), "first_non_null_value": lambda: F.min_by(c, F.when(keep & c.isNotNull(), order))}
    return native[function](), None if ignored else F.bool_or(retract)


def _wide(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return c.cast("decimal(20,0)")
    return c


def merge(df: DataFrame, spec: MergeSpec, keep_deletes: bool = False) -> DataFrame:
    """Keys, values and, with keep_deletes, `_VALUE_KIND`; without it, keys whose last word is a retraction are dropped.

    A key with one record keeps that record as it is (O-46): a lone retraction is never an error and stays one.
    """
    values = [c for c in df.columns if c not in (*spec.keys, SEQUENCE, KIND, LEVEL)]
    types = {f.name: f.dataType for f in df.schema}
    df = with_order(df, spec)
    if spec.lookup and LEVEL in df.columns:
        df = newest_upper_level(df, spec)
    out = {"deduplicate": _deduplicate, "first-row": _first_row, "aggregation": _aggregation, "partial-update": _partial_update}[spec.engine](df, spec, values, types)
    out = out.select(*spec.keys, *values, F.col(KIND).cast("tinyint").alias(KIND))
    return out if keep_deletes else out.filter(~retracts(F.col(KIND))).drop(KIND)


def _whole(values: list[str]) -> Column:
    return F.struct(*(F.col(v) for v in values), F.col(KIND))


def _deduplicate(df: DataFrame, spec: MergeSpec, values: list[str], types: dict) -> DataFrame:
    order = F.col("_order")
    if spec.ignore_delete:  # retracts lose to anything else; a key with nothing else is hidden by its own kind
        order = F.struct((~retracts(F.col(KIND))).alias("_kept"), order.alias("_by"))
    return df.groupBy(*spec.keys).agg(F.max_by(_whole(values), order).alias("_v")).select(*spec.keys, "_v.*")


def _first_row(df: DataFrame, spec: MergeSpec, values: list[str], types: dict) -> DataFrame:
    order, retract = F.col("_order"), retracts(F.col(KIND))
    if spec.ignore_delete:
        order = F.struct(retract.alias("_late"), order.alias("_by"))
    out = df.groupBy(*spec.keys).agg(F.min_by(_whole(values), order).alias("_v"), F.count("*").alias("_n"), F.bool_or(retract).alias("_r"))
    wrong = (F.col("_n") > 1) & F.col("_r") & F.lit(not spec.ignore_delete)
    kind = _failing(wrong, "first-row takes no retractions; set ignore-delete to skip them", F.col(f"_v.{KIND}").cast("int"))
    return out.select(*spec.keys, *(F.col(f"_v.`{v}`").alias(v) for v in values), kind.alias(KIND))


def _aggregation(df: DataFrame, spec: MergeSpec, values: list[str], types: dict) -> DataFrame:
    retract = retracts(F.col(KIND))
    folds, wrongs = {}, {}
    for v in values:
        folds[v], wrong = _folded(v, types[v], spec.aggregate_of(v), retract, str, v in spec.ignore_retract)
        if wrong is not None:
            wrongs[v] = wrong
    out = df.groupBy(*spec.keys).agg(F.count("*").alias("_n"), F.max(KIND).alias("_kind"), F.max_by(F.struct(*(F.col(v) for v in values)), F.col("_order")).alias("_one") if values else F.lit(None).alias("_one"),
                                     *(c.alias(f"_f_{v}") for v, c in folds.items()), *(c.alias(f"_w_{v}") for v, c in wrongs.items()))
    lone = F.col("_n") == 1
    kind = F.when(lone, F.col("_kind").cast("int")).otherwise(F.lit(INSERT))
    for v in wrongs:
        kind = _failing(~lone & F.col(f"_w_{v}"), f"{spec.aggregate_of(v)} of field {v} takes no retractions; set fields.{v}.ignore-retract to skip them", kind)
    return out.select(*spec.keys, *(F.when(lone, F.col(f"_one.`{v}`")).otherwise(F.col(f"_f_{v}")).alias(v) for v in values), kind.alias(KIND))


def _partial_update(df: DataFrame, spec: MergeSpec, values: list[str], types: dict) -> DataFrame:
    retract = retracts(F.col(KIND))
    if spec.groups:
        governed = {c: g for g, cols in spec.groups.items() for c in (*g, *cols)}
        functions = {c: spec.aggregates.get(c) or (spec.default_aggregate if c in governed and not any(c in g for g in spec.groups) else None) for c in values}
        plain = all(f is None or f in FREE for f in functions.values())
        if plain and (spec.ignore_delete or spec.insert_only):
            return _grouped(df, spec, values, types, governed, functions)
        return _fold(df, spec, values, types, governed, functions)
    by_key = Window.partitionBy(*spec.keys)
    if spec.remove_on_delete:  # what stands before the last deletion is gone
        last = F.max(F.when(F.col(KIND) == DELETE, F.col("_order"))).over(by_key)
        df = df.withColumn("_last", last).withColumn("_gone", F.coalesce(F.col("_order") <= F.col("_last"), F.lit(False)))
    else:
        df = df.withColumn("_gone", F.lit(False))
    live = ~retract & ~F.col("_gone")
    wrong = retract if not (spec.ignore_delete or spec.remove_on_delete) else F.lit(False)
    # with ignore-delete, a key of nothing but retractions is hidden, whatever their number
    out = df.groupBy(*spec.keys).agg(F.count("*").alias("_n"), F.bool_or(wrong).alias("_w"), F.max_by(_whole(values), F.col("_order")).alias("_one"), F.bool_or(~retract).alias("_any"),
                                     *(F.max_by(F.col(v), F.when(live & F.col(v).isNotNull(), F.col("_order"))).alias(f"_f_{v}") for v in values))
    lone, last_kind = F.col("_n") == 1, F.col(f"_one.{KIND}").cast("int")
    kind = F.when(lone, last_kind)
    if spec.remove_on_delete:
        kind = kind.when(last_kind == DELETE, F.lit(DELETE))
    kind = kind.when(~F.col("_any"), F.lit(DELETE)).otherwise(F.lit(INSERT))
    kind = _failing(~lone & F.col("_w"), "partial-update takes no retractions; set ignore-delete, partial-update.remove-record-on-delete or a sequence group", kind)
    return out.select(*spec.keys, *(F.when(lone, F.col(f"_one.`{v}`")).otherwise(F.col(f"_f_{v}")).alias(v) for v in values), kind.alias(KIND))


def _grouped(df: DataFrame, spec: MergeSpec, values: list[str], types: dict, governed: dict, functions: dict) -> DataFrame:
    """Sequence groups without retractions, with order-free aggregates only: one aggregation."""
    retract = retracts(F.col(KIND))
    aggs = [F.count("*").alias("_n"), F.max_by(_whole(values), F.col("_order")).alias("_one"), F.bool_or(~retract).alias("_any")]
    for i, g in enumerate(spec.groups):
        some = reduce(lambda a, b: a | b, (F.col(f).isNotNull() for f in g)) & ~retract
        at = F.struct(*(F.col(f).alias(f"_g{j}") for j, f in enumerate(g)), F.col("_order").alias("_by"))
        plain = [c for c in values if governed.get(c) == g and not functions[c]]
        aggs.append(F.max_by(F.struct(*(F.col(c) for c in plain)), F.when(some, at)).alias(f"_g{i}"))
        aggs += [_folded(c, types[c], functions[c], ~some, str, True)[0].alias(f"_f_{c}") for c in values if governed.get(c) == g and functions[c]]
    for c in values:
        if c not in governed:
            aggs.append((_folded(c, types[c], functions[c], retract, str, True)[0] if functions[c] else F.max_by(F.col(c), F.when(~retract & F.col(c).isNotNull(), F.col("_order")))).alias(f"_f_{c}"))
    out = df.groupBy(*spec.keys).agg(*aggs)
    index = {g: i for i, g in enumerate(spec.groups)}
    lone = F.col("_n") == 1
    get = lambda c: F.col(f"_g{index[governed[c]]}.`{c}`") if c in governed and not functions[c] else F.col(f"_f_{c}")
    kind = F.when(lone, F.col(f"_one.{KIND}").cast("int")).when(~F.col("_any"), F.lit(DELETE)).otherwise(F.lit(INSERT))
    return out.select(*spec.keys, *(F.when(lone, F.col(f"_one.`{c}`")).otherwise(get(c)).alias(c) for c in values), kind.alias(KIND))


def _fold(df: DataFrame, spec: MergeSpec, values: list[str], types: dict, governed: dict, functions: dict) -> DataFrame:
    """Sequence groups with retractions or order-dependent aggregates: a key's records in order, folded one by one.

    All records of a key meet in one array here, as the fold needs their order; every other path avoids it."""
    started = [c for c in values if functions[c] in ("first_value", "first_non_null_value")]
    state = T.StructType([T.StructField(c, types[c]) for c in values] + [T.StructField(f"_started_{c}", T.BooleanType()) for c in started] + [T.StructField("_deleted", T.BooleanType()), T.StructField("_wrong", T.StringType())])
    zero = F.struct(*(F.lit(None).cast(types[c]).alias(c) for c in values), *(F.lit(False).alias(f"_started_{c}") for c in started), F.lit(False).alias("_deleted"), F.lit(None).cast("string").alias("_wrong"))

    def agg(c: str, acc: Column, x: Column, begun: Column | None) -> Column:
        f, kind = functions[c], types[c]
        if f == "sum":
            total = _wide(acc, kind) + _wide(x, kind)
            return F.when(acc.isNull() | x.isNull(), F.coalesce(acc, x)).otherwise(wrapped(total, kind) if isinstance(kind, T.IntegralType) else total.cast(kind))
        if f in ("min", "max"):
            return (F.least if f == "min" else F.greatest)(acc, x)
        if f in ("bool_and", "bool_or"):
            return F.when(acc.isNull() | x.isNull(), F.coalesce(acc, x)).otherwise(acc & x if f == "bool_and" else acc | x)
        if f in ("last_value", "primary-key"):
            return x
        if f == "last_non_null_value":
            return F.coalesce(x, acc)
        return F.when(begun, acc).otherwise(x)

    def reverse(c: str, acc: Column, x: Column, begun: Column | None) -> Column:
        """agg with its operands turned: an older record arrives late."""
        f = functions[c]
        if f in ("first_value", "first_non_null_value"):
            return F.when(begun, x).otherwise(acc)
        return agg(c, x, acc, begun)

    def retracted(c: str, acc: Column, x: Column) -> Column:
        f, kind = functions[c], types[c]
        if c in spec.ignore_retract:
            return acc
        if f == "sum":
            less = -_wide(x, kind)
            total = F.coalesce(_wide(acc, kind) + less, less)
            return F.when(x.isNull(), acc).otherwise(wrapped(total, kind) if isinstance(kind, T.IntegralType) else total.cast(kind))
        if f == "last_non_null_value":
            return F.when(x.isNotNull(), F.lit(None).cast(kind)).otherwise(acc)
        if f == "primary-key":
            return x
        return F.lit(None).cast(kind)  # last_value; the others are an error, told below

    def order_of(g: tuple[str, ...], x: Column) -> Column:
        return F.struct(*(x[f].alias(f"_g{i}") for i, f in enumerate(g)))

    unable = [c for c in values if functions[c] and functions[c] not in ("sum", "last_value", "last_non_null_value", "primary-key") and c not in spec.ignore_retract and c in governed]

    def step(acc: Column, x: Column) -> Column:
        retract, new, begun = retracts(x[KIND]), {}, {}
        skipped = retract & F.lit(spec.ignore_delete)
        empty = {g: reduce(lambda a, b: a & b, (x[f].isNull() for f in g)) for g in spec.groups}
        ahead = {g: order_of(g, x) >= order_of(g, acc) for g in spec.groups}
        for c in values:
            flag = acc[f"_started_{c}"] if c in started else None
            if c not in governed:
                added = agg(c, acc[c], x[c], flag) if functions[c] else F.coalesce(x[c], acc[c])
                new[c] = F.when(retract, acc[c]).otherwise(added)
                touched = ~retract
            else:
                g = governed[c]
                if c in g:
                    new[c] = F.when(~empty[g] & ahead[g], x[c]).otherwise(acc[c])
                elif functions[c]:
                    added = F.when(ahead[g], agg(c, acc[c], x[c], flag)).otherwise(reverse(c, acc[c], x[c], flag))
                    new[c] = F.when(empty[g], acc[c]).when(retract, retracted(c, acc[c], x[c])).otherwise(added)
                else:
                    new[c] = F.when(empty[g] | ~ahead[g], acc[c]).when(retract, F.lit(None).cast(types[c])).otherwise(x[c])
                touched = ~retract & ~empty[g]
            if c in started:
                begun[c] = flag | (touched & (x[c].isNotNull() if functions[c] == "first_non_null_value" else F.lit(True)))
        wiped = F.lit(False)
        for g in spec.groups:
            if any(f in spec.remove_on_group for f in g):
                wiped = wiped | ((x[KIND] == DELETE) & ~empty[g] & ahead[g])
        wiped = wiped & ~skipped
        wrong = acc["_wrong"]
        for c in unable:
            wrong = F.coalesce(wrong, F.when(retract & ~skipped & ~empty[governed[c]], F.lit(f"{functions[c]} of field {c} takes no retractions; set fields.{c}.ignore-retract to skip them")))
        return F.struct(*(F.when(wiped, F.lit(None).cast(types[c])).when(skipped, acc[c]).otherwise(new[c]).alias(c) for c in values),
                        *(F.when(skipped, acc[f"_started_{c}"]).otherwise(begun[c]).alias(f"_started_{c}") for c in started), wiped.alias("_deleted"), wrong.alias("_wrong"))

    record = F.struct(F.col("_order"), *(F.col(v) for v in values), F.col(KIND))
    rows = df.groupBy(*spec.keys).agg(F.array_sort(F.collect_list(record)).alias("_all"))
    out = rows.select(*spec.keys, F.aggregate("_all", zero.cast(state), step).alias("_v"), F.element_at("_all", -1).alias("_one"), F.size("_all").alias("_n"), F.exists("_all", lambda r: ~retracts(r[KIND])).alias("_any"))
    lone = F.col("_n") == 1
    kind = F.when(lone, F.col(f"_one.{KIND}").cast("int")).when(F.col("_v._deleted") | (F.lit(spec.ignore_delete) & ~F.col("_any")), F.lit(DELETE)).otherwise(F.lit(INSERT))
    kind = F.when(~lone & F.col("_v._wrong").isNotNull(), F.raise_error(F.col("_v._wrong")).cast("int")).otherwise(kind)
    return out.select(*spec.keys, *(F.when(lone, F.col(f"_one.`{c}`")).otherwise(F.col(f"_v.`{c}`")).alias(c) for c in values), kind.alias(KIND))
