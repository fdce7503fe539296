"""Types, options and versioned schemas with stable field ids (O-03 to O-06, O-171)."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..functions.casts import supported
from ..operators.merge import AGGREGATES, ENGINES, MergeSpec

SPECIAL = ("_SEQUENCE_NUMBER", "_VALUE_KIND", "_ROW_ID", "_INDEX_SCORE", "_LEVEL")
KEY_PREFIX = "_KEY_"
UNAWARE, POSTPONE = -1, -2

_ATOMIC = {"BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(),
           "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BYTES": T.BinaryType(), "BINARY": T.BinaryType(), "BLOB": T.BinaryType(), "DATE": T.DateType()}


def parse_type(spec: str | dict) -> tuple[T.DataType, bool]:
    """A type string, or a nested type's object, as a Spark type and whether it is nullable."""
    if isinstance(spec, dict):
        kind, _, rest = spec["type"].partition(" ")
        nullable = rest.strip().upper() != "NOT NULL"
        if kind == "ARRAY":
            of, null = parse_type(spec["element"])
            return T.ArrayType(of, null), nullable
        if kind == "MAP":
            of, null = parse_type(spec["value"])
            return T.MapType(parse_type(spec["key"])[0], of, null), nullable
        if kind == "ROW":
            parts = [(f["name"], *parse_type(f["type"]), {"id": f["id"]}) for f in spec["fields"]]
            return T.StructType([T.StructField(n, t, null, meta) for n, t, null, meta in parts]), nullable
        raise ValueError(f"unknown type {spec['type']!r}")
    text = re.sub(r"\s+", " ", spec.strip().upper())
    nullable = not text.endswith(" NOT NULL")
    text = text.removesuffix(" NOT NULL").strip()
    if text in _ATOMIC:
        return _ATOMIC[text], nullable
    if m := re.fullmatch(r"DECIMAL ?\( ?(\d+) ?, ?(\d+) ?\)", text):
        return T.DecimalType(int(m[1]), int(m[2])), nullable
    if m := re.fullmatch(r"TIMESTAMP ?(?:\( ?([0369]) ?\))?( WITH LOCAL TIME ZONE)?", text):
        return T.TimestampType() if m[2] else T.TimestampNTZType(), nullable
    raise ValueError(f"unknown type {spec!r}")


def print_type(kind: T.DataType, nullable: bool = True, precision: int = 6) -> str | dict:
    """The inverse of parse_type. Timestamps have microseconds unless another precision was declared."""
    tail = "" if nullable else " NOT NULL"
    if isinstance(kind, T.ArrayType):
        return {"type": "ARRAY" + tail, "element": print_type(kind.elementType, kind.containsNull)}
    if isinstance(kind, T.MapType):
        return {"type": "MAP" + tail, "key": print_type(kind.keyType, False), "value": print_type(kind.valueType, kind.valueContainsNull)}
    if isinstance(kind, T.StructType):
        return {"type": "ROW" + tail, "fields": [{"id": f.metadata.get("id", i), "name": f.name, "type": print_type(f.dataType, f.nullable)} for i, f in enumerate(kind)]}
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision}, {kind.scale}){tail}"
    if isinstance(kind, T.TimestampNTZType):
        return f"TIMESTAMP({precision}){tail}"
    if isinstance(kind, T.TimestampType):
        return f"TIMESTAMP({precision}) WITH LOCAL TIME ZONE{tail}"
    names = {type(v): k for k, v in _ATOMIC.items() if k not in ("INTEGER", "BINARY", "BLOB")}
    if type(kind) not in names:
        raise ValueError(f"type {kind.simpleString()} has no place in a table")
    return names[type(kind)] + tail


_BYTES = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "milli": 1e-3, "s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "": 1e-3}


def memory_size(text: str) -> int:
    """`128mb`, `1 GB`, `512` as bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower())
    unit = re.sub(r"(?<=[kmgt])(b|ibytes|bytes)$|^bytes?$", "", m[2]) if m else ""
    if not m or unit not in _BYTES:
        raise ValueError(f"{text!r} is no memory size")
    return int(m[1]) * _BYTES[unit]


def duration(text: str) -> float:
    """`1 hour`, `30 s`, `100` (milliseconds) as seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zµ]*)\s*", text.lower())
    unit = m[2] if m and m[2] in _SECONDS else m[2].removesuffix("s") if m else ""
    if not m or unit not in _SECONDS:
        raise ValueError(f"{text!r} is no duration")
    return int(m[1]) * _SECONDS[unit]


def _flag(v: str) -> bool:
    if v.lower() not in ("true", "false"):
        raise ValueError(f"{v!r} is neither true nor false")
    return v.lower() == "true"


def _names(v: str) -> list[str]:
    return [x.strip() for x in v.split(",") if x.strip()]


SCAN_MODES = ("default", "latest-full", "latest", "from-snapshot", "from-snapshot-full")


@dataclass
class Options:
    """A table's options with their defaults; unknown keys are kept and ignored."""

    raw: dict[str, str] = field(default_factory=dict)
    bucket: int = UNAWARE
    bucket_key: list[str] = field(default_factory=list)
    merge_engine: str = "deduplicate"
    sequence_field: list[str] = field(default_factory=list)
    descending: bool = False
    ignore_delete: bool = False
    remove_on_delete: bool = False
    remove_on_group: list[str] = field(default_factory=list)
    groups: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    aggregates: dict[str, str] = field(default_factory=dict)
    default_aggregate: str | None = None
    ignore_retract: set[str] = field(default_factory=set)
    changelog_producer: str = "none"
    deletion_vectors: bool = False
    force_lookup: bool = False
    row_tracking: bool = False
    data_evolution: bool = False
    scan_mode: str = "default"
    snapshot_id: int | None = None
    fallback_branch: str | None = None
    branch: str = "main"
    partition_default: str = "__DEFAULT_PARTITION__"
    file_format: str = "parquet"
    compression: str = "zstd"
    target_file_size: int = 256 << 20
    split_target: int = 128 << 20
    open_cost: int = 4 << 20
    bitmap_columns: list[str] = field(default_factory=list)
    bloom_columns: list[str] = field(default_factory=list)
    file_index_read: bool = True
    global_index: bool = True
    blob_as_descriptor: bool = False
    external_paths: list[str] = field(default_factory=list)
    external_strategy: str = "none"
    data_prefix: str = "data-"
    retain_min: int = 10
    retain_max: int = 2**31 - 1
    retain_time: float = 3600.0
    expire_limit: int = 10
    commit_retries: int = 10
    commit_timeout: float | None = None
    manifest_min: int = 30
    manifest_target: int = 8 << 20
    manifest_full: int = 16 << 20

    @classmethod
    def of(cls, raw: dict[str, Any] | None) -> Options:
        raw = {k: str(v) for k, v in (raw or {}).items()}
        out = cls(raw=raw)
        plain = {"bucket": ("bucket", int), "bucket-key": ("bucket_key", _names), "merge-engine": ("merge_engine", str), "sequence.field": ("sequence_field", _names), "ignore-delete": ("ignore_delete", _flag),
                 "partial-update.remove-record-on-delete": ("remove_on_delete", _flag), "partial-update.remove-record-on-sequence-group": ("remove_on_group", _names), "changelog-producer": ("changelog_producer", str),
                 "deletion-vectors.enabled": ("deletion_vectors", _flag), "force-lookup": ("force_lookup", _flag), "row-tracking.enabled": ("row_tracking", _flag), "data-evolution.enabled": ("data_evolution", _flag),
                 "scan.mode": ("scan_mode", str), "scan.snapshot-id": ("snapshot_id", int), "scan.fallback-branch": ("fallback_branch", str), "branch": ("branch", str), "partition.default-name": ("partition_default", str),
                 "file.format": ("file_format", str), "file.compression": ("compression", str), "target-file-size": ("target_file_size", memory_size), "source.split.target-size": ("split_target", memory_size),
                 "source.split.open-file-cost": ("open_cost", memory_size), "file-index.bitmap.columns": ("bitmap_columns", _names), "file-index.bloom-filter.columns": ("bloom_columns", _names),
                 "file-index.read.enabled": ("file_index_read", _flag), "global-index.enabled": ("global_index", _flag), "blob-as-descriptor": ("blob_as_descriptor", _flag), "data-file.external-paths": ("external_paths", _names),
                 "data-file.external-paths.strategy": ("external_strategy", str), "data-file.prefix": ("data_prefix", str), "snapshot.num-retained.min": ("retain_min", int), "snapshot.num-retained.max": ("retain_max", int),
                 "snapshot.time-retained": ("retain_time", duration), "snapshot.expire.limit": ("expire_limit", int), "commit.max-retries": ("commit_retries", int), "commit.timeout": ("commit_timeout", duration),
                 "manifest.merge-min-count": ("manifest_min", int), "manifest.target-file-size": ("manifest_target", memory_size),
                 "manifest.full-compaction-threshold-size": ("manifest_full", memory_size), "fields.default-aggregate-function": ("default_aggregate", str)}
        for k, v in raw.items():
            if k in plain:
                name, turn = plain[k]
                setattr(out, name, turn(v))
            elif k == "sequence.field.sort-order":
                if v not in ("ascending", "descending"):
                    raise ValueError(f"unknown sort order {v!r}")
                out.descending = v == "descending"
            elif m := re.fullmatch(r"fields\.(.+)\.(sequence-group|aggregate-function|ignore-retract)", k):
                if m[2] == "sequence-group":
                    out.groups[tuple(_names(m[1]))] = _names(v)
                elif m[2] == "aggregate-function":
                    out.aggregates[m[1]] = v
                elif _flag(v):
                    out.ignore_retract.add(m[1])
        if out.merge_engine not in ENGINES:
            raise ValueError(f"unknown merge engine {out.merge_engine!r}")
        if out.scan_mode not in SCAN_MODES:
            raise ValueError(f"unknown scan mode {out.scan_mode!r}")
        if out.external_strategy not in ("none", "round-robin"):
            raise ValueError(f"external path strategy {out.external_strategy!r} is not supported")
        return out

    @property
    def lookup(self) -> bool:
        return self.deletion_vectors or self.force_lookup or self.changelog_producer == "lookup"

    def merge_spec(self, keys: list[str]) -> MergeSpec:
        return MergeSpec(keys, self.merge_engine, self.sequence_field, self.descending, self.ignore_delete, self.remove_on_delete, self.groups, self.remove_on_group, self.aggregates, self.default_aggregate, self.ignore_retract, self.lookup)

    def mode(self) -> str:
        """`default` means from-snapshot with a snapshot id, else latest-full."""
        if self.scan_mode == "default":
            return "from-snapshot" if self.snapshot_id is not None else "latest-full"
        if self.scan_mode.startswith("from-snapshot") and self.snapshot_id is None:
            raise ValueError(f"scan.mode {self.scan_mode} needs scan.snapshot-id")
        return self.scan_mode


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: Any  # a type string, or a nested type's object
    description: str | None = None

    @property
    def spark(self) -> T.DataType:
        return parse_type(self.type)[0]

    @property
    def nullable(self) -> bool:
        return parse_type(self.type)[1]

    @property
    def blob(self) -> bool:
        return isinstance(self.type, str) and self.type.upper().startswith("BLOB")


@dataclass(frozen=True)
class TableSchema:
    id: int
    fields: tuple[Field, ...]
    highest: int
    partition_keys: tuple[str, ...] = ()
    primary_keys: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)
    comment: str = ""
    millis: int = 0

    @classmethod
    def create(cls, fields: T.StructType | dict[str, Any], partition_keys=(), primary_keys=(), options=None, comment: str = "") -> TableSchema:
        """Assigns field ids in order, nested fields included."""
        if isinstance(fields, T.StructType):
            fields = {f.name: print_type(f.dataType, f.nullable) for f in fields} if len({f.name for f in fields}) == len(fields) else _twice(fields)
        n = -1

        def numbered(spec):
            nonlocal n
            if not isinstance(spec, dict):
                return spec
            out = dict(spec)
            for k in ("element", "key", "value"):
                if k in out:
                    out[k] = numbered(out[k])
            if "fields" in out:
                done = []
                for f in out["fields"]:
                    n += 1
                    done.append({**f, "id": n, "type": numbered(f["type"])} if not isinstance(f["type"], str) else {**f, "id": n})
                out["fields"] = done
            return out

        own = []
        for name, spec in fields.items():
            n += 1
            ident = n
            if name in primary_keys and isinstance(spec, str) and not spec.upper().endswith("NOT NULL"):
                spec = f"{spec} NOT NULL"
            own.append(Field(ident, name, numbered(spec)))
        out = cls(0, tuple(own), n, tuple(partition_keys), tuple(primary_keys), {k: str(v) for k, v in (options or {}).items()}, comment, int(time.time() * 1000))
        validate(out)
        return out

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark, True, {"id": f.id}) for f in self.fields])

    @property
    def opts(self) -> Options:
        return Options.of(self.options)

    @property
    def trimmed_keys(self) -> list[str]:
        """The primary key without partition keys."""
        return [k for k in self.primary_keys if k not in self.partition_keys]

    @property
    def bucket_keys(self) -> list[str]:
        return self.opts.bucket_key or self.trimmed_keys

    def to_json(self) -> str:
        fields = [{"id": f.id, "name": f.name, "type": f.type} | ({"description": f.description} if f.description else {}) for f in self.fields]
        return json.dumps({"version": 3, "id": self.id, "fields": fields, "highestFieldId": self.highest, "partitionKeys": list(self.partition_keys), "primaryKeys": list(self.primary_keys),
                           "options": self.options, "comment": self.comment, "timeMillis": self.millis}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> TableSchema:
        d = json.loads(text)
        fields = tuple(Field(f["id"], f["name"], f["type"], f.get("description")) for f in d["fields"])
        return cls(d["id"], fields, d["highestFieldId"], tuple(d["partitionKeys"]), tuple(d["primaryKeys"]), d.get("options", {}), d.get("comment") or "", d.get("timeMillis", 0))

    def altered(self, *changes: tuple) -> TableSchema:
        """The next version. Changes: ("add", name, type), ("drop", name), ("rename", old, new), ("type", name, type),
        ("move", name, place), ("set", key, value), ("unset", key)."""
        fields, options, highest = list(self.fields), dict(self.options), self.highest
        at = lambda name: next(i for i, f in enumerate(fields) if f.name == name)
        for what, *args in changes:
            if what in ("drop", "rename", "type", "move") and args[0] not in [f.name for f in fields]:
                raise ValueError(f"no column {args[0]!r}")
            if what in ("drop", "rename") and args[0] in self.partition_keys + self.primary_keys:
                raise ValueError(f"key column {args[0]!r} can't be changed")
            if what == "add":
                if args[0] in [f.name for f in fields]:
                    raise ValueError(f"column {args[0]!r} exists")
                highest += 1
                fields.append(Field(highest, args[0], args[1]))
            elif what == "drop":
                fields.pop(at(args[0]))
                if not fields:
                    raise ValueError("the last column can't be dropped")
            elif what == "rename":
                if args[1] in [f.name for f in fields]:
                    raise ValueError(f"column {args[1]!r} exists")
                fields[at(args[0])] = replace(fields[at(args[0])], name=args[1])
            elif what == "type":
                if not supported(fields[at(args[0])].spark, parse_type(args[1])[0]):
                    raise ValueError(f"column {args[0]!r} can't become {args[1]}")
                fields[at(args[0])] = replace(fields[at(args[0])], type=args[1])
            elif what == "move":
                f = fields.pop(at(args[0]))
                fields.insert(args[1], f)
            elif what == "set":
                if args[0] == "merge-engine" or args[0] == "bucket" and self.opts.bucket == UNAWARE:
                    raise ValueError(f"option {args[0]!r} can't be changed")
                options[args[0]] = str(args[1])
            elif what == "unset":
                options.pop(args[0], None)
            else:
                raise ValueError(f"unknown change {what!r}")
        out = replace(self, id=self.id + 1, fields=tuple(fields), highest=highest, options=options, millis=int(time.time() * 1000))
        validate(out)
        return out


def _twice(fields: T.StructType):
    seen: set[str] = set()
    raise ValueError(f"columns named twice: {[f.name for f in fields if f.name in seen or seen.add(f.name)]}")


def validate(s: TableSchema) -> None:
    """What a schema must hold to be stored."""
    def need(ok: bool, message: str) -> None:
        if not ok:
            raise ValueError(message)

    names, o = s.names, s.opts
    for what, keys in (("column", names), ("bucket key", s.bucket_keys), ("primary key", s.primary_keys), ("partition key", s.partition_keys)):
        need(len(set(keys)) == len(list(keys)), f"duplicate {what} in {list(keys)}")
        need(set(keys) <= set(names), f"{what}s {list(keys)} are not all columns of {names}")
    for k in (*s.primary_keys, *s.partition_keys):
        need(not isinstance(s.field(k).spark, (T.ArrayType, T.MapType, T.StructType)) and not s.field(k).blob, f"key {k} must be of a primitive type")
    for k in s.partition_keys:
        need(not isinstance(s.field(k).spark, (T.DecimalType, T.TimestampType, T.TimestampNTZType)), f"partition key {k} can't be a timestamp or decimal")
    for n in names:
        need(n not in SPECIAL and not n.startswith(KEY_PREFIX), f"column name {n!r} is reserved")
    if s.primary_keys:
        need(bool(s.trimmed_keys), f"primary key {list(s.primary_keys)} must have more than the partition keys")
        need(set(s.bucket_keys) <= set(s.primary_keys), f"bucket keys {s.bucket_keys} must be part of the primary key")
    need(not set(s.bucket_keys) & set(s.partition_keys), "bucket keys can't be partition keys")
    need(o.bucket != 0 and o.bucket >= POSTPONE, "the number of buckets must be greater than 0")
    if o.bucket == UNAWARE:
        need(not o.bucket_key, "bucket -1 can't have a bucket key")
    elif o.bucket == POSTPONE:
        need(bool(s.primary_keys), "bucket -2 is for tables with a primary key")
    elif not s.primary_keys:
        need(bool(o.bucket_key), "a bucketed append table needs a bucket-key")
    for k in o.raw:
        if k.startswith("fields.") and k != "fields.default-aggregate-function":
            m = re.fullmatch(r"fields\.(.+)\.[a-z-]+", k)
            need(bool(m) and set(_names(m[1])) <= set(names), f"invalid option key {k}")
    need(set(o.sequence_field) <= set(names), f"sequence fields {o.sequence_field} are not all columns")
    need(len(set(o.sequence_field)) == len(o.sequence_field), "a sequence field is named twice")
    need(not (o.sequence_field and o.merge_engine == "first-row"), "first-row takes no sequence field")
    for f in o.sequence_field:
        need(f not in o.aggregates, f"sequence field {f} can't have an aggregate function")
        need(f not in s.partition_keys, f"sequence field {f} can't be a partition key")
    governed: dict[str, tuple] = {}
    for g, cols in o.groups.items():
        need(set(g) | set(cols) <= set(names), f"sequence group {g}: {cols} has unknown columns")
        for c in (*g, *cols):
            need(c not in governed, f"column {c} is in more than one sequence group")
            need(c not in s.primary_keys, f"primary key {c} can't be in a sequence group")
            governed[c] = g
        need(not set(g) & set(o.aggregates), f"sequence fields {g} can't have an aggregate function")
    for c, f in o.aggregates.items():
        need(f in AGGREGATES, f"unknown aggregate function {f!r}")
        need(not (f in ("bool_and", "bool_or") and not isinstance(s.field(c).spark, T.BooleanType)), f"{f} is for booleans, not {c}")
    if not s.primary_keys:
        need(o.changelog_producer == "none", "a changelog producer needs a primary key")
    need(o.retain_min >= 1, "snapshot.num-retained.min should be at least 1")
    need(o.retain_min <= o.retain_max, "snapshot.num-retained.min should not be larger than the maximum")
    if o.merge_engine == "first-row":
        need(o.changelog_producer in ("none", "lookup"), "first-row works with the changelog producers none and lookup")
    if o.deletion_vectors:
        need(o.changelog_producer in ("none", "input", "lookup"), "deletion vectors work with the changelog producers none, input and lookup")
        need(o.merge_engine != "first-row", "first-row needs no deletion vectors")
    blobs = [f.name for f in s.fields if f.blob]
    if o.row_tracking or o.data_evolution or blobs:
        need(not s.primary_keys, "row tracking is for tables without a primary key")
        need(o.bucket == UNAWARE, "row tracking needs bucket -1")
    need(o.file_format == "parquet" or not (o.row_tracking or o.deletion_vectors), "row positions need files in parquet")
    if o.data_evolution:
        need(o.row_tracking, "data evolution needs row-tracking.enabled")
        need(not o.deletion_vectors, "data evolution doesn't work with deletion vectors")
    if blobs:
        need(o.data_evolution and len(blobs) == 1 and len(names) > 1, "a table may have one blob column, with data evolution and another column")
        need(blobs[0] not in s.partition_keys, "a blob can't be a partition key")
