"""A table: scans, writes, commits and upkeep. Metadata work is the driver's; rows are only ever touched by Spark plans."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions.casts import cast
from ..operators import evolution, merge as M
from ..plans import ranges as R
from ..plans.metadata import ADD, APPEND, COMPACT, DELETE, OVERWRITE, DataFile, Entry, Metadata, Snapshot, now, plain, rich
from ..plans.planner import ScanPlan, partition_matches, partition_predicate, plan, typed
from ..plans.schema import POSTPONE, UNAWARE, Options, TableSchema
from ..plans.store import Store
from .files import footers

ROW_ID, SCORE = "_ROW_ID", "_INDEX_SCORE"
#: Rows of (file, position), or (file, first row id), that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_FILES = 500_000, 100_000
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


#: Scheme and slashes at the start of a path, which file systems spell in several ways.
SCHEME = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*"
#: Rows of a partition whose sequence numbers stand together, in bits.
TOGETHER_BITS = 26


def bare(path: str) -> str:
    return re.sub(SCHEME, "", path)


class CommitConflict(RuntimeError):
    pass


@dataclass
class CommitMessage:
    """What a write has made and a commit makes visible."""

    entries: list[Entry] = field(default_factory=list)
    index_added: list[dict] = field(default_factory=list)
    index_deleted: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        """For a coordinator elsewhere (O-139)."""
        return json.dumps({"version": 1, "entries": [e.to_json() for e in self.entries], "index_added": plain(self.index_added), "index_deleted": self.index_deleted})

    @classmethod
    def from_json(cls, text: str) -> CommitMessage:
        d = json.loads(text)
        if d["version"] != 1:
            raise ValueError(f"commit message of version {d['version']}")
        return cls([Entry.from_json(e) for e in d["entries"]], rich(d["index_added"]), d["index_deleted"])


def bucket_id(keys: Iterable[str], n: int) -> Column:
    """The bucket of a row. Our own layout: Spark's hash of the keys, modulo n."""
    return F.lit(0) if n in (UNAWARE, 1) else F.lit(POSTPONE) if n == POSTPONE else F.pmod(F.hash(*keys), F.lit(n))


class Table:
    def __init__(self, spark: SparkSession, path: str, branch: str | None = None):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark)
        main = Metadata(self.store, self.path)
        if branch is None:
            branch = self._latest_schema(main).opts.branch
        self.branch = branch
        self.meta = main if branch == "main" else Metadata(self.store, self.path, branch)
        self._schemas: dict[int, TableSchema] = {}
        self.metrics: dict[str, int] = {}

    # schema

    def _latest_schema(self, meta: Metadata) -> TableSchema:
        ids = [int(n[7:]) for n in self.store.names(f"{meta.root}/schema") if n.startswith("schema-")]
        if not ids:
            raise ValueError(f"no schema in {meta.root}")
        return TableSchema.from_json(self.store.read(f"{meta.root}/schema/schema-{max(ids)}"))

    @property
    def schema(self) -> TableSchema:
        return self._latest_schema(self.meta)

    def schema_of(self, ident: int) -> TableSchema:
        if ident not in self._schemas:
            self._schemas[ident] = TableSchema.from_json(self.store.read(f"{self.meta.root}/schema/schema-{ident}"))
        return self._schemas[ident]

    def alter(self, *changes: tuple) -> TableSchema:
        """See TableSchema.altered. Of two writers of one version, one has to start again."""
        for _ in range(10):
            new = self.schema.altered(*changes)
            if self.store.publish(f"{self.meta.root}/schema/schema-{new.id}", new.to_json()):
                return new
        raise CommitConflict("the schema keeps changing")

    def create_branch(self, name: str, schema: TableSchema | None = None) -> Table:
        root = f"{self.path}/branch/branch-{name}"
        self.store.mkdirs(f"{root}/schema")
        own = replace(schema or self.schema, id=0)
        if not self.store.publish(f"{root}/schema/schema-0", own.to_json()):
            raise ValueError(f"branch {name!r} exists")
        return Table(self.spark, self.path, name)

    def options(self, extra: dict | None = None, schema: TableSchema | None = None) -> Options:
        """The schema's options under those of the query."""
        return Options.of({**(schema or self.schema).options, **(extra or {})})

    def uri(self, path: str) -> str:
        return path if "://" in path or path.startswith(("/", "file:")) else f"{self.path}/{path}"

    def key_of(self, path: str) -> str:
        """What names a file in row positions: its path below the table, or the whole path without scheme if it lies elsewhere."""
        return path if self.uri(path) != path else bare(self.store.qualified(path))

    def key_column(self) -> Column:
        """key_of, of the file that a row is read from. Names alone don't tell files apart: all partitions and buckets of a
        writing task share one."""
        whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        whole = F.regexp_replace(whole, SCHEME, "")
        root = bare(self.store.qualified(self.path)) + "/"
        return F.when(F.startswith(whole, F.lit(root)), F.substr(whole, F.lit(len(root) + 1))).otherwise(whole)

    # scan

    def resolve(self, options: Options, snapshot_id: int | None = None) -> Snapshot | None:
        """The snapshot of a batch scan: the latest, or the one asked for, which must exist."""
        wanted = snapshot_id if snapshot_id is not None else options.snapshot_id if options.mode().startswith("from-snapshot") else None
        latest = self.meta.latest_id()
        if latest is None:
            return None
        if wanted is None:
            return self.meta.snapshot(latest)
        earliest = self.meta.earliest_id()
        if not earliest <= wanted <= latest:
            raise ValueError(f"snapshot {wanted} is not between the earliest ({earliest}) and the latest ({latest})")
        return self.meta.snapshot(wanted)

    def plan(self, where: P.Predicate | None = None, partitions=None, bucket: int | None = None, limit: int | None = None, snapshot_id: int | None = None, options: dict | None = None,
             row_ranges=None, levels: Callable[[int], bool] | None = None) -> ScanPlan:
        schema = self.schema
        opts = self.options(options, schema)
        snapshot = self.resolve(opts, snapshot_id)
        return self._plan(snapshot, schema, opts, where, partitions, bucket, limit, row_ranges, levels)

    def _plan(self, snapshot, schema, opts, where=None, partitions=None, bucket=None, limit=None, row_ranges=None, levels=None, delta=False) -> ScanPlan:
        from ..plans import indexes

        dvs = self._vectors(snapshot) if snapshot else []
        gone = defaultdict(int)
        for v in dvs:
            for f, n in v["files"].items():
                gone[f] += n
        ranges = None if row_ranges is None else R.merge(row_ranges)
        return plan(self.meta, snapshot, schema, opts, self.schema_of, where, partitions, bucket, levels, ranges, limit, delta, lambda es, p: indexes.skipped(self, es, p, schema), gone)

    def scan(self, columns: list[str] | None = None, where: P.Predicate | Column | None = None, partitions: Iterable[dict] | None = None, bucket: int | None = None, limit: int | None = None, snapshot_id: int | None = None,
             options: dict | None = None, row_ranges=None, index=None, vector=None, levels: Callable[[int], bool] | None = None, with_kind: bool = False) -> DataFrame:
        """The rows of a snapshot. A Predicate prunes files and filters exactly, a Column only filters. `_ROW_ID` and
        `_SEQUENCE_NUMBER` may be asked for on tables with row tracking. The result stays with the snapshot it was planned on.

        index: a result of tidelake.plans.indexes; vector: (column, query, k) with optional metric, top k by distance."""
        schema = self.schema
        opts = self.options(options, schema)
        snapshot = self.resolve(opts, snapshot_id)
        of_file = where if isinstance(where, P.Predicate) else None
        plain = where is None and vector is None and index is None
        p = self._plan(snapshot, schema, opts, of_file, partitions, bucket, limit if plain else None, row_ranges if index is None else index.ranges, levels)
        wanted = columns or schema.names
        self._check_columns(wanted, schema, opts)
        extra = [c for c in (ROW_ID, M.SEQUENCE) if c in wanted or c == ROW_ID and (row_ranges is not None or index is not None)]
        needed = None if where is not None and of_file is None else {*wanted, *P.fields(of_file), *schema.partition_keys, *([vector[0]] if vector else [])}
        df = self.read(p, opts, extra, snapshot, needed)
        if opts.fallback_branch and self.branch == "main":
            df = self._with_fallback(df, p, opts, where, partitions, bucket, extra, needed)
        spec = partition_predicate(partitions, schema, opts.partition_default)
        for cond in (spec, of_file):
            if cond is not None:
                df = df.filter(cond.column())
        if where is not None and of_file is None:
            df = df.filter(where)
        if p.row_ranges is not None and index is None:
            df = df.filter(R.contains(F.col(ROW_ID), p.row_ranges))
        if index is not None:
            df = index.applied(df)
        if vector is not None:
            from ..operators.vector import top_k

            df = top_k(df, *vector)
        if limit is not None:
            df = df.limit(limit)
        out = [c for c in wanted if c in df.columns] + ([SCORE] if SCORE in df.columns and SCORE not in wanted else [])
        df = df.select(*out)
        return df.select(F.lit(0).cast("tinyint").alias(M.KIND), "*") if with_kind and M.KIND not in df.columns else df

    def _check_columns(self, wanted, schema, opts) -> None:
        known = {*schema.names, SCORE} | ({ROW_ID, M.SEQUENCE} if opts.row_tracking else set())
        if stray := [c for c in wanted if c not in known]:
            raise ValueError(f"no columns {stray}")

    def _with_fallback(self, df: DataFrame, p: ScanPlan, opts: Options, where, partitions, bucket, extra, needed) -> DataFrame:
        """Partitions that the main branch doesn't have come from the fallback branch (O-29)."""
        other = Table(self.spark, self.path, opts.fallback_branch)
        snapshot = other.meta.latest()
        if snapshot is None:
            return df
        mine = {e.partition for e in self.meta.entries(p.snapshot)} if p.snapshot else set()
        theirs = other.schema
        more = other._plan(snapshot, theirs, other.options(schema=theirs), where if isinstance(where, P.Predicate) else None, partitions, bucket)
        more.raw, more.merged = ([e for e in es if e.partition not in mine] for es in (more.raw, more.merged))
        return df.unionByName(other.read(more, other.options(schema=theirs), extra, snapshot, needed), allowMissingColumns=True).select(*df.columns)

    def read(self, p: ScanPlan, opts: Options, extra: list[str] | None = None, snapshot: Snapshot | None = None, needed: set[str] | None = None) -> DataFrame:
        """The rows of a plan's files, versions merged; with `needed`, only these columns, so that the others aren't read."""
        schema = p.schema
        if opts.data_evolution and p.snapshot is not None:
            return evolution.stitched(self, p.entries, schema, [*schema.names, *(extra or [])])
        names = [n for n in schema.names if needed is None or n in needed]
        parts = []
        if p.raw or not p.merged:
            raw = self.records(p.raw, schema, hidden=False, extra=extra or [], snapshot=snapshot)
            parts.append(raw.select(*(c for c in raw.columns if c not in schema.names), *names))
        if p.merged:
            parts.append(self.merged(p.merged, schema, opts, snapshot, names=names))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def merged(self, entries: list[Entry], schema: TableSchema, opts: Options, snapshot: Snapshot | None = None, keep_deletes: bool = False, names: list[str] | None = None) -> DataFrame:
        names = schema.names if names is None else names
        spec = opts.merge_spec(list(schema.primary_keys))
        spec.insert_only = all(e.file.deletes == 0 for e in entries)
        # what the merge needs besides: sequence fields, and those of the groups of these columns or that may wipe a row
        kept = {g: [c for c in cols if c in names] for g, cols in spec.groups.items() if {*g, *cols} & set(names) or set(g) & set(spec.remove_on_group)}
        spec.groups = kept or {g: [] for g in list(spec.groups)[:1]}  # that there are groups decides what retractions do
        used = {*names, *spec.keys, *spec.sequence_fields, *(f for g in spec.groups for f in g)}
        rows = self.records(entries, schema, hidden=True, with_level=spec.lookup, snapshot=snapshot)
        rows = rows.select(*(c for c in rows.columns if c in used or c not in schema.names))
        out = M.merge(rows, spec, keep_deletes)
        return out.select(*([M.KIND] if keep_deletes else []), *names)

    def records(self, entries: list[Entry], schema: TableSchema, hidden: bool, extra: list[str] | None = None, with_level: bool = False, snapshot: Snapshot | None = None) -> DataFrame:
        """Files as rows under the current schema: columns by field id, casts, nulls for columns that a file hasn't (O-38).
        hidden: with sequence number and row kind, for merging."""
        extra = extra or []
        kept = [c for c in (M.SEQUENCE, M.KIND) if hidden]
        level = [M.LEVEL] if with_level else []
        groups: dict[tuple, list[Entry]] = defaultdict(list)
        for e in entries:
            groups[e.file.schema_id, e.file.level if with_level else 0, e.file.write_cols].append(e)
        parts = []
        for (ident, at_level, cols), es in sorted(groups.items(), key=lambda x: (x[0][0], x[0][1], x[0][2] or ())):
            df = self.open(es, self.schema_of(ident), cols, bool(schema.primary_keys), bool(extra), snapshot)
            parts.append(df.select(*(c for c in kept), *([F.lit(at_level).alias(M.LEVEL)] if level else []), *(F.col(c) for c in extra if c not in kept), *mapped(df, self.schema_of(ident), schema)))
        if parts:
            return reduce(lambda a, b: a.unionByName(b), parts)
        special = {M.SEQUENCE: T.LongType(), M.KIND: T.ByteType(), M.LEVEL: T.IntegerType(), ROW_ID: T.LongType()}
        empty = T.StructType([T.StructField(c, special[c]) for c in (*kept, *level, *(x for x in extra if x not in kept))] + [T.StructField(f.name, f.dataType) for f in schema.struct])
        return self.spark.createDataFrame([], empty)

    def open(self, entries: list[Entry], written: TableSchema, cols: tuple[str, ...] | None, keyed: bool, tracked: bool, snapshot: Snapshot | None = None) -> DataFrame:
        """Files of one schema as they are, without rows that deletion vectors take; with row ids and sequence numbers if tracked."""
        own = [f for f in written.struct if cols is None or f.name in cols]
        special = [T.StructField(M.SEQUENCE, T.LongType()), T.StructField(M.KIND, T.ByteType())] if keyed else [T.StructField(ROW_ID, T.LongType())] if cols is not None and ROW_ID in cols else []
        schema = T.StructType(special + [T.StructField(f.name, f.dataType) for f in own])
        kinds = sorted({e.file.kind for e in entries})
        df = reduce(lambda a, b: a.union(b), [self.spark.read.schema(schema).format(k).load([self.uri(e.file.path) for e in entries if e.file.kind == k]) for k in kinds])
        paths = {e.file.path for e in entries}
        vectors = [v for v in (self._vectors(snapshot) if snapshot else []) if any(f in paths for f in v["files"])]
        if vectors or tracked:
            df = df.select("*", self.key_column().alias("_file"), F.col("_metadata.row_index").alias("_at"))
        if vectors:
            df = df.join(self._deleted(vectors), ["_file", "_at"], "left_anti")
        if tracked:
            first = self.spark.createDataFrame([(self.key_of(e.file.path), e.file.first_row_id, e.file.max_seq) for e in entries], "_file string, _first long, _seq long")  # a row for each file that the driver has listed
            df = df.join(F.broadcast(first) if len(entries) <= BROADCAST_FILES else first, "_file")
            row = F.col("_first") + F.col("_at")
            df = df.withColumn(ROW_ID, F.coalesce(ROW_ID, row) if ROW_ID in df.columns else row).withColumn(M.SEQUENCE, F.col("_seq")).drop("_first", "_seq")
        return df.drop("_file", "_at") if vectors or tracked else df

    def changes(self, snapshot_id: int, with_kind: bool = True, where: P.Predicate | None = None) -> DataFrame:
        """The rows that one snapshot added, unmerged, with their kinds (O-16, O-36, O-37)."""
        schema = self.schema
        s = self.meta.snapshot(snapshot_id)
        p = self._plan(s, schema, self.options(schema=schema), P.only(where, [*schema.partition_keys, *schema.trimmed_keys]) if schema.primary_keys else where, delta=True)
        keyed = bool(schema.primary_keys)
        df = self.records(p.entries, schema, hidden=keyed)
        df = df if keyed else df.select(F.lit(0).cast("tinyint").alias(M.KIND), "*")
        if where is not None:
            df = df.filter(where.column())
        return df.select(*([M.KIND] if with_kind else []), *schema.names)

    # listings

    def files(self, snapshot_id: int | None = None) -> DataFrame:
        s = self.meta.snapshot(snapshot_id) if snapshot_id else self.meta.latest()
        rows = [([None if v is None else str(v) for v in e.partition], e.bucket, e.file.path, e.file.level, e.file.rows, e.file.size, e.file.schema_id, e.file.min_seq, e.file.max_seq, e.file.first_row_id) for e in (self.meta.entries(s) if s else [])]
        return self.spark.createDataFrame(rows, "partition array<string>, bucket int, path string, level int, record_count long, file_size long, schema_id long, min_sequence long, max_sequence long, first_row_id long")

    def partitions(self, snapshot_id: int | None = None) -> DataFrame:
        """Record and file counts, size and last change of each partition (O-28, O-168)."""
        s = self.meta.snapshot(snapshot_id) if snapshot_id else self.meta.latest()
        total: dict[tuple, list] = defaultdict(lambda: [0, 0, 0, 0])
        for e in self.meta.entries(s) if s else []:
            t = total[e.partition]
            t[0], t[1], t[2], t[3] = t[0] + e.file.rows, t[1] + 1, t[2] + e.file.size, max(t[3], e.file.millis)
        return self.spark.createDataFrame([([None if v is None else str(v) for v in k], *v) for k, v in total.items() if v[1] > 0], "partition array<string>, record_count long, file_count long, file_size long, last_change long")

    def snapshots(self) -> DataFrame:
        rows = [(s.id, s.schema_id, s.kind, s.user, s.identifier, s.millis, s.total, s.delta_rows, s.watermark, s.next_row_id) for s in self.meta.snapshots()]
        return self.spark.createDataFrame(rows, "id long, schema_id long, kind string, user string, identifier long, millis long, total long, delta long, watermark long, next_row_id long")

    # write

    def write(self, df: DataFrame, columns: list[str] | None = None, level: int = 0, kinds: bool = True) -> CommitMessage:
        """Writes rows to new files that no reader sees before a commit. `_VALUE_KIND` gives row kinds on keyed tables.
        columns: a subset on a table with data evolution; df then has `_ROW_ID` and those columns."""
        schema = self.schema
        opts, keyed = schema.opts, bool(schema.primary_keys)
        if opts.file_format not in ("parquet", "orc"):
            raise ValueError(f"tables are written as parquet or orc, not {opts.file_format}")
        if columns is not None:
            if not opts.data_evolution or ROW_ID not in df.columns or not set(columns) <= set(schema.names):
                raise ValueError("a subset of columns needs data evolution, known columns and _ROW_ID")
        elif missing := [n for n in schema.names if n not in df.columns]:
            raise ValueError(f"columns {missing} are missing")
        names = columns or schema.names
        have = df.schema
        cols = [(F.col(n) if have[n].dataType == schema.field(n).spark else F.col(n).cast(schema.field(n).spark)).alias(n) for n in names]
        special: list[Column] = []
        if keyed:
            if M.KIND not in df.columns or not kinds:
                df = df.withColumn(M.KIND, F.lit(0).cast("tinyint"))
            if M.SEQUENCE not in df.columns:
                df = self._sequenced(df, schema)
            special = [F.col(M.SEQUENCE).cast("long").alias(M.SEQUENCE), F.col(M.KIND).cast("tinyint").alias(M.KIND)]
        elif columns is not None:
            special = [F.col(ROW_ID).cast("long").alias(ROW_ID)]
        keys = list(schema.partition_keys)
        df = df.select(*special, *cols)
        if columns is not None and keys:
            df = self._placed(df, schema)
        for k in keys if columns is None else []:  # a blank partition value is the default partition, which reads as null
            if isinstance(schema.field(k).spark, T.StringType):
                df = df.withColumn(k, F.when(F.trim(k) != "", F.col(k)))
        bucket = bucket_id(schema.bucket_keys, opts.bucket) if keyed or opts.bucket_key else F.lit(0)
        if columns is None:
            df = df.select("*", *(F.col(k).alias(f"_pt{i}") for i, k in enumerate(keys)))
        df = df.select("*", bucket.alias("_bucket"))
        places = [*(f"_pt{i}" for i in range(len(keys))), "_bucket"]
        if keys or opts.bucket > 1 or keyed:
            df = df.hint("rebalance", *places)  # one place's rows together, large places in several files
        if keyed and opts.bucket != POSTPONE:
            df = df.sortWithinPartitions(*places, *schema.trimmed_keys, M.SEQUENCE)
        base = self.path
        if opts.external_paths and opts.external_strategy == "round-robin":
            self.metrics["external"] = self.metrics.get("external", -1) + 1
            base = opts.external_paths[self.metrics["external"] % len(opts.external_paths)].rstrip("/")
        folder = f"data/write-{uuid.uuid4().hex}"
        writer = df.write.option("compression", opts.compression)
        for c in opts.bloom_columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.partitionBy(*places).format(opts.file_format).save(f"{base}/{folder}")
        return self._message(base, folder, schema, opts, keys, columns, level)

    def _placed(self, df: DataFrame, schema: TableSchema) -> DataFrame:
        """Adds the partition of each row id as _pt0 and so on, by the ranges of row ids of the table's full files: a join by
        bins of row ids, with a row for each file and bin."""
        latest = self.meta.latest()
        full = [e for e in (self.meta.entries(latest) if latest else []) if e.file.write_cols is None and e.file.first_row_id is not None]
        keys = schema.partition_keys
        kinds = T.StructType([T.StructField("_first", T.LongType()), T.StructField("_last", T.LongType()), *(T.StructField(f"_pt{i}", schema.field(k).spark) for i, k in enumerate(keys))])
        spans = self.spark.createDataFrame([(e.file.first_row_id, e.file.last_row_id, *e.partition) for e in full], kinds)
        bin_of = lambda c: F.shiftright(c, 20)
        spans = spans.withColumn("_bin", F.explode(F.sequence(bin_of("_first"), bin_of("_last"))))
        spans = F.broadcast(spans) if len(full) <= BROADCAST_FILES else spans
        found = df.join(spans, (bin_of(ROW_ID) == F.col("_bin")) & F.col(ROW_ID).between(F.col("_first"), F.col("_last")))
        return found.drop("_first", "_last", "_bin")

    def _sequenced(self, df: DataFrame, schema: TableSchema) -> DataFrame:
        """Numbers records in the order in which they arrive, after all that the table has, in one pass: a number is the
        partition's, shifted, plus the place in it, so numbers grow but have gaps. A load of 100,000 partitions uses one of
        680,000 parts of all numbers, and a compaction starts from 0 again. Rows of a partition beyond the first 2^26 count
        as later than the other partitions' rows."""
        latest = self.meta.latest()
        start = (max((e.file.max_seq for e in self.meta.entries(latest)), default=-1) if latest else -1) + 1
        if start > 1 << 62:
            raise ValueError("sequence numbers run out; compact the table with fresh ones")
        at = F.monotonically_increasing_id()
        part, place = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
        number = F.when(place < 1 << TOGETHER_BITS, F.shiftleft(part, TOGETHER_BITS) + place).otherwise(at + F.lit(1 << 52))
        return df.withColumn(M.SEQUENCE, number + F.lit(start))

    def _message(self, base: str, folder: str, schema: TableSchema, opts: Options, keys: list[str], columns, level: int) -> CommitMessage:
        listed = [(p, n) for p, n, _ in self.store.files(f"{base}/{folder}") if p.endswith((".parquet", ".orc"))]
        out = CommitMessage()
        ids = {f.name: f.id for f in schema.fields}
        for (path, size), told in zip(listed, footers(self.spark, [self.store.qualified(f"{base}/{folder}/{p}") for p, _ in listed]), strict=True):
            if not told["rows"]:
                continue
            dirs = dict(x.split("=", 1) for x in path.split("/")[:-1])
            values = tuple(typed(None if (v := unquote(dirs[f"_pt{i}"])) == NULL_PARTITION else v, schema.field(k).spark) for i, k in enumerate(keys))
            stats = told["stats"]
            kind, seq, row = stats.get(M.KIND), stats.get(M.SEQUENCE), stats.get(ROW_ID)
            deletes = 0 if not kind or kind[0] is not None and (kind[1] == 0 or kind[0] == kind[1] == 2) else -1
            full = f"{folder}/{path}"
            f = DataFile(full if base == self.path else f"{base}/{full}", size, told["rows"], schema.id, level, seq[0] if seq and seq[0] is not None else 0, seq[1] if seq and seq[1] is not None else 0, deletes,
                         {str(ids[n]): s for n, s in stats.items() if n in ids}, row[0] if row else None, row[1] if row else None, tuple([ROW_ID, *columns]) if columns else None, now())
            out.entries.append(Entry(ADD, values, int(dirs["_bucket"]), f, opts.bucket))
        if opts.bitmap_columns and out.entries and columns is None:
            from ..plans import indexes

            out.entries = indexes.build_bitmaps(self, out.entries, [c for c in opts.bitmap_columns if c in schema.names])
        return out

    # commit

    def commit(self, message: CommitMessage | list[CommitMessage], identifier: int | None = None, watermark: int | None = None, user: str = "writer", kind: str = APPEND, ignore_empty: bool = False, check: bool = False, properties: dict | None = None, request_only: bool = False) -> Snapshot | dict | None:
        """Publishes messages as the next snapshot, trying again while others are faster. request_only: nothing is published,
        the request is returned for an external catalog."""
        messages = message if isinstance(message, list) else [message]
        entries = [e for m in messages for e in m.entries]
        added, gone = [i for m in messages for i in m.index_added], {p for m in messages for p in m.index_deleted}
        if ignore_empty and not entries and not added and not gone:
            return None
        opts, began, tries = self.schema.opts, time.time(), 0
        while True:
            tries += 1
            self.metrics["last_commit_attempts"] = tries
            out = self._try(entries, added, gone, identifier if identifier is not None else 2**62, watermark, user, kind, check or any(e.kind == DELETE for e in entries), properties or {}, opts, request_only)
            if out is not None:
                return out
            if tries > opts.commit_retries or opts.commit_timeout is not None and time.time() - began > opts.commit_timeout:
                raise CommitConflict(f"no commit after {tries} tries")

    def _try(self, entries, added, gone, identifier, watermark, user, kind, check, properties, opts, request_only):
        meta, latest = self.meta, self.meta.latest()
        if check and latest is not None:
            touched = {e.partition for e in entries}
            present = {e.identity for e in meta.entries(latest) if e.partition in touched}
        else:
            present = set()
        new = {e.identity for e in entries if e.kind == ADD}
        if lost := [e.file.path for e in entries if e.kind == DELETE and e.identity not in present | new]:
            raise CommitConflict(f"files {lost[:3]} to delete are not in the table any more")
        if twice := new & present:
            raise CommitConflict(f"files {sorted(p for *_, p in twice)[:3]} are in the table already")
        ident, first = (latest.id + 1, latest.next_row_id) if latest else (1, None)
        next_row = first
        if opts.row_tracking:
            next_row = first or 0
            done = []
            for e in entries:
                if e.kind == ADD and e.file.first_row_id is None:
                    f = replace(e.file, first_row_id=next_row, last_row_id=next_row + e.file.rows - 1, min_seq=ident, max_seq=ident)
                    next_row += e.file.rows
                    e = replace(e, file=f)
                elif e.kind == ADD and e.file.write_cols is not None:
                    e = replace(e, file=replace(e.file, min_seq=ident, max_seq=ident))
                done.append(e)
            entries = done
        made: list[str] = []
        try:
            base = [*meta.read_list(latest.base), *meta.read_list(latest.delta)] if latest else []
            base = meta.compacted(base, opts.manifest_min, opts.manifest_target, opts.manifest_full)
            base_list, delta = meta.write_list(base), meta.write_manifests(entries, opts.manifest_target)
            delta_list = meta.write_list(delta)
            made += [base_list, delta_list, *(m["name"] for m in delta)]
            index = latest.index if latest else None
            if added or gone:
                index = meta.write_index([i for i in meta.read_index(index) if i["path"] not in gone] + added)
                made.append(index)
            rows = sum(e.file.rows if e.kind == ADD else -e.file.rows for e in entries)
            marks = [w for w in (watermark, latest.watermark if latest else None) if w is not None]
            s = Snapshot(ident, self.schema.id, base_list, delta_list, kind, user, identifier, now(), (latest.total if latest else 0) + rows, rows, max(marks, default=None), next_row, index, properties)
        except Exception:
            self._abort(made)
            raise
        if request_only:
            return {"snapshot": s.to_json(), "partitions": [r.asDict() for r in self._partition_changes(entries)]}
        self.store.mkdirs(f"{meta.root}/snapshot")
        if not meta.store.publish(meta.path(ident), s.to_json()):
            self._abort(made)
            return None
        meta.hint("LATEST", ident)
        if ident == 1:
            meta.hint("EARLIEST", 1)
        return s

    def _partition_changes(self, entries):
        total: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
        for e in entries:
            sign = 1 if e.kind == ADD else -1
            t = total[e.partition]
            t[0], t[1], t[2] = t[0] + sign * e.file.rows, t[1] + sign, t[2] + sign * e.file.size
        return self.spark.createDataFrame([([None if v is None else str(v) for v in k], *v) for k, v in total.items()], "partition array<string>, records long, files long, size long").collect()

    def _abort(self, made: list[str]) -> None:
        for name in made:
            self.store.delete(f"{self.meta.root}/manifest/{name}")

    def append(self, df: DataFrame, **commit: Any) -> Snapshot | None:
        return self.commit(self.write(df), **commit)

    def filter_and_commit(self, messages: dict[int, CommitMessage | list[CommitMessage]], user: str = "writer", watermark: int | None = None) -> int:
        """Commits those identifiers that this user hasn't committed yet; returns how many."""
        last = self.meta.latest_of(user)
        todo = sorted((i, m) for i, m in messages.items() if last is None or i > last.identifier)
        for i, m in todo:
            for e in (e for x in (m if isinstance(m, list) else [m]) for e in x.entries):
                if e.kind == ADD and not self.store.exists(self.uri(e.file.path)):
                    raise FileNotFoundError(e.file.path)
            self.commit(m, i, watermark, user, check=True)
        return len(todo)

    def overwrite(self, message: CommitMessage, partitions: list[dict] | None = None, identifier: int | None = None, user: str = "writer", watermark: int | None = None) -> Snapshot | None:
        """Replaces all rows of the partitions (all: of the table) by the message's."""
        latest, schema = self.meta.latest(), self.schema
        spec = partition_predicate(partitions, schema, schema.opts.partition_default)
        if stray := [e.partition for e in message.entries if not partition_matches(spec, schema.partition_keys, e.partition)]:
            raise ValueError(f"rows of partition {stray[0]} are outside the partitions to overwrite")
        old = [replace(e, kind=DELETE) for e in (self.meta.entries(latest) if latest else []) if partition_matches(spec, schema.partition_keys, e.partition)]
        return self.commit(CommitMessage([*old, *message.entries], message.index_added, self._useless(latest, old)), identifier, watermark, user, OVERWRITE)

    def _useless(self, latest: Snapshot | None, gone: list[Entry]) -> list[str]:
        """Indexes of files that are all gone."""
        paths = {e.file.path for e in gone}
        return [i["path"] for i in (self.meta.read_index(latest.index) if latest else []) if i.get("files") and set(i["files"]) <= paths]

    def filter_and_overwrite(self, message: CommitMessage, partitions: list[dict] | None, identifier: int, user: str = "writer") -> int:
        last = self.meta.latest_of(user)
        if last is not None and identifier <= last.identifier:
            return 0
        self.overwrite(message, partitions, identifier, user)
        return 1

    def drop_partitions(self, partitions: list[dict], identifier: int | None = None, user: str = "writer") -> Snapshot | None:
        if not partitions:
            raise ValueError("no partitions to drop")
        return self.overwrite(CommitMessage(), partitions, identifier, user)

    def compact(self, level: int = 5, user: str = "compactor") -> Snapshot | None:
        """Rewrites a keyed table's live files as one merged level, which reads without merging."""
        schema, latest = self.schema, self.meta.latest()
        if latest is None or not schema.primary_keys:
            return None
        old = [e for e in self.meta.entries(latest) if e.bucket >= 0]
        # one version of each key is left, so numbers start again; what comes later is numbered after it
        rows = self.merged(old, schema, schema.opts, latest).withColumn(M.SEQUENCE, F.lit(0)).withColumn(M.KIND, F.lit(0).cast("tinyint"))
        message = self.write(rows, level=level)
        message.entries = [replace(e, kind=DELETE) for e in old] + message.entries
        message.index_deleted = self._useless(latest, old)
        return self.commit(message, user=user, kind=COMPACT)

    # deletion vectors

    def _vectors(self, snapshot: Snapshot | None) -> list[dict]:
        return [i for i in self.meta.read_index(snapshot.index) if i["type"] == "dv"] if snapshot and snapshot.index else []

    def delete_rows(self, where: P.Predicate, user: str = "writer") -> int:
        """Marks rows as deleted; files stay as they are. Returns how many rows went. On keyed tables these are rows that a
        compaction has written: what is newer goes by a record that retracts it."""
        schema, latest = self.schema, self.meta.latest()
        if not schema.opts.deletion_vectors:
            raise ValueError("rows can be deleted by position on tables with deletion-vectors.enabled")
        if latest is None:
            return 0
        found = []
        for ident, df in self._positions(self._plan(latest, schema, schema.opts, where).raw):
            found.append(df.select("_file", "_at", *mapped(df, self.schema_of(ident), schema)).filter(where.column()).select("_file", "_at"))
        return self.mark_deleted(reduce(lambda a, b: a.union(b), found), user) if found else 0

    def _positions(self, entries: list[Entry]) -> list[tuple[int, DataFrame]]:
        """Schema id and rows as they are in files, deleted ones too, with _file and _at."""
        out = []
        for ident in sorted({e.file.schema_id for e in entries}):
            struct = T.StructType([T.StructField(f.name, f.dataType) for f in self.schema_of(ident).struct])
            df = self.spark.read.schema(struct).parquet(*(self.uri(e.file.path) for e in entries if e.file.schema_id == ident))
            out.append((ident, df.select("*", self.key_column().alias("_file"), F.col("_metadata.row_index").alias("_at"))))
        return out

    def positions(self) -> DataFrame:
        """(_file, _at) and the columns of the latest rows, for mark_deleted and is_deleted."""
        schema, latest = self.schema, self.meta.latest()
        parts = [df.select("_file", "_at", *mapped(df, self.schema_of(i), schema)) for i, df in self._positions(self._plan(latest, schema, schema.opts).raw)]
        return reduce(lambda a, b: a.union(b), parts)

    def _deleted(self, vectors: list[dict]) -> DataFrame:
        gone = self.spark.read.schema("_file string, _at long").parquet(*(self.uri(v["path"]) for v in vectors))
        return F.broadcast(gone) if sum(sum(v["files"].values()) for v in vectors) <= BROADCAST_ROWS else gone

    def is_deleted(self, positions: DataFrame) -> DataFrame:
        """positions (_file, _at) with is_deleted."""
        known = self._vectors(self.meta.latest())
        if not known:
            return positions.withColumn("is_deleted", F.lit(False))
        return positions.join(self._deleted(known).withColumn("is_deleted", F.lit(True)), ["_file", "_at"], "left").withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))

    def mark_deleted(self, positions: DataFrame, user: str = "writer") -> int:
        """positions: (_file, _at), with or without repeats. Returns how many of these rows weren't deleted before."""
        path, latest = f"index/dv-{uuid.uuid4().hex}", self.meta.latest()
        new = positions.select(F.col("_file").cast("string").alias("_file"), F.col("_at").cast("long").alias("_at")).distinct()
        if known := self._vectors(latest):
            new = new.join(self._deleted(known), ["_file", "_at"], "left_anti")
        new.write.parquet(f"{self.path}/{path}")
        counts = {r["_file"]: r["n"] for r in self.spark.read.schema("_file string, _at long").parquet(f"{self.path}/{path}").groupBy("_file").agg(F.count("*").alias("n")).collect()}  # a row for each file
        paths = {self.key_of(e.file.path): e.file.path for e in self.meta.entries(latest)}
        if stray := set(counts) - set(paths):
            raise ValueError(f"files {sorted(stray)[:3]} are not in the table")
        if counts:
            self.commit(CommitMessage(index_added=[{"type": "dv", "path": path, "files": {paths[f]: n for f, n in counts.items()}}]), user=user, kind=COMPACT)
        return sum(counts.values())

    # indexes

    def index(self, column: str, user: str = "indexer") -> Snapshot:
        """Builds the table-level index of a column anew (O-89a)."""
        from ..plans import indexes

        return indexes.build_global(self, column, user)

    def find(self, where: P.Predicate):
        """The row ids that may match by table-level indexes, for scan(index=...)."""
        from ..plans import indexes

        return indexes.evaluate(self, where)

    # upkeep

    def expire(self, retain_min: int | None = None, retain_max: int | None = None, older_than: float | None = None, limit: int | None = None) -> int:
        """Removes the oldest snapshots beyond what options keep, and the files that only they use. Returns how many went."""
        o, ids = self.schema.opts, self.meta._ids()
        least, most = retain_min or o.retain_min, retain_max or o.retain_max
        if least < 1 or most < least:
            raise ValueError("retain at least 1 snapshot, and no fewer at most than at least")
        cutoff = (now() - 1000 * o.retain_time) if older_than is None else older_than
        gone = []
        for i in ids[: max(0, len(ids) - least)]:
            if len(gone) >= (limit or o.expire_limit):
                break
            if len(ids) - len(gone) > most or self.meta.snapshot(i).millis <= cutoff:
                gone.append(self.meta.snapshot(i))
            else:
                break
        if not gone:
            return 0
        kept = [self.meta.snapshot(i) for i in ids[len(gone):]]
        used = set().union(*(self._files_of(s) for s in kept))
        for s in gone:
            for f in self._files_of(s) - used:
                self.store.delete(self.uri(f), True)
        self.meta.hint("EARLIEST", kept[0].id)
        for s in gone:
            self.store.delete(self.meta.path(s.id))
        return len(gone)

    def _files_of(self, s: Snapshot) -> set[str]:
        """All files that a snapshot needs, data and metadata, below the table or absolute."""
        root = "" if self.branch == "main" else f"branch/branch-{self.branch}/"
        lists = [x for x in (s.base, s.delta) if x]
        manifests = {m["name"] for x in lists for m in self.meta.read_list(x)}
        out = {f"{root}manifest/{n}" for n in (*lists, *manifests, *([s.index] if s.index else []))}
        for n in manifests:
            for e in self.meta.read_manifest(n):
                out.add(e.file.path)
                if e.file.index:
                    out.add(e.file.index)
        return out | {i["path"] for i in self.meta.read_index(s.index)}

    def remove_orphans(self, older_than: float | None = None, retain: Callable[[str], bool] | None = None) -> list[str]:
        """Deletes files that no snapshot of any branch uses and that last changed before `older_than` (milliseconds; a day
        ago if None), unless `retain` says to keep one. Returns what went."""
        cutoff = now() - 86_400_000 if older_than is None else older_than
        names = [n.removeprefix("branch-") for n in self.store.names(f"{self.path}/branch")]
        used: set[str] = set()
        for branch in ("main", *names):
            t = Table(self.spark, self.path, branch)
            used |= set().union(*(t._files_of(s) for s in t.meta.snapshots()), set())
        tables = tuple(u + "/" for u in used)
        out = []
        for f, _, changed in self.store.files(self.path):
            parts = f.split("/")
            if parts[0] == "branch" and len(parts) > 2:
                parts = parts[2:]
            if parts[0] not in ("data", "index", "manifest") or f in used or f.startswith(tables) or changed >= cutoff or retain and retain(f):
                continue
            if self.store.delete(f"{self.path}/{f}"):
                out.append(f)
        return out

    def adopt(self, paths: list[str], partition: tuple = (), move: bool = True, user: str = "writer") -> Snapshot | None:
        """Takes Parquet files that lie elsewhere into an append table without buckets (O-137)."""
        schema = self.schema
        if schema.primary_keys or schema.opts.bucket != UNAWARE:
            raise ValueError("files can be adopted by append tables with bucket -1")
        entries, ids = [], {f.name: f.id for f in schema.fields}
        for path in paths:
            told = footers(self.spark, [self.store.qualified(path)])[0]
            have = {f.name: f.dataType for f in self.spark.read.parquet(path).schema}
            if wrong := [n for n, t in have.items() if n in ids and t != schema.field(n).spark]:
                raise ValueError(f"columns {wrong} of {path} have other types than the table's")
            target = path
            if move:
                target = f"data/adopted-{uuid.uuid4().hex}/{path.rsplit('/', 1)[-1]}"
                self.store.mkdirs(f"{self.path}/{target.rsplit('/', 1)[0]}")
                if not self.store.rename(path, f"{self.path}/{target}"):
                    raise OSError(f"{path} can't be moved")
            size = dict((p, n) for p, n, _ in self.store.files(self.uri(target).rsplit("/", 1)[0]))[target.rsplit("/", 1)[-1]]
            entries.append(Entry(ADD, tuple(partition), 0, DataFile(target, size, told["rows"], schema.id, stats={str(ids[n]): s for n, s in told["stats"].items() if n in ids}, millis=now())))
        return self.commit(CommitMessage(entries), user=user)


def mapped(df: DataFrame, written: TableSchema, current: TableSchema) -> list[Column]:
    """The current schema's columns from a file's, by field id."""
    old = {f.id: f for f in written.fields}
    out = []
    for f in current.fields:
        w = old.get(f.id)
        if w is None or w.name not in df.columns:
            out.append(F.lit(None).cast(f.spark).alias(f.name))
        else:
            out.append(cast(F.col(f"`{w.name}`"), w.spark, f.spark).alias(f.name))
    return out
