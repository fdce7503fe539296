"""File indexes and table-level indexes (O-82 to O-89).

An index is a Parquet table: (file, column, value) for files, (value, row id) for tables. A look-up is a filter that
reaches the scan, so no index is ever loaded whole, and a value that most rows share is many rows, not one long list.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from . import ranges as R

#: Files whose row-id ranges are broadcast; more are joined by a shuffle.
FEW_FILES = 100_000


def build_bitmaps(table, entries: list, columns: list[str]) -> list:
    """Writes which values each new file has in the indexed columns. A task has a range of values: a column may have as many
    as there are rows."""
    if not columns:
        return entries
    path = f"index/bitmap-{uuid.uuid4().hex}"
    schema = table.schema
    df = table.spark.read.schema(schema.struct).parquet(*(table.uri(e.file.path) for e in entries)).select("*", table.key_column().alias("_file"))
    pairs = F.explode(F.array(*(F.struct(F.lit(str(schema.field(c).id)).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    df.select("_file", pairs).select("_file", "p.*").distinct().repartitionByRange("column", "value", "_file").sortWithinPartitions("column", "value").write.parquet(f"{table.path}/{path}")
    return [replace(e, file=replace(e.file, index=path)) for e in entries]


def readable(kind: T.DataType) -> bool:
    """Whether the text of a value in an index is the value."""
    return isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.DecimalType, T.DoubleType, T.FloatType))


def leaves(p: P.Predicate) -> list[P.Leaf]:
    return [p] if isinstance(p, P.Leaf) else [x for c in p.children for x in leaves(c)]


def skipped(table, entries: list, where: P.Predicate, schema) -> set[str]:
    """Paths of files that the value indexes rule out (O-82, O-83, O-86, O-87).

    A file can match a condition on an indexed column if one of its distinct values does, whatever the condition; AND and
    OR combine these answers, and conditions without an index may always match. One Spark job answers for all indexes and
    conditions, with a row for each file."""
    by_index: dict[str, list] = {}
    for e in entries:
        if e.file.index:
            by_index.setdefault(e.file.index, []).append(e)
    asked = list(dict.fromkeys(x for x in leaves(where) if x.field not in schema.partition_keys and readable(schema.field(x.field).spark)))
    if not by_index or not asked:
        return set()
    usable: dict[str, set[int]] = {}  # by index: conditions that it can answer
    for path, es in by_index.items():
        written = table.schema_of(es[0].file.schema_id)
        own = {f.id: f for f in written.fields if f.name in written.opts.bitmap_columns}
        usable[path] = {i for i, x in enumerate(asked) if (f := own.get(schema.field(x.field).id)) is not None and f.type == schema.field(x.field).type}
    paths = [p for p, some in usable.items() if some]
    if not paths:
        return set()
    rows = table.spark.read.schema("_file string, column string, value string").parquet(*map(table.uri, paths))
    hits = []
    for i, x in enumerate(asked):
        f = schema.field(x.field)
        of = rows.select("*", F.when(F.col("column") == str(f.id), F.col("value").cast(f.spark)).alias("_v"), (F.col("column") == str(f.id)).alias("_own"))
        hits.append(of.filter("_own").filter(P.Leaf(x.function, "_v", x.literals).column()).select("_file", F.lit(i).alias("i")))
    found: dict[str, set[int]] = {}
    for r in reduce(lambda a, b: a.union(b), hits).groupBy("_file").agg(F.collect_set("i").alias("hit")).collect():  # a row for each file, with as many numbers as conditions
        found[r["_file"]] = set(r["hit"])

    def may(p: P.Predicate, path: str, hit: set[int]) -> bool:
        if isinstance(p, P.Leaf):
            i = asked.index(p) if p in asked else -1
            return i not in usable[path] or i in hit
        answers = (may(c, path, hit) for c in p.children)
        return all(answers) if isinstance(p, P.And) else any(answers)

    return {e.file.path for path in paths for e in by_index[path] if not may(where, path, found.get(table.key_of(e.file.path), set()))}


@dataclass
class IndexResult:
    """Rows that an index finds, by id; None: it has no answer, all rows may match. `ranges` is what files are pruned by."""

    ids: DataFrame | None
    ranges: list[R.Range] | None = None
    scored: bool = False

    def applied(self, df: DataFrame) -> DataFrame:
        if self.ids is None:
            return df
        return df.join(self.ids, "_ROW_ID", "inner" if self.scored else "left_semi")

    def both(self, other: IndexResult) -> IndexResult:
        if self.ids is None or other.ids is None:
            return other if self.ids is None else self
        kept, less = (self, other) if self.scored else (other, self)
        return IndexResult(kept.ids.join(less.ids.select("_ROW_ID"), "_ROW_ID", "left_semi"), scored=kept.scored)

    def either(self, other: IndexResult) -> IndexResult:
        if self.ids is None or other.ids is None:
            return IndexResult(None)
        return IndexResult(self.ids.select("_ROW_ID").union(other.ids.select("_ROW_ID")).distinct())


def build_global(table, column: str, user: str = "indexer"):
    """Indexes a column of a table with row tracking: (value, row id), sorted by value, over all rows it has now (O-89a, b)."""
    from ..sources.table import CommitMessage

    schema, latest = table.schema, table.meta.latest()
    if not schema.opts.row_tracking or latest is None:
        raise ValueError("a table-level index needs row tracking and rows")
    path = f"index/global-{uuid.uuid4().hex}"
    rows = table.scan(columns=[column, "_ROW_ID"])
    rows.select(F.col(column).alias("value"), "_ROW_ID").repartitionByRange("value", "_ROW_ID").sortWithinPartitions("value", "_ROW_ID").write.parquet(f"{table.path}/{path}")
    known = [i["path"] for i in table.meta.read_index(latest.index) if i["type"] == "global" and i["field"] == schema.field(column).id]
    entry = {"type": "global", "field": schema.field(column).id, "path": path, "files": {}, "range": [0, (latest.next_row_id or 1) - 1]}
    return table.commit(CommitMessage(index_added=[entry], index_deleted=known), user=user, kind="ANALYZE")


def evaluate(table, where: P.Predicate) -> IndexResult:
    """The rows that may match by the table-level indexes (O-89d to f, h). AND ignores children without an index; OR with
    one such child has no answer; rows that came after an index was built are always in."""
    schema, latest = table.schema, table.meta.latest()
    known = {i["field"]: i for i in (table.meta.read_index(latest.index) if latest else []) if i["type"] == "global"} if schema.opts.global_index else {}
    covered = [i["range"] for i in known.values()]
    if len({tuple(c) for c in covered}) > 1:
        covered = [[0, min(c[1] for c in covered)]]

    def walk(p: P.Predicate) -> IndexResult:
        if isinstance(p, P.Leaf):
            i = known.get(schema.field(p.field).id)
            if i is None:
                return IndexResult(None)
            rows = table.spark.read.parquet(table.uri(i["path"]))
            return IndexResult(rows.filter(P.Leaf(p.function, "value", p.literals).column()).select("_ROW_ID"))
        parts = [walk(c) for c in p.children]
        out = parts[0]
        for x in parts[1:]:
            out = out.both(x) if isinstance(p, P.And) else out.either(x)
        return out

    out = walk(where)
    if out.ids is None:
        return out
    last, end = covered[0][1], (latest.next_row_id or 0) - 1
    if end > last:  # the tail without an index
        tail = table.spark.range(last + 1, end + 1).withColumnRenamed("id", "_ROW_ID")
        out = IndexResult(out.ids.filter(F.col("_ROW_ID") <= last).union(tail))
    out.ranges = hit_ranges(table, out.ids, latest)
    return out


def hit_ranges(table, ids: DataFrame, latest) -> list[R.Range]:
    """The row-id ranges of files that hold one of the ids: a join by bins of row ids, and at most a row for each file."""
    files = sorted({(e.file.first_row_id, e.file.last_row_id) for e in table.meta.entries(latest) if e.file.first_row_id is not None})
    bin_of = lambda c: F.shiftright(c, 20)
    spans = table.spark.createDataFrame(files, "_first long, _last long").withColumn("_bin", F.explode(F.sequence(bin_of("_first"), bin_of("_last"))))
    hit = ids.select("_ROW_ID", bin_of("_ROW_ID").alias("_bin")).join(F.broadcast(spans) if len(files) <= FEW_FILES else spans, "_bin").filter(F.col("_ROW_ID").between(F.col("_first"), F.col("_last")))
    return R.merge(tuple(r) for r in hit.select("_first", "_last").distinct().collect())
