"""A Structured Streaming source over a table's snapshots (O-16): `spark.readStream.format("tidelake").load(path)`.

The offset is the next snapshot's id, so a checkpointed query goes on where it stopped. Partitions are the data files of
APPEND snapshots; executors read them as Arrow batches. Rows come unmerged, with `_VALUE_KIND` first. Planning runs
outside the driver's JVM, so metadata is read through Arrow's file systems. Register with `spark.dataSource.register`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.metadata import ADD, APPEND, Metadata
from ..plans.schema import TableSchema

KIND = "_VALUE_KIND"


class ArrowStore:
    """The reading half of plans.store.Store."""

    def __init__(self, root: str):
        self.fs, _ = pafs.FileSystem.from_uri(root)

    def _path(self, uri: str) -> str:
        return pafs.FileSystem.from_uri(uri)[1]

    def exists(self, uri: str) -> bool:
        return self.fs.get_file_info(self._path(uri)).type != pafs.FileType.NotFound

    def names(self, uri: str) -> list[str]:
        return sorted(f.base_name for f in self.fs.get_file_info(pafs.FileSelector(self._path(uri), allow_not_found=True)))

    def read(self, uri: str) -> str:
        with self.fs.open_input_stream(self._path(uri)) as f:
            return f.read().decode()


def absolute(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


@dataclass
class FilePart(InputPartition):
    uri: str
    names: tuple  # of the file's columns in the order of the schema; None: the file hasn't the column


class Source(DataSource):
    """Options: path, and startingSnapshot (default: the earliest)."""

    @classmethod
    def name(cls) -> str:
        return "tidelake"

    def _root(self) -> str:
        return absolute(self.options["path"]).rstrip("/")

    def _schema(self) -> TableSchema:
        store, root = ArrowStore(self._root()), self._root()
        last = max(int(n[7:]) for n in store.names(f"{root}/schema") if n.startswith("schema-"))
        return TableSchema.from_json(store.read(f"{root}/schema/schema-{last}"))

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(KIND, T.ByteType()), *(T.StructField(f.name, f.dataType) for f in self._schema().struct)])

    def streamReader(self, schema: T.StructType) -> Reader:
        return Reader(self._root(), self._schema(), self.options.get("startingSnapshot") or self.options.get("startingsnapshot"))


class Reader(DataSourceStreamReader):
    def __init__(self, root: str, schema: TableSchema, start: str | None):
        self.root, self.table_schema, self.start = root, schema, start

    def _meta(self) -> Metadata:
        return Metadata(ArrowStore(self.root), self.root)

    def initialOffset(self) -> dict:
        meta = self._meta()
        return {"next": max(int(self.start or 1), meta.earliest_id() or 1)}

    def latestOffset(self) -> dict:
        return {"next": (self._meta().latest_id() or 0) + 1}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        meta, store, out = self._meta(), ArrowStore(self.root), []
        for ident in range(start["next"], end["next"]):
            if not meta.exists(ident):
                raise ValueError(f"snapshot {ident} has expired")
            s = meta.snapshot(ident)
            if s.kind != APPEND:
                continue
            for e in meta.entries(s, delta_only=True):
                if e.kind != ADD or e.file.write_cols is not None:
                    continue
                written = {f.id: f for f in TableSchema.from_json(store.read(f"{self.root}/schema/schema-{e.file.schema_id}")).fields}
                names = []
                for f in self.table_schema.fields:
                    w = written.get(f.id)
                    if w is not None and w.type != f.type:
                        raise NotImplementedError(f"a stream over files in which {f.name} was {w.type}")
                    names.append(w.name if w else None)
                out.append(FilePart(e.file.path if "://" in e.file.path else f"{self.root}/{e.file.path}", tuple(names)))
        return out

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(partition.uri)
        want = [(f.name, n) for f, n in zip(self.table_schema.fields, partition.names, strict=True)]
        with system.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            have = file.schema_arrow.names
            for b in file.iter_batches(columns=[n for _, n in want if n] + ([KIND] if KIND in have else [])):
                kinds = b.column(KIND) if KIND in have else pa.array([0] * len(b), pa.int8())
                yield pa.RecordBatch.from_arrays([kinds, *(b.column(n) if n else pa.nulls(len(b)) for _, n in want)], names=[KIND, *(name for name, _ in want)])

    def commit(self, end: dict) -> None:
        pass
