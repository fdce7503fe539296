"""Large objects by reference (O-71, O-78): a descriptor names a stretch of a file, and is read where the bytes are needed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESCRIPTOR = T.StructType([T.StructField("uri", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


def descriptor(uri: Column, offset: Column | int = 0, length: Column | int = -1) -> Column:
    """A reference to bytes; a length of -1 is the rest of the file."""
    at = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.when(uri.isNotNull(), F.struct(uri.alias("uri"), at(offset).alias("offset"), at(length).alias("length")))


def fetched(df: DataFrame, column: str) -> DataFrame:
    """The descriptors of a column replaced by their bytes, read by executors; null stays null."""
    kind = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in df.schema])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d in b.column(column).to_pylist():
                if d is None:
                    out.append(None)
                    continue
                system, path = pafs.FileSystem.from_uri(d["uri"])
                with system.open_input_file(path) as f:
                    f.seek(d["offset"])
                    data = f.read() if d["length"] < 0 else f.read(d["length"])
                if d["length"] >= 0 and len(data) != d["length"]:
                    raise ValueError(f"{d['uri']} ends before {d['offset']} + {d['length']}")
                out.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == column else b.column(n) for n in b.schema.names], names=b.schema.names)

    return df.mapInArrow(read, kind)
