"""What a Parquet file's footer tells about it (O-155, O-164)."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files whose footers the driver reads itself; more are read by executors.
FEW = 32


def footer(uri: str) -> dict:
    """Rows and, by column, [least, greatest, nulls] where the footer has them. Nested columns and time zones are left out."""
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
    stats: dict[str, list] = {}
    for i in range(meta.num_columns):
        name = meta.row_group(0).column(i).path_in_schema if meta.num_row_groups else None
        if name is None or "." in name:
            continue
        least, greatest, nulls, known, sized = None, None, 0, True, True
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(i).statistics
            n = s.null_count if s is not None and s.has_null_count else None
            nulls = None if n is None or nulls is None else nulls + n
            if s is not None and s.has_min_max and not (isinstance(s.min, dt.datetime) and s.min.tzinfo):
                least = s.min if least is None else min(least, s.min)
                greatest = s.max if greatest is None else max(greatest, s.max)
            elif n is None or n < meta.row_group(g).num_rows:
                known = False
        stats[name] = [least if known else None, greatest if known else None, nulls if sized else None]
    return {"rows": meta.num_rows, "stats": stats}


def footers(spark: SparkSession, uris: list[str]) -> list[dict]:
    """footer() of each file; for other formats, and where the file system is unknown to this library, Spark counts."""
    import pickle

    if any(u.endswith(".orc") for u in uris):
        return counted(spark, uris)
    try:
        if len(uris) <= FEW:
            return [footer(u) for u in uris]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pickle.dumps(footer(u)) for u in b.column(1).to_pylist()], pa.binary())], names=["i", "f"])

        rows = spark.createDataFrame(list(enumerate(uris)), "i long, uri string").repartition(min(len(uris), 1000)).mapInArrow(read, "i long, f binary").collect()
        return [pickle.loads(r["f"]) for r in sorted(rows, key=lambda r: r["i"])]
    except (pa.ArrowInvalid, OSError):
        return counted(spark, uris)


def counted(spark: SparkSession, uris: list[str]) -> list[dict]:
    """The same by reading the files, all in one job with a row for each file."""
    bare = lambda u: re.sub("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*", "", u)
    df = spark.read.format("orc" if uris[0].endswith(".orc") else "parquet").load(uris)
    plain = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampNTZType, T.BooleanType))]
    # Least and greatest strings alone would have Spark sort all rows by file; next to a list, here an empty one, it hashes.
    hashed = F.collect_list(F.lit(None).cast("int")).alias("_none")
    stats = (x.alias(f"_{k}{i}") for i, c in enumerate(plain) for k, x in (("a", F.min(f"`{c}`")), ("z", F.max(f"`{c}`")), ("n", F.count_if(F.col(f"`{c}`").isNull()))))
    told = df.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count("*").alias("_rows"), *stats, hashed)
    told = told.withColumn("_path", F.url_decode(F.replace(F.col("_path"), F.lit("+"), F.lit("%2B"))))
    of = {bare(r["_path"]): {"rows": r["_rows"], "stats": {c: [r[f"_a{i}"], r[f"_z{i}"], r[f"_n{i}"]] for i, c in enumerate(plain)}} for r in told.collect()}
    return [of.get(bare(u), {"rows": 0, "stats": {}}) for u in uris]
