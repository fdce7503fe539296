"""Token counts by a separator scan over flat token files.

A flat file is nothing but ids, one after the other, each document closed by the end-of-document id; no index says where
documents lie. Files are cut into blocks by size alone. Each block is searched for the end id in one vectorised pass, by
itself, and a prefix scan over the blocks' summaries (how many ends, where the last one was) gives every document its
number and the part of it that lies in blocks before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import qualified, stored, table, work_dir
from .files import byte_level, opened, publish, read, width

#: Ids in a block that is searched at once; ids that a writing task holds before it closes a file.
BLOCK, PER_FILE = 2_000_000, 64_000_000


def write_flat(df: DataFrame, folder: str, encoder: tuple, vocabulary: int, end: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes every text's ids and the end id to flat files. Returns (file, _doc, _id): the order of documents in each file.

    A null text counts as empty. A task writes files of PER_FILE ids or so, named after its partition and the file's
    number in it, so that a repeated task writes the same files again."""
    folder, kind = qualified(df.sparkSession, folder), width(vocabulary)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, own = TaskContext.get().partitionId(), 0, byte_level(*encoder)
        idents: list = []
        held: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            name = f"flat-{part:06d}-{number:04d}.bin"
            publish(f"{folder}/{name}", held)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(idents)), pa.array(range(len(idents)), pa.int64()), pa.array(idents, pa.int64())], names=["file", "_doc", "_id"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.array([*own.encode(t.as_py()), end], kind)
                idents.append(i)
                held.append(x.tobytes())
                size += len(x)
                if size >= PER_FILE:
                    yield done()
                    idents, held, size, number = [], [], 0, number + 1
        if idents:
            yield done()

    return stored(df.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(save, "file string, _doc long, _id long"), "flat-order")


def listed(folder: str) -> list[tuple[str, int]]:
    """Names and sizes in bytes of a folder's flat files."""
    from pyarrow import fs as pafs

    fs, path = opened(folder)
    return sorted((f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".bin"))


def scan(spark: SparkSession, folder: str, vocabulary: int, end: int, block: int = BLOCK) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed) for every document in a folder of flat files: its number in its file, where
    its first id is, and how many ids it has with its end id. Ids after the last end id are a document that isn't closed.
    Empty files have no documents."""
    folder, kind = qualified(spark, folder), width(vocabulary)
    files = [(name, n // kind.itemsize) for name, n in listed(folder) if n >= kind.itemsize]
    n_blocks = sum(-(-n // block) for _, n in files)
    rows = spark.createDataFrame(files, "file string, ids long")  # a row for each file
    todo = rows.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(block).cast("long"))).alias("at"), "ids")
    todo = todo.select("file", "at", F.least(F.lit(block), F.col("ids") - F.col("at")).cast("long").alias("size")).coalesce(1).repartition(max(1, min(n_blocks, 10_000)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(read(f"{folder}/{r['file']}", r["at"] * kind.itemsize, r["size"] * kind.itemsize), kind)
                ends = np.flatnonzero(ids == end) + r["at"] + 1
                n = max(1, len(ends))  # a block without an end still has a row
                gaps = np.diff(ends).tolist()
                first = np.arange(n) == 0
                cols = [pa.array([r["file"]] * n), pa.array([r["at"]] * n, pa.int64()), pa.array([r["size"]] * n, pa.int64()), pa.array(np.arange(n), pa.int64()),
                        pa.array(ends if len(ends) else [None], pa.int64()), pa.array([None, *gaps], pa.int64()), pa.array([len(ends) if f else None for f in first], pa.int64()),
                        pa.array([int(ends[-1]) if f and len(ends) else None for f in first], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "at", "size", "k", "end", "gap", "n_ends", "last_end"])

    found = stored(todo.mapInArrow(search, "file string, at long, size long, k long, end long, gap long, n_ends long, last_end long"), "ends")
    # the prefix scan, over one row for each block
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.filter("k = 0").select("file", "at", "size", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("_docs"), F.coalesce(F.max("last_end").over(before), F.lit(0)).alias("_from"))
    docs = found.filter("end is not null").drop("size").join(scanned.drop("size"), ["file", "at"])
    size = F.coalesce("gap", F.col("end") - F.col("_from"))
    closed = docs.select("file", (F.col("_docs") + F.col("k")).alias("doc_no"), (F.col("end") - size).alias("start"), size.alias("n_tokens"), F.lit(True).alias("closed"))
    whole = found.filter("k = 0").groupBy("file").agg(F.sum("size").alias("_ids"), F.sum("n_ends").alias("doc_no"), F.coalesce(F.max("last_end"), F.lit(0)).alias("start"))
    open_ = whole.filter("start < _ids").select("file", "doc_no", "start", (F.col("_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat files of their ids."""
    import public_tokenizers as P

    folder, end = work_dir(spark, "flat"), 50256
    order = write_flat(table(spark, sf_dir, "documents"), folder, (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {}), 50257, end)  # the end id's name in a text is ordinary text
    counts = scan(spark, folder, 50257, end)
    out = counts.join(order, (counts.file == order.file) & (counts.doc_no == order["_doc"]))
    return out.select(F.col("_id").alias("doc_id"), counts.file, "doc_no", "start", "n_tokens", "closed")
