"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

All texts are encoded once and their ids kept in a table; the ids are counted (a row for each id of the vocabulary at most
reaches the driver), package-merge gives code lengths of 16 bits at most (for more than 16,384 ids in use, two bits more than
it takes to number them), and lengths alone fix the canonical codes. Each
file holds a range of documents in ascending order. Its bits are cut into blocks that can be decoded by themselves; a
checkpoint holds the bit at which each block begins. Decoding takes a table of all 2^16 prefixes, and a second one, which is
searched, for codes that are longer; it goes through all of a file's blocks side by side, one id of each at a time.

File: magic, header length, header (JSON: counts and section sizes), code lengths by id (zlib), bits (32-bit words, big
endian, each document from a new word), documents' idents, numbers of ids, blocks' checkpoints (64-bit little endian).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import qualified, stored, table, work_dir
from .files import byte_level, publish, read, special_tokens, width

MAGIC, NO_IDENT = b"TLHUFF1\n", -(1 << 63)
#: Longest code; ids in a block; ids in a file, about.
LIMIT, BLOCK, PER_FILE = 16, 512, 16_000_000
#: Ranges of idents that files are dealt by; a range's task writes as many files as it needs, one after the other.
MOST_RANGES = 10_000
#: Documents after which a file may be closed.
TOGETHER = 256


def longest(used: int) -> int:
    """The most bits of a code for so many ids."""
    return max(LIMIT, (max(used, 2) - 1).bit_length() + 2)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that don't occur. One id alone gets 1 bit."""
    own = np.flatnonzero(counts)
    limit = longest(len(own)) if limit is None else limit
    out = np.zeros(len(counts), np.uint8)
    if len(own) < 2:
        out[own] = 1
        return out
    own = own[np.argsort(counts[own], kind="stable")]
    weight = counts[own].astype(np.float64)
    coins = [weight]  # by level: packages of two of the level below, merged with the ids themselves
    is_id = [np.ones(len(own), bool)]
    for _ in range(limit - 1):
        last = coins[-1]
        packed = last[: len(last) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weight, packed])
        order = np.argsort(merged, kind="stable")
        coins.append(merged[order])
        is_id.append(order < len(own))
    take, length = 2 * len(own) - 2, np.zeros(len(own), np.int64)
    for ids in reversed(is_id):
        n = int(ids[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[own] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in np.unique(lengths[order]):
        own = order[lengths[order] == n]
        code <<= int(n) - last
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), int(n)
    return codes


def decoding_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For each value of the next LIMIT bits: the id and how many bits it takes, 0 if its code is longer. For longer codes:
    their first values, ascending, in as many bits as the longest code has, and their ids; and that number of bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    most = max(LIMIT, int(lengths.max(initial=0)))
    short, long = order[lengths[order] <= LIMIT], order[lengths[order] > LIMIT]
    span = 1 << (LIMIT - lengths[short].astype(np.int64))
    n = int(span.sum())
    ids, bits = np.zeros(1 << LIMIT, np.uint32), np.full(1 << LIMIT, 0 if len(long) else 1, np.uint8)
    ids[:n], bits[:n] = np.repeat(short, span), np.repeat(lengths[short], span)
    firsts = canonical(lengths)[long].astype(np.int64) << (most - lengths[long].astype(np.int64))
    return ids, bits, firsts, long.astype(np.uint32), most


def packed(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each of some documents, one after the other in `ids`: its words of bits, and the bits at which its blocks begin."""
    bits = lengths[ids].astype(np.int64)
    if len(ids) and not bits.all():
        raise ValueError("an id without a code")
    ends = np.concatenate([[0], np.cumsum(bits)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = -(-(ends[first[1:]] - ends[first[:-1]]) // 32)
    base = np.concatenate([[0], np.cumsum(words)])
    at = ends[:-1] + np.repeat(base[:-1] * 32 - ends[first[:-1]], sizes)
    word, shift = at >> 5, (64 - bits - (at & 31)).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << shift
    out = np.zeros(int(base[-1]) + 1, np.uint64)
    if len(ids):
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[new]] += np.add.reduceat(value >> np.uint64(32), new)
        out[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    raw = out[:-1].astype(">u4").tobytes()
    pieces = [raw[4 * a:4 * b] for a, b in zip(base[:-1], base[1:], strict=True)]
    marks = [(at[a:b:BLOCK] - 32 * w).astype("<i8").tobytes() for a, b, w in zip(first[:-1], first[1:], base[:-1], strict=True)]
    return pieces, marks


def unpacked(raw: bytes, starts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All ids of blocks of bits that begin at `starts` and hold `sizes` ids."""
    ids, bits, firsts, long, most = decoding_tables(lengths)
    words = np.concatenate([np.frombuffer(raw, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    out = np.zeros(int(sizes.sum()), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    to, at, size = (np.cumsum(sizes) - sizes)[order], starts[order].astype(np.int64), sizes[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))  # blocks with more than k ids
        w, p = at[:n] >> 5, (at[:n] & 31).astype(np.uint64)
        window = ((words[w] << np.uint64(32) | words[w + 1]) >> (np.uint64(64 - most) - p)) & np.uint64((1 << most) - 1)
        window = window.astype(np.int64)
        head = window >> (most - LIMIT)
        own, took = ids[head], bits[head].astype(np.int64)
        if len(long) and (more := np.flatnonzero(took == 0)).size:
            own[more] = long[np.searchsorted(firsts, window[more], "right") - 1]
            took[more] = lengths[own[more]]
        out[to[:n] + k] = own
        at[:n] += took
    return out


def write_file(uri: str, idents: np.ndarray, sizes: np.ndarray, pieces: list[bytes], marks: list[bytes], lengths: np.ndarray) -> None:
    base = np.concatenate([[0], np.cumsum([len(p) * 8 for p in pieces])])[:-1].astype(np.int64)
    blocks = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(m, "<i8") + b for m, b in zip(marks, base, strict=True))])
    parts = [zlib.compress(lengths.tobytes(), 6), b"".join(pieces), idents.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), blocks.astype("<i8").tobytes()]
    head = json.dumps({"docs": len(idents), "ids": int(sizes.sum()), "block": BLOCK, "limit": int(lengths.max(initial=0)), "parts": [len(p) for p in parts]}).encode()
    publish(uri, [MAGIC, len(head).to_bytes(4, "little"), head, *parts])


def read_file(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Idents, numbers of ids and all ids of a file."""
    raw = read(uri)
    if raw[:8] != MAGIC:
        raise ValueError(f"{uri} is no token file")
    n = int.from_bytes(raw[8:12], "little")
    head = json.loads(raw[12:12 + n])
    cut = 12 + n + np.concatenate([[0], np.cumsum(head["parts"])])
    part = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    idents, sizes, blocks = np.frombuffer(part[2], "<i8"), np.frombuffer(part[3], "<u4").astype(np.int64), np.frombuffer(part[4], "<i8")
    per = -(-sizes // head["block"])
    full = np.full(len(blocks), head["block"], np.int64)
    last = np.cumsum(per) - 1
    full[last[per > 0]] = (sizes - (per - 1) * head["block"])[per > 0]
    return idents, sizes, unpacked(part[1], blocks, full, np.frombuffer(zlib.decompress(part[0]), np.uint8))


def ids_table(df: DataFrame, encoder: tuple, vocabulary: int, end: int, ident: str, text: str) -> DataFrame:
    """(_id, _n, _ids): every text's ids and the end id, kept as a table in the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = byte_level(*encoder), width(vocabulary)
        for b in batches:
            for at in range(0, len(b), 256):
                ids = [np.array([*own.encode(t), end], kind) for t in b.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["_id", "_n", "_ids"])

    return stored(df.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(encode, "_id long, _n long, _ids binary"), "ids")


def id_counts(rows: DataFrame, vocabulary: int) -> np.ndarray:
    kind = width(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=vocabulary)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in rows.select("_ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # vocabulary rows at most
        out[r["id"]] = r["n"]
    return out


def write(df: DataFrame, folder: str, encoder: tuple, vocabulary: int, end: int = 0, ident: str = "doc_id", text: str = "text", per_file: int = PER_FILE) -> DataFrame:
    """Writes all texts' ids to files in ascending order of ident, each text followed by the end id. Returns the list of files
    as a table: range, part, uri, docs, ids, first (ids in all files before). A null text counts as empty and holds the end
    id alone; rows without an ident come first; rows with one ident stand together, ordered by number and codes of their
    ids. Other columns are left out, whatever their names. No rows, no files.

    Documents are dealt by ranges of ident (approximate quantiles), sorted within each, and a file is closed once it holds
    per_file ids, so that a task holds no more than that."""
    folder = qualified(df.sparkSession, folder)
    rows = ids_table(df, encoder, vocabulary, end, ident, text)
    key = F.coalesce("_id", F.lit(NO_IDENT))
    total = rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    lengths = code_lengths(id_counts(rows, vocabulary))
    ranges = min(MOST_RANGES, max(1, -(-total // per_file)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), 100 * ranges)).first()[0])) if shares else []
    kind, step = width(vocabulary), TOGETHER

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, at = canonical(lengths), np.array(bounds, np.int64)
        for b in batches:
            for i in range(0, len(b), 512):
                p = b.slice(i, 512)
                pieces, marks = packed(np.frombuffer(b"".join(p.column("_ids").to_pylist()), kind), p.column("_n").to_numpy(), lengths, codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(at, p.column("_id").to_numpy(), "left"), pa.int32()), p.column("_id"), p.column("_n"), pa.array(pieces, pa.binary()), pa.array(marks, pa.binary())], names=["range", "_id", "_n", "_bits", "_marks"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, part, size = -1, 0, 0

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            uri, sizes = f"{folder}/tokens-{now:05d}-{part:05d}.tlh", t.column("_n").to_numpy()
            write_file(uri, t.column("_id").to_numpy(), sizes, t.column("_bits").to_pylist(), t.column("_marks").to_pylist(), lengths)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([uri]), pa.array([t.num_rows], pa.int64()), pa.array([size], pa.int64())], names=["range", "part", "uri", "docs", "ids"])

        for whole in batches:
            for i in range(0, len(whole), step):
                b = whole.slice(i, step)
                own = b.column("range").to_numpy()
                cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1), len(own)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and (now != own[a] or size >= per_file):
                        yield done()
                        part = part + 1 if now == own[a] else 0
                        held, size = [], 0
                    now = int(own[a])
                    held.append(b.slice(a, z - a))
                    size += int(held[-1].column("_n").to_numpy().sum())
        if held:
            yield done()

    coded = rows.select(key.alias("_id"), "_n", "_ids").mapInArrow(pack, "range int, _id long, _n long, _bits binary, _marks binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "_id", "_n", F.xxhash64("_bits"))
    files = stored(dealt.mapInArrow(save, "range int, part int, uri string, docs long, ids long"), "token-files")
    # ids before a file: those of the ranges before (MOST_RANGES rows), and of its range's files before
    ahead = files.groupBy("range").agg(F.sum("ids").alias("_ids")).select("range", (F.sum("_ids").over(Window.orderBy("range")) - F.col("_ids")).alias("_ahead"))
    own = F.sum("ids").over(Window.partitionBy("range").orderBy("part")) - F.col("ids")
    return files.withColumn("_own", own).join(ahead, "range").withColumn("first", F.col("_own") + F.col("_ahead")).drop("_own", "_ahead")


def documents(files: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Reads files back: (ident, start, n_tokens, ids_crc32) of each document."""
    files = stored(files.select("uri", "first"), "token-files")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column("uri").to_pylist(), b.column("first").to_pylist(), strict=True):
                idents, sizes, ids = read_file(uri)
                at, raw = np.concatenate([[0], np.cumsum(sizes)]), memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                none = idents == NO_IDENT
                yield pa.RecordBatch.from_arrays([pa.array(idents, pa.int64(), mask=none), pa.array(first + at[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=[ident, "start", "n_tokens", "ids_crc32"])

    return files.coalesce(1).repartition(max(1, min(files.count(), MOST_RANGES))).mapInArrow(decode, f"{ident} long, start long, n_tokens long, ids_crc32 long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids through files and back."""
    import public_tokenizers as P

    special = special_tokens(P.path("byte_bpe_50k.json"))
    encoder = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, special)
    files = write(table(spark, sf_dir, "documents"), work_dir(spark, "tokens"), encoder, max(special.values()) + 1)
    return documents(files)
