"""Media columns: what bytes really are, and what else lies in them.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over the bytes. Each find is a proposal;
a format's validator reads the structure from there on, confirms it and says where the media ends. A find at the start
gives the type, whatever was declared; finds inside are carved. Payloads are stored as 8-bit samples of a RIFF/WAVE file.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored as kept
from .common import table

#: Samples a second and the unit that payloads are padded to.
RATE, UNIT = 8000, 64


def wave(payload: bytes) -> bytes:
    """A RIFF/WAVE file of one channel of 8-bit samples that are the payload's bytes."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + pad


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes' number, and these bytes with zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (UNIT - len(raw) if len(raw) < UNIT else -len(raw) % UNIT)


# Validators: (bytes, where the media begins) -> (where it ends, facts), or None if the structure doesn't hold.


def _wave(b: bytes, at: int):
    if len(b) - at < 12 or b[at + 8:at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4:at + 8], "little")
    facts, p = {}, at + 12
    if end > len(b):
        return None
    while p + 8 <= end:
        name, n = b[p:p + 4], int.from_bytes(b[p + 4:p + 8], "little")
        if p + 8 + n > end:
            return None
        if name == b"fmt " and n >= 16:
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", b, p + 8)
            if not channels or not rate or not bits or align != channels * -(-bits // 8):
                return None
            facts |= {"format": kind, "channels": channels, "rate": rate, "bits": bits, "align": align}
        elif name == b"data" and "rate" in facts:
            facts |= {"data": (p + 8, n), "samples": n // facts["align"]}
        p += 8 + n + n % 2
    return (end, facts) if "samples" in facts else None


def _png(b: bytes, at: int):
    p, facts = at + 8, {}
    while p + 12 <= len(b):
        n, name = int.from_bytes(b[p:p + 4], "big"), b[p + 4:p + 8]
        if p + 12 + n > len(b) or not facts and name != b"IHDR" or zlib.crc32(b[p + 4:p + 8 + n]) != int.from_bytes(b[p + 8 + n:p + 12 + n], "big"):
            return None
        if name == b"IHDR":
            if n != 13:
                return None
            facts = dict(zip(("width", "height", "bits"), struct.unpack_from(">IIB", b, p + 8), strict=True))
        p += 12 + n
        if name == b"IEND":
            return p, facts
    return None


def _gif(b: bytes, at: int):
    if b[at:at + 6] not in (b"GIF87a", b"GIF89a") or len(b) < at + 13:
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    frames = 0

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return (p + 1, {"width": width, "height": height, "frames": frames}) if width and height else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
            frames += 1
        else:
            return None
    return None


def _jpeg(b: bytes, at: int):
    p, facts = at + 2, {}
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], int.from_bytes(b[p + 2:p + 4], "big")
        if mark == 0xFF:
            p += 1
            continue
        if n < 2 or p + 2 + n > len(b):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and n >= 8:
            facts = dict(zip(("height", "width"), struct.unpack_from(">HH", b, p + 5), strict=True))
        p += 2 + n
        if mark == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
            if b[p + 1:p + 2] == b"\xd9":
                return (p + 2, facts) if facts else None
    return None


def _bmp(b: bytes, at: int):
    if len(b) - at < 54:
        return None
    size, zero, first, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or head not in (40, 108, 124) or not 54 <= first <= size <= len(b) - at or width <= 0 or not height:
        return None
    return at + size, {"width": width, "height": abs(height), "bits": bits}


def _gzip(b: bytes, at: int):
    if b[at + 2:at + 3] != b"\x08" or len(b) - at < 18 or b[at + 3] & 0xE0:
        return None
    own, n, view, p = zlib.decompressobj(31), 0, memoryview(b), at
    try:
        while p < len(b) and not own.eof:  # piece by piece, so that what only looks like a start costs little
            left = view[p:p + (1 << 16)]
            p += len(left)
            while left and not own.eof:
                n += len(own.decompress(left, 1 << 20))
                left = own.unconsumed_tail
    except zlib.error:
        return None
    return (p - len(own.unused_data), {"bytes": n}) if own.eof else None


def places(b: bytes, mark: bytes) -> list[int]:
    out, at = [], b.find(mark)
    while at >= 0:
        out.append(at)
        at = b.find(mark, at + 1)
    return out


@lru_cache(2)
def _zip_ends(b: bytes) -> dict[int, tuple[int, int]]:
    """Where archives begin, as their last records say: their ends and numbers of entries. Of two with one start, the first."""
    out: dict[int, tuple[int, int]] = {}
    for end in places(b, b"PK\x05\x06"):
        if end + 22 <= len(b):
            entries, size, offset = struct.unpack_from("<HII", b, end + 10)
            first = end - size - offset
            if first >= 0 and (not entries or b[first + offset:first + offset + 4] == b"PK\x01\x02"):
                out.setdefault(first, (end + 22 + int.from_bytes(b[end + 20:end + 22], "little"), entries))
    return out


def _zip(b: bytes, at: int):
    held = _zip_ends(b).get(at)
    return (held[0], {"entries": held[1]}) if held else None


@lru_cache(2)
def _pdf_ends(b: bytes) -> tuple[list[int], list[int]]:
    return places(b, b"%%EOF"), places(b, b"startxref")


def _pdf(b: bytes, at: int):
    ends, refs = _pdf_ends(b)
    i, j = bisect_left(ends, at), bisect_left(refs, at)
    if i == len(ends) or j == len(refs) or refs[j] + 9 > ends[i] or not b[at + 5:at + 6].isdigit():
        return None
    return ends[i] + 5, {"version": b[at + 5:at + 8].decode("latin-1")}


#: Magic bytes by format.
MAGIC = {"wav": [b"RIFF"], "png": [b"\x89PNG\r\n\x1a\n"], "gif": [b"GIF87a", b"GIF89a"], "jpeg": [b"\xff\xd8\xff"], "bmp": [b"BM"], "gzip": [b"\x1f\x8b\x08"], "zip": [b"PK\x03\x04"], "pdf": [b"%PDF-"]}
VALIDATORS = {"wav": _wave, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "gzip": _gzip, "zip": _zip, "pdf": _pdf}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for m in magics:
            out.add_word(m.decode("latin-1"), (len(m), kind))
    out.make_automaton()
    return out


def found(b: bytes, own: ahocorasick.Automaton) -> list[tuple[str, int, int, dict]]:
    """(type, start, end, facts) of all media that hold, in order of their starts; media inside others too."""
    out = []
    for last, (n, kind) in own.iter(b.decode("latin-1")):
        at = last - n + 1
        if held := VALIDATORS[kind](b, at):
            out.append((kind, at, *held))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def sniff(df: DataFrame, media: str, declared: str | None = None) -> DataFrame:
    """Adds type (as the bytes are; null if nothing is known to begin there), declared_ok and carved (type:start:end of
    what lies further inside, joined by commas). Null and empty bytes have no type; with no declared type, declared_ok is
    null. Columns of df with these three names are replaced, all others stay, whatever they are called; rows are taken one by
    one, so repeated rows and ties stay as they are."""

    @F.pandas_udf("type string, carved string")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = automaton()
        for b in batches:
            rows = [found(bytes(x), own) if x is not None else [] for x in b]
            yield pd.DataFrame({"type": [r[0][0] if r and r[0][1] == 0 else None for r in rows], "carved": [",".join(f"{k}:{s}:{e}" for k, s, e, _ in r if s) for r in rows]})

    mine = ("type", "declared_ok", "carved")
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), look(F.col(f"`{media}`")).alias("seen"))
    says = F.lower(F.col(f"row.`{declared}`")).eqNullSafe(F.col("seen.type")) if declared else F.lit(None).cast("boolean")
    return whole.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in mine), F.col("seen.type").alias("type"), says.alias("declared_ok"), F.col("seen.carved").alias("carved"))


def store(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, n_bytes, media): each text's padded bytes as a WAVE file. A null text counts as empty; rows are taken one by one,
    null idents and repeated rows stay, and other columns are left out, whatever their names. No rows, no media."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                sizes, media = [], []
                for t in b.column(1).slice(at, 256):
                    n, payload = padded(t.as_py())
                    sizes.append(n)
                    media.append(wave(payload))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["_id", "n_bytes", "media"])

    return df.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(put, "_id long, n_bytes long, media binary")


def features(stored: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Reads stored media, (_id, n_bytes, media) as store() makes it: type and facts by the validators, the payload from the
    samples, digests and statistics. A row for each row."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton()
        for b in batches:
            out = []
            for m in b.column("media"):
                raw = m.as_py()
                media = found(raw, own)
                kind, _, end, facts = next(x for x in media if x[1] == 0)
                at, n = facts["data"]
                payload = raw[at:at + n]
                samples = np.frombuffer(payload, np.uint8)
                inside = [f"{k}:{s}:{e}" for k, s, e, _ in media if s]
                feature = json.dumps({"type": kind, "whole": end == len(raw), "rate": facts["rate"], "channels": facts["channels"], "bits": facts["bits"], "samples": facts["samples"],
                                      "mean": round(float(samples.mean()), 4), "crossings": int((np.diff((samples >= 128).view(np.int8)) != 0).sum()), "carved": inside})
                out.append((n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_bytes"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))],
                                             names=["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(get, "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("_id", ident)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as media, written to the shared folder and read from there."""
    return features(kept(store(table(spark, sf_dir, "documents")), "media"))
