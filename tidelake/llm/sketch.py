"""Shingle sets and HyperMinHash registers of texts."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash

#: Words in a shingle; registers in a sketch; registers in a band; bits kept below a register's leading one.
SHINGLE, REGISTERS, BAND, MANTISSA = 3, 384, 8, 10
UPPER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
BLANK = b"\t\n\x0b\x0c\r"
_TO_SPACE = bytes(32 if c in BLANK else c for c in UPPER)
_RNG = np.random.default_rng(20)
_A = (_RNG.integers(1 << 31, size=REGISTERS, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
_B = _RNG.integers(1 << 32, size=REGISTERS, dtype=np.uint32)[:, None]


def words(text: str | None) -> list[bytes]:
    """Words as bytes, A-Z in lower case, cut at ASCII white space only."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE)
    return [w for w in raw.split(b" ") if w]


def shingles(own: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; fewer words make one shingle, none make none."""
    if not own:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh3_64_intdigest
    if len(own) < size:
        return np.array([hashed(b" ".join(own))], np.uint64)
    h = np.fromiter(map(hashed, own), np.uint64, len(own))
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i: len(h) - size + 1 + i])
    return np.unique(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits: a bijection of shifts and odd factors."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def registers(own: np.ndarray) -> np.ndarray:
    """For each of REGISTERS hash functions, the least hash of the set: its leading zeros and the bits after its leading
    one, in 16 bits. Sets may be of any size; no set, no registers."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32) ^ own.astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[None, at:at + 512] * _A + _B).min(1), out=least)
    bits = np.maximum(least, 1).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    return (bits - np.uint64(1023 << MANTISSA)).astype(np.uint16)


def digest(own: list[bytes]) -> bytes:
    """Equal for equal word sequences."""
    return hashlib.blake2b(b" ".join(own), digest_size=16).digest()


@lru_cache(4096)
def _chance(log_a: int, log_b: int) -> float:
    """The chance that registers of two sets without common members are equal; sizes as 8ths of powers of two."""
    a, b = 2 ** (log_a / 8), 2 ** (log_b / 8)
    top = np.exp2(-np.arange(32.0))[:, None]
    edges = np.concatenate([(top / 2 * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))), top], 1)
    stay = [np.exp(n * np.log1p(-np.minimum(edges, 1 - 1e-12))) for n in (a, b)]
    return float(((stay[0][:, :-1] - stay[0][:, 1:]) * (stay[1][:, :-1] - stay[1][:, 1:])).sum())


def estimated(equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less what equals by chance."""
    steps = [np.round(8 * np.log2(np.maximum(x, 1))).astype(int) for x in (size_a, size_b)]
    by_chance = np.array([_chance(*p) for p in zip(*steps, strict=True)])
    share = equal / REGISTERS
    return np.clip((share - by_chance) / (1 - by_chance), 0, 1)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0
