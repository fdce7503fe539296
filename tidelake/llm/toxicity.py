"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words. Each word has three hashed parts (itself and two prefixes, which languages with
long compounds need); a word's weight and factors are the sums of its parts'. The score is
sigmoid(bias + sum of weights + sum over pairs of words of the product of their factors / number of words), so pairs of
words count beyond what each adds alone. The machine is fitted on the driver to a bounded sample of labelled rows and
sent to the executors, where it has a fixed size whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, stored, table

#: Bits of the hash, factors, prefixes in characters; labelled rows that a fit uses at most, and distinct words of theirs in
#: all (48 MB on the driver).
BITS, FACTORS, PREFIXES, MOST_LABELLED, MOST_TERMS = 17, 8, (4, 5), 10_000, 4_000_000
#: Texts that are scored together, words whose parts are remembered at once.
TOGETHER, REMEMBERED = 256, 60_000
MARKS = ".,;:!?\"'()[]{}*#$%&<>|_-–—«»¡¿…"


def terms(text: str | None) -> list[str]:
    """The distinct words of a text in lower case without marks around them."""
    if not text:
        return []
    return list({w.strip(MARKS) for w in set(text.lower().split())} - {""})


def parts(word: str) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    raw = word.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) & mask, *(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) & mask for n in PREFIXES))


class Machine:
    """Weights and factors by part."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """rows: the parts of all words of some texts, one text after the other; ends: where each text's words end."""
        return 1 / (1 + np.exp(-np.clip(self.forward(rows, ends)[0], -40, 40)))

    def forward(self, rows: np.ndarray, ends: np.ndarray) -> tuple:
        starts = np.concatenate([[0], ends[:-1]])
        n = np.maximum(ends - starts, 1)[:, None]
        total = lambda x: np.diff(np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0, dtype=np.float64)])[np.concatenate([[0], ends])], axis=0)
        w, v = self.weights[rows].sum(1, keepdims=True), self.factors[rows].sum(1)
        s, q = total(v), total((v * v).sum(1, keepdims=True))
        return self.bias + total(w)[:, 0] + ((s * s).sum(1) - q[:, 0]) / (2 * n[:, 0]), v, s, n


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.2, sparse: float = 2e-3, seed: int = 5) -> Machine:
    """Adagrad on the logistic loss, with weights drawn to 0 and the rarer label weighing more. texts: an array of parts (a row for each word) for each text. With one label only,
    the machine says that label's share."""
    rng, size = np.random.default_rng(seed), 1 << BITS
    share = (labels.sum() + 1e-3) / (len(labels) + 2e-3) if len(labels) else 1e-3
    out = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    seen = np.zeros(size, bool)
    if 0 < labels.sum() < len(labels):
        weight = ((len(labels) - labels.sum()) / labels.sum()) ** 0.75
        gw, gv = np.full(size, 1e-1, np.float32), np.full((size, FACTORS), 1e-1, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at:at + batch]
                rows, ends = np.concatenate([texts[i] for i in own]), np.cumsum([len(texts[i]) for i in own])
                if not len(rows):
                    continue
                logit, v, s, n = out.forward(rows, ends)
                error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[own]) * np.where(labels[own] > 0, weight, 1.0)
                of = np.repeat(np.arange(len(own)), np.diff(np.concatenate([[0], ends])))
                d = np.column_stack([error[of], error[of, None] * (s[of] - v) / n[of]])  # by word: weight, then factors
                flat, which = np.unique(rows, return_inverse=True)
                grad = np.column_stack([np.bincount(which.ravel(), np.repeat(d[:, j], rows.shape[1]), len(flat)) for j in range(d.shape[1])]) / len(own)
                seen[flat] = True
                gw[flat] += grad[:, 0] ** 2
                gv[flat] += grad[:, 1:] ** 2
                w = out.weights[flat] - rate * grad[:, 0] / np.sqrt(gw[flat])
                out.weights[flat] = np.sign(w) * np.maximum(np.abs(w) - rate * sparse / np.sqrt(gw[flat]), 0)
                out.factors[flat] -= rate * 0.2 * (grad[:, 1:] + 1e-5 * out.factors[flat]) / np.sqrt(gv[flat])
                out.bias -= rate * 0.1 * float(error.mean())
    out.factors[~seen] = 0
    return out


def _rows(texts: list[str | None], known: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    flat: list[tuple] = []
    ends = []
    for t in texts:
        for w in terms(t):
            p = known.get(w)
            if p is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                p = known[w] = parts(w)
            flat.append(p)
        ends.append(len(flat))
    return np.array(flat, np.int32).reshape(-1, 1 + len(PREFIXES)), np.array(ends, np.int64)


def learn(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Fits a machine to labelled rows outside the held-out fifth: those with the least hash of their ident, MOST_LABELLED of
    them and MOST_TERMS distinct words in all at most. Two runs on the same rows give the same machine.

    Labels other than 0 and 1 and rows without an ident don't count; of several labels of one ident the greatest does, of
    several texts the one whose terms sort last. Null and empty texts have no terms. Without labels the machine calls
    nothing toxic."""
    own = labels.select(F.col(ident).alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    order = [F.xxhash64("_id"), F.col("_id")]
    own = F.broadcast(own.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(*order).limit(MOST_LABELLED))  # a bounded broadcast: MOST_LABELLED rows
    told = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).join(own, "_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = b.column("_text").to_pylist()
            for at in range(0, len(texts), TOGETHER):
                raw = [_rows([t], known)[0] for t in texts[at:at + TOGETHER]]
                raw = [r[np.lexsort(r.T[::-1])].tobytes() for r in raw]  # in the same order whenever they are read
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(at, TOGETHER), b.column("_y").slice(at, TOGETHER), pa.array(raw, pa.binary())], ["_id", "_y", "_terms"])
        known.clear()
        let_go()

    told = stored(told.mapInArrow(read, "_id long, _y int, _terms binary").groupBy("_id").agg(F.max("_y").alias("_y"), F.max("_terms").alias("_terms")), "told")
    wide = 4 * (1 + len(PREFIXES))
    sizes = sorted((r["_h"], r["_id"], r["_n"]) for r in told.select(order[0].alias("_h"), "_id", F.octet_length("_terms").alias("_n")).collect())  # MOST_LABELLED rows of three numbers
    ends = np.cumsum([n for *_, n in sizes]) if sizes else np.empty(0)
    last = int(np.searchsorted(ends, wide * MOST_TERMS, "right"))
    if last < len(sizes):
        h, i, _ = sizes[last]
        told = told.filter((order[0] < h) | (order[0] == h) & (F.col("_id") < i))
    got = sorted(map(tuple, told.collect()), key=lambda r: r[0])  # 12 bytes for each of MOST_TERMS words at most
    rows = [np.frombuffer(r[2], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in got]
    return fit(rows, np.array([r[1] for r in got], np.float64))


def held_out(ident):
    return F.pmod(F.crc32(F.encode(ident.cast("string"), "utf-8")), F.lit(5)) == 0


def score(df: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """Adds a score from 0 to 1. Null and empty texts get the bias's score; no other column is looked at."""
    sent = df.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, known = Machine(*sent.value), {}
        for texts in batches:
            slices = (texts.slice(at, TOGETHER).to_pylist() for at in range(0, len(texts), TOGETHER))
            yield pa.array(np.concatenate([np.empty(0), *(own.score(*_rows(some, known)) for some in slices)]))
        known.clear()
        let_go()

    return df.withColumn(name, scored(F.col(text)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = learn(docs, table(spark, sf_dir, "labels"))
    out = score(docs, machine)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
