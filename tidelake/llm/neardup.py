"""Near duplicates by HyperMinHash.

Every text's shingle set gets a HyperMinHash sketch: for each of 384 hash functions the least hash, kept as its leading
zeros and ten bits after the leading one. Bands of registers propose candidates, the collision-corrected estimate of the
Jaccard similarity drops those that are far off (over SIGMAS standard deviations), and full sets confirm the rest.

Groups of copies never become pairs:
1. equal word sequences are one text from the start;
2. each text is compared with one leader only, the least id that it shares the most bands with; a leader's followers are
   dealt out, FOLLOWERS to a group, and a group holds the leader's set once; confirmed links are contracted into components;
3. texts that share a band but not a component are compared in blocks of bounded rows and bytes, and only confirmed links
   leave a block. Buckets of such texts that overlap make clusters; a cluster of up to CLUSTER texts is compared as a
   whole, so that its texts travel once and not for every bucket; in larger ones each bucket is. Either way all pairs that
   share a band are looked at.
Step 3 looks at all that step 2 may have missed, so no link between different texts depends on the choice of leaders.
What can miss a link is the sketch alone: at the threshold its bands do so for less than one pair in a million (three words
and 0.85: 2.3 in ten million; five words and 0.8: 4 in a thousand million), and the estimate for 2 in a hundred million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch as S
from .common import few, let_go, stored, table

MISSED, SIGMAS = 1e-6, 5.5
#: Texts, and shingles of all texts together, in a block; followers that are compared with one copy of their leader.
BLOCK, BLOCK_SHINGLES, FOLLOWERS = 2048, 4_000_000, 512
#: Texts in a cluster that is compared as a whole; in larger ones, only texts that share a bucket are.
CLUSTER = 4096


def band_size(threshold: float) -> int:
    """The most registers in a band with which a pair at the threshold shares a band but for a chance of MISSED."""
    return max(r for r in (1, 2, 3, 4, 6, 8, 12) if r == 1 or (1 - threshold**r) ** (S.REGISTERS // r) <= MISSED)


def least_estimate(threshold: float) -> float:
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / S.REGISTERS)


def sketched(docs: DataFrame, shingle: int, with_sets: bool = False) -> DataFrame:
    """docs has _id and _text. Returns _id, _key (digest of the words; null without words), _n, _sketch, and _set on demand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                ids, texts, cols = b.column(0).slice(at, 256), b.column(1).slice(at, 256).to_pylist(), []
                for t in texts:
                    own = S.words(t)
                    s = S.shingles(own, shingle)
                    cols.append((S.digest(own) if own else None, len(s), S.registers(s).tobytes() if own else None, *([s.tobytes()] if with_sets else [])))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([c[i] for c in cols], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.binary())[: 3 + with_sets]))],
                                                 names=["_id", "_key", "_n", "_sketch", "_set"][: 4 + with_sets])
        let_go()

    return docs.select("_id", "_text").mapInArrow(read, "_id long, _key binary, _n long, _sketch binary" + ", _set binary" * with_sets)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b): label is the least id that can be reached.

    By contraction: every id hangs on its least neighbour, chains are shortened to their roots by doubling, and the edges
    between roots are what is left for the next round, so edges shrink from round to round. Each step is a stored table."""
    left = stored(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    labels = stored(left.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().select("id", F.col("id").alias("label")), "labels")
    left = left.filter("lo < hi")
    while left.limit(1).count():
        up = stored(left.groupBy("hi").agg(F.min("lo").alias("up")), "up")
        while True:
            parents = stored(up.select(F.col("up").alias("hi")).distinct(), "parents")
            inner = stored(up.join(few(parents), "hi", "left_semi").select(F.col("hi").alias("_of"), F.col("up").alias("_to")), "inner")
            if not inner.limit(1).count():
                break
            up = stored(up.join(few(inner), F.col("up") == F.col("_of"), "left").select("hi", F.coalesce("_to", "up").alias("up")), "up")
        root = few(up.select(F.col("hi").alias("_of"), F.col("up").alias("_to")))
        labels = stored(labels.join(root, F.col("label") == F.col("_of"), "left").select("id", F.coalesce("_to", "label").alias("label")), "labels")
        left = left.join(root, F.col("hi") == F.col("_of")).select("lo", F.col("_to").alias("hi")).filter("lo <> hi")
        left = left.join(root, F.col("lo") == F.col("_of"), "left").select(F.coalesce("_to", "lo").alias("lo"), "hi").filter("lo <> hi")
        left = stored(left.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "edges")
    return labels


def _matrix(raw, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint16).reshape(-1, width)


def _confirmed(set_a: bytes, set_b: bytes, threshold: float) -> bool:
    a, b = np.frombuffer(set_a, np.uint64), np.frombuffer(set_b, np.uint64)
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = S.common(a, b)
    return round(1000 * threshold) * (len(a) + len(b) - both) <= 1000 * both


def small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches in slices, as rows hold whole sets."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def led(rows: DataFrame, threshold: float) -> DataFrame:
    """Links between leaders and followers, among groups (_leader, _share) of rows (_id, _n, _sketch, _set); a group's
    leader comes first, and its followers pass by one after the other."""
    least = least_estimate(threshold)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []  # of an ident with several texts, all of them
        for b in small(batches):
            found = []
            for r in b.to_pylist():
                if group != (r["_leader"], r["_share"]):
                    group, leaders = (r["_leader"], r["_share"]), []
                if r["_id"] == r["_leader"]:
                    leaders.append(r)
                    continue
                for x in leaders:
                    equal = (np.frombuffer(x["_sketch"], np.uint16) == np.frombuffer(r["_sketch"], np.uint16)).sum(keepdims=True)
                    if S.estimated(equal, np.array([x["_n"]]), np.array([r["_n"]]))[0] >= least and _confirmed(x["_set"], r["_set"], threshold):
                        found.append((r["_id"], x["_id"]))
                        break
            yield _links(found)
        leaders.clear()
        let_go()

    dealt = rows.repartition("_leader", "_share").sortWithinPartitions("_leader", "_share", F.col("_id") != F.col("_leader"))
    return dealt.mapInArrow(read, "a long, b long")


def blocked(rows: DataFrame, threshold: float) -> DataFrame:
    """Links between different components within each group (_bucket, _lo, _hi) of rows (_side, _id, label, _n, _sketch, _set).

    Rows arrive sorted by group; a group has at most two blocks, so what is held is bounded."""
    least = least_estimate(threshold)

    def links(g: list[dict]) -> list[tuple[int, int]]:
        sketches = _matrix([r["_sketch"] for r in g], S.REGISTERS)
        label, side, n = (np.array([r[k] for r in g]) for k in ("label", "_side", "_n"))
        one = g[0]["_lo"] == g[0]["_hi"]
        root = {x: x for x in set(label.tolist())}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in range(len(g) - 1):
            j = np.arange(i + 1, len(g))
            j = j[(label[j] != label[i]) & (one | (side[j] != side[i])) & (np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]))]
            if len(j):
                equal = (sketches[j] == sketches[i]).sum(1)
                for k in j[S.estimated(equal, n[j], np.full(len(j), n[i])) >= least]:
                    x, y = find(int(label[i])), find(int(label[k]))
                    if x != y and _confirmed(g[i]["_set"], g[k]["_set"], threshold):
                        root[x] = y
                        out.append((g[i]["_id"], g[k]["_id"]))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = lambda r: (r["_bucket"], r["_lo"], r["_hi"])
        found: list[tuple[int, int]] = []
        for b in small(batches):
            for r in b.to_pylist():
                if held and key(held[0]) != key(r):
                    found += links(held)
                    held = []
                held.append(r)
            yield _links(found)
            found = []
        if held:
            yield _links(links(held))
            held.clear()
        let_go()

    ordered = rows.repartition("_bucket", "_lo", "_hi").sortWithinPartitions("_bucket", "_lo", "_hi")
    return ordered.mapInArrow(read, "a long, b long")


def followers(members: DataFrame) -> DataFrame:
    """(_id, _leader, _share) for every text that isn't its own leader: whom it is compared with, and in which group."""
    best = members.filter("_id <> _leader").groupBy("_id", "_leader").count().groupBy("_id").agg(F.max_by("_leader", F.struct("count", -F.col("_leader"))).alias("_leader"))
    best = stored(best, "followers")
    hot = stored(best.groupBy("_leader").count().filter(F.col("count") > FOLLOWERS).select("_leader", F.ceil(F.col("count") / FOLLOWERS).alias("_shares")), "hot")
    share = F.pmod(F.xxhash64("_id", F.lit(5)), F.coalesce("_shares", F.lit(1).cast("long"))).cast("int")
    return stored(best.join(few(hot), "_leader", "left").select("_id", "_leader", share.alias("_share")), "followers")


def near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each row of df: ident, n_shingles (long), component_id (the least ident that links lead to) and kept.

    Two texts link if their sets of shingles have a Jaccard similarity of at least `threshold`. A null text, and one
    without words, links with nothing; with fewer words than a shingle, all words make one. Rows with the same ident are
    one document with several texts: what one of them links with, the document links with. Rows without an ident link with
    nothing and are kept, their component is null. An empty table gives an empty result; df's other columns are left out,
    whatever their names.
    """
    docs = df.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text"))
    every = stored(sketched(docs, shingle), "sketches")
    worded = every.filter("_key is not null and _id is not null")
    copies = stored(worded.groupBy("_key").agg(F.min("_id").alias("_rep"), F.max("_id").alias("_last")).filter("_rep < _last").drop("_last"), "copies")
    rep = few(copies)
    texts = worded.join(rep, "_key", "left").filter("_rep is null or _rep = _id")
    size = band_size(threshold)
    keys = F.transform(F.sequence(F.lit(0), F.lit(S.REGISTERS // size - 1)), lambda i: F.xxhash64(i, F.col("_sketch").substr(i * (2 * size) + 1, F.lit(2 * size))))
    bands = texts.select("_id", "_n", F.explode(keys).alias("_bucket"))
    shared = bands.groupBy("_bucket").agg(F.min("_id").alias("_leader"), F.max("_id").alias("_last")).filter("_leader < _last").select("_bucket", "_leader")
    members = stored(bands.join(few(stored(shared, "buckets")), "_bucket").distinct(), "members")

    ids = stored(members.select("_id").distinct(), "candidates")
    full = stored(sketched(docs.join(few(ids), "_id", "left_semi"), shingle, True).filter("_key is not null").drop("_key"), "sets")
    follow = followers(members)
    leads = stored(follow.select(F.col("_leader").alias("_id"), "_leader", "_share").distinct(), "leaders")
    edges = led(full.join(few(follow), "_id").unionByName(full.join(few(leads), "_id")), threshold)
    several = stored(worded.groupBy("_id").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).filter("lo < hi").select("_id"), "several")
    if several.limit(1).count():  # documents with several texts are linked with whoever stands for each of them
        edges = edges.union(worded.join(rep, "_key").filter("_rep <> _id").join(few(several), "_id", "left_semi").select(F.col("_id").alias("a"), F.col("_rep").alias("b")))

    labels = components(edges)
    known = few(labels)
    labelled = members.join(known.withColumnRenamed("id", "_id"), "_id", "left").select("_bucket", "_id", "_n", F.coalesce("label", "_id").alias("label"))
    same = [F.count("*").alias("_count"), F.sum("_n").alias("_shingles"), F.min("_id").alias("_first"), F.bit_xor(F.xxhash64("_id")).alias("_x"), F.bit_xor(F.xxhash64("_id", F.lit(7))).alias("_y")]
    mixed = labelled.groupBy("_bucket").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), *same).filter("_a < _b")
    # buckets with the same texts are looked at once: two that differ have 128 equal bits by chance alone
    mixed = stored(mixed.groupBy("_count", "_shingles", "_first", "_x", "_y").agg(F.min("_bucket").alias("_bucket")).select("_bucket", "_count", "_shingles", "_first"), "mixed")
    left = stored(labelled.join(few(mixed), "_bucket"), "mixed-members")
    clusters = components(left.filter("_id <> _first").select(F.col("_id").alias("a"), F.col("_first").alias("b")))
    placed = left.join(few(clusters.select(F.col("id").alias("_id"), F.col("label").alias("_cluster"))), "_id")
    sizes = stored(placed.select("_cluster", "_id", "_n").distinct().groupBy("_cluster").agg(F.count("*").alias("_texts"), F.sum("_n").alias("_all")), "cluster-sizes")
    placed = placed.join(few(sizes), "_cluster")
    blocks = lambda n, shingles: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int").alias("_blocks")
    whole = placed.filter(F.col("_texts") <= CLUSTER).select(F.col("_cluster").alias("_bucket"), "_id", "label", blocks("_texts", "_all")).distinct()
    parts = placed.filter(F.col("_texts") > CLUSTER).select("_bucket", "_id", "label", blocks("_count", "_shingles"))
    dealt = whole.union(parts).withColumn("_side", F.pmod(F.xxhash64("_id", F.lit(3)), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = stored(dealt.select("_bucket", F.least("_side", "_other").alias("_lo"), F.greatest("_side", "_other").alias("_hi"), "_side", "_id", "label"), "dealt")
    more = stored(blocked(full.join(few(dealt), "_id"), threshold), "links")
    if more.limit(1).count():
        of = lambda c: known.select(F.col("id").alias(c), F.col("label").alias(f"_{c}"))
        pairs = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        new = components(pairs).select(F.col("id").alias("_of"), F.col("label").alias("_to"))
        alone = new.join(known, F.col("_of") == F.col("id"), "left_anti").select(F.col("_of").alias("id"), F.col("_to").alias("label"))
        labels = labels.join(few(new), F.col("label") == F.col("_of"), "left").select("id", F.coalesce("_to", "label").alias("label"))
        known = few(stored(labels.union(alone), "labels"))

    own = every.filter("_key is not null").select("_id", "_n", "_key").join(rep, "_key", "left")
    own = own.select("_id", "_n", F.coalesce("_rep", "_id").alias("_rep")).join(known.select(F.col("id").alias("_rep"), "label"), "_rep", "left")
    comp = F.when(F.col("_id").isNotNull(), F.coalesce("label", "_rep"))
    out = own.select("_id", "_n", comp.alias("_c")).union(every.filter("_key is null").select("_id", "_n", F.col("_id").alias("_c")))
    return out.select(F.col("_id").alias(ident), F.col("_n").alias("n_shingles"), F.col("_c").alias("component_id"), F.coalesce(F.col("_id") == F.col("_c"), F.lit(True)).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: three words in a shingle, a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)
