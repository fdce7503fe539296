"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are laid on a line of words, in the order of a seeded hash, and the line is cut into blocks. The
driver, which only sees one row for each source, turns target weights into exact quotas of blocks and splits these
quotas down a binary tree whose leaves are output shards: at every node the left half's blocks come from the sources as
a multivariate-hypergeometric draw. Block b of a source has the rank that a keyed permutation (a Feistel network with
cycle walking) gives it; leaf by leaf, the ranks are taken in order, so shards hold disjoint blocks of each pass over a
source: what no leaf has room for isn't drawn. Each shard is then shuffled by itself. All work on rows is DataFrame operations, and nothing is random but
the seed: reruns agree.
"""

from __future__ import annotations

import hashlib
import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, stored, table, words

#: Words in a block, and the least number of blocks that a source with enough words is cut into.
BLOCK_WORDS, LEAST_BLOCKS = 256, 128
#: Documents that are laid on the line together in one task.
LAID_TOGETHER = 4096
#: Sources that the driver plans for; beyond it the mix is refused rather than planned in too much memory.
MOST_SOURCES = 100_000
#: Rounds and steps of the permutation.
ROUNDS, WALK = 4, 32
#: Words that a task of the shuffled mix holds, about, and the most tasks; rows of two hashes that are broadcast.
TASK_WORDS, MOST_TASKS, FEW = 4_000_000, 50_000, 250_000
#: What tells rows of different ident, source or text apart: 128 bits.
SAME = ("_hash", "_twin")


def targets(sizes: list[int], weights: list[float], total: float | None = None, most: float = 3.0) -> list[float]:
    """Shares of `total` (all sizes, if None) by weight; none above `most` times its size, the excess reshared by weight."""
    total = sum(sizes) if total is None else total
    out, left, free = [0.0] * len(sizes), float(total), list(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if whole <= 0 or left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def _key(seed: int, *parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=4).digest(), "big")


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls are good: by inversion from the mode, in O(standard deviation) steps."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(log(good, mode) + log(bad, drawn - mode) - log(good + bad, drawn))
    u, down, up, p_down, p_up = rng.random() - at_mode, mode, mode, at_mode, at_mode
    while u > 0:
        moved = False
        if up < high and p_up > 0:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up, u, moved = up + 1, u - p_up, True
            if u <= 0:
                return up
        if down > low and p_down > 0:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down, u, moved = down - 1, u - p_down, True
            if u <= 0:
                return down
        if not moved or p_up < 1e-300 and p_down < 1e-300:
            return mode
    return mode


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source in each shard. Shards get equal numbers of blocks (at most one apart), sources their quotas."""
    out: list[list[int]] = [[]] * shards

    def split(counts: list[int], first: int, n: int) -> None:
        if n == 1:
            out[first] = counts
            return
        left = n // 2
        rng, total = random.Random(_key(seed, "tree", first, n)), sum(counts)
        take, rest, drawn = [], total, total * left // n
        for c in counts:  # source by source, each from what is left
            k = hypergeometric(rng, c, rest - c, drawn)
            take.append(k)
            rest, drawn = rest - c, drawn - k
        split(take, first, left)
        split([c - k for c, k in zip(counts, take, strict=True)], first + left, n - left)

    split(list(quotas), 0, shards)
    return out


def permuted(index: Column, n: Column, side: Column, keys: list[Column]) -> Column:
    """The rank of a block by a keyed permutation of 0 .. n-1: a Feistel network on the square of `side` (side * side >= n),
    walked until it lands below n. A walk meets the 2 * side values outside at most once each, so 2 * side steps end it for
    certain; all but one in 10^28 end within WALK, and only those go on."""

    def once(x: Column) -> Column:
        b = F.pmod(x, side)
        a = ((x - b) / side).cast("long")
        for k in keys:
            a, b = b, F.pmod(a + F.pmod(F.xxhash64(b, k), side), side)
        return a * side + b

    def walked(x: Column, steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), steps.cast("long")), x, lambda x, _: F.when(x < n, x).otherwise(once(x)))

    some = F.array(walked(once(index), F.lit(WALK)))
    return F.element_at(F.transform(some, lambda x: F.when(x < n, x).otherwise(walked(x, 2 * side))), 1)


def plan(sizes: list[tuple[str | None, int]], weights: list[float], shards: int, seed: int, most: float = 3.0) -> list[dict]:
    """One row for each source: its target in words, its blocks, and where each shard's part of its turns ends, as the
    tree's leaves say: turn t is block rank t modulo blocks, in pass t / blocks."""
    goal = targets([n for _, n in sizes], weights, most=most)
    rows = []
    for (source, size), target in zip(sizes, goal, strict=True):
        blocks = min(size, max(LEAST_BLOCKS, -(-size // BLOCK_WORDS)))
        quota = min(round(target * blocks / size), math.floor(most * blocks)) if size else 0
        rows.append({"source": source, "source_size": size, "target": target, "blocks": blocks, "quota": quota, "side": math.isqrt(max(blocks - 1, 0)) + 1,
                     "each": size // blocks if blocks else 0, "longer": size % blocks if blocks else 0})
    for row, counts in zip(rows, zip(*splitting_tree([r["quota"] for r in rows], shards, seed), strict=True) if rows else [], strict=True):
        row["ends"] = list(accumulate(counts))
    return rows


def row_hashes(ident: str, text: str, source: str, seed: int) -> list[Column]:
    own = (F.col(ident), F.col(source).isNull(), F.col(source), F.coalesce(F.col(text), F.lit("")))
    return [F.xxhash64(F.lit(seed), *own).alias(SAME[0]), F.xxhash64(F.lit(~seed), F.lit(1), *own).alias(SAME[1])]


def lay(df: DataFrame, ident: str, text: str, source: str, seed: int) -> tuple[DataFrame, dict]:
    """(_id, _source, _size, _start: words of the source before the document) and each source's words.

    Documents are dealt to (source, hash) buckets; a bucket's start is the sum of those before it, so a source that holds
    most rows is spread over as many tasks as its rows need."""
    rows = stored(df.select(F.col(ident).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"), n_words(F.col(text)).alias("_size"),
                            *row_hashes(ident, text, source, seed)), "mix-rows")
    total = rows.groupBy("_source").agg(F.sum("_size").alias("words"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(total) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    # each source by its own count: a row for each source, MOST_SOURCES at most
    deals = df.sparkSession.createDataFrame([(r["_source"], -(-r["n"] // LAID_TOGETHER)) for r in total], "_of string, _deals long")
    rows = rows.join(F.broadcast(deals), F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_deal", F.pmod(F.shiftright("_hash", 7), F.col("_deals"))).drop("_of", "_deals")
    sums = rows.groupBy("_source", "_deal").agg(F.sum("_size").alias("_sum"))
    before = sums.select(F.col("_source").alias("_s"), F.col("_deal").alias("_d"),
                         (F.sum("_sum").over(Window.partitionBy("_source").orderBy("_deal")) - F.col("_sum")).alias("_before"))
    own = F.sum("_size").over(Window.partitionBy("_source", "_deal").orderBy("_hash", "_twin", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    laid = rows.withColumn("_own", own).join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_deal") == F.col("_d")))
    laid = stored(laid.select("_id", "_source", "_size", *SAME, (F.col("_own") + F.col("_before")).alias("_start")), "mix-laid")
    return laid, {r["_source"]: r["words"] for r in total}


def mix(df: DataFrame, weights: dict | None = None, ident: str = "doc_id", text: str = "text", source: str = "source", shards: int = 16, seed: int = 17, most: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Draws the mix. Returns the documents as laid on their sources' lines, one row for each drawn part, and the plan.

    Columns of a part: _id, _source, _size, _hash and _twin (of the row), _start, pass (which pass over the source, from 0), shard, place (an order within the
    shard that mixes all sources), from_word and n_words. weights: by source; None: 1, 2, 3, repeating, over the sources
    in code point order, null last. A null text has no words and is never drawn; a null source is a source of its own;
    repeated rows are rows of their own; an empty table gives no rows.
    """
    spark = df.sparkSession
    laid, words = lay(df, ident, text, source, seed)
    sizes = sorted(words.items(), key=lambda x: (x[0] is None, x[0] or ""))
    weight = [float(weights.get(s, 0)) for s, _ in sizes] if weights is not None else [1.0 + i % 3 for i in range(len(sizes))]
    rows = plan(sizes, weight, shards, seed, most)
    planned = planned_table(spark, rows)
    doc = laid.join(F.broadcast(planned), F.col("_source").eqNullSafe(F.col("source"))).withColumn("_drawn", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0))).filter("_size > 0 and _drawn > 0")  # MOST_SOURCES rows at most
    # the first `longer` blocks have `each` + 1 words, the others `each`
    edge = F.col("longer") * (F.col("each") + 1)
    whole_of = lambda a, b: F.floor(a / b).cast("long")
    block_of = lambda at: F.when(at < edge, whole_of(at, F.col("each") + 1)).otherwise(F.col("longer") + whole_of(at - edge, F.col("each")))
    start_of = lambda b: b * F.col("each") + F.least(b, F.col("longer"))
    block, end = F.col("_block"), F.col("_start") + F.col("_size")
    part = doc.withColumn("_block", F.explode(F.sequence(block_of(F.col("_start")), block_of(end - 1))))
    low = F.greatest(start_of(block), F.col("_start"))
    part = part.withColumn("from_word", low - F.col("_start")).withColumn("n_words", F.least(start_of(block + 1), end) - low)
    part = part.withColumn("_rank", permuted(block, F.col("blocks"), F.col("side"), [F.xxhash64(F.lit(seed), F.lit(i), F.col("_source")) for i in range(ROUNDS)]))
    whole = whole_of(F.col("_drawn"), F.col("blocks"))
    drawn = part.withColumn("_passes", whole + F.when(F.col("_rank") < F.pmod("_drawn", "blocks"), 1).otherwise(0)).filter("_passes > 0")
    drawn = drawn.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)))
    turn = F.col("pass") * F.col("blocks") + F.col("_rank")
    drawn = drawn.withColumn("shard", F.size(F.filter("ends", lambda e: e <= turn)).cast("int"))  # the leaf that this turn falls to
    place = F.xxhash64(F.lit(seed), "_source", "_block", "pass")
    return laid, drawn.select("_id", "_source", "_size", *SAME, "_start", "pass", "shard", place.alias("place"), "from_word", "n_words"), planned


def planned_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in rows], "source string, source_size long, target double, blocks long, quota long, side long, each long, longer long, ends array<long>")


def shuffled(parts: DataFrame, shards: int, words: int) -> DataFrame:
    """Shard after shard, each in an order that mixes its blocks (place is a hash). A shard is cut by place into as many
    tasks as its words need, so that no shard, however large, is one task's."""
    tasks = min(MOST_TASKS, max(1, -(-words // TASK_WORDS)))
    at = (F.col("shard") + F.col("place") / float(1 << 64) + 0.5) / shards * tasks
    task = F.least(F.floor(at), F.lit(tasks - 1)).cast("int")
    return parts.repartitionById(tasks, task).sortWithinPartitions("shard", "place", "_source", "_start", "pass")


def mixed(df: DataFrame, weights: dict | None = None, ident: str = "doc_id", text: str = "text", source: str = "source", shards: int = 16, seed: int = 17, most: float = 3.0) -> DataFrame:
    """The mix's texts with df's columns, shard after shard and shuffled in each: a row for the words that one pass over a
    document gives to one shard.

    A document that goes whole to a shard keeps its text as it is; of others, the drawn blocks' words stay, joined by spaces.
    Documents of which nothing is taken go, and with them those without words. Rows that are equal in ident, source and text
    are drawn as often as they occur, each with its own other columns. An empty table gives no rows."""
    laid, drawn, planned = mix(df, weights, ident, text, source, shards, seed, most)
    part = F.struct(F.col("from_word").cast("int").alias("at"), F.col("n_words").cast("int").alias("n"))
    taken = drawn.groupBy(*SAME, "_source", "_start", "_size", "pass", "shard").agg(F.sort_array(F.collect_list(part)).alias("_parts"), F.sum("n_words").alias("_taken"), F.min("place").alias("place"))  # a document's blocks
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))  # whatever df's columns are called
    docs = df.select(*row_hashes(ident, text, source, seed), whole.alias("_row"))
    twins = stored(laid.filter("_size > 0").groupBy(*SAME).agg(F.count("*").alias("_n")).filter("_n > 1").select(*SAME), "mix-twins")
    if n := twins.count():  # equal rows are numbered on both sides: which of them has which number is all the same
        twins = F.broadcast(twins) if n <= FEW else twins
        nth = lambda *order: F.row_number().over(Window.partitionBy(*SAME).orderBy(*order))
        own = laid.filter("_size > 0").join(twins, list(SAME), "left_semi").select(*SAME, "_source", "_start", nth("_start").alias("_nth"))
        again = taken.withColumnRenamed("_source", "_s").join(own.withColumnRenamed("_start", "_at"), list(SAME)).filter("_start = _at and _s <=> _source").drop("_at", "_s")
        again = docs.join(twins, list(SAME), "left_semi").withColumn("_nth", nth(F.xxhash64("_row"))).join(again, [*SAME, "_nth"]).drop("_nth")
        once = docs.join(twins, list(SAME), "left_anti").join(taken.join(twins, list(SAME), "left_anti"), list(SAME))
        out = once.unionByName(again)
    else:
        out = docs.join(taken, list(SAME))
    old = F.col(f"_row.`{text}`")
    cut = F.array_join(F.flatten(F.transform(F.array(words(old)), lambda w: F.flatten(F.transform("_parts", lambda p: F.slice(w, p["at"] + 1, p["n"]))))), " ")
    new = F.when(F.col("_taken") == F.col("_size"), old).otherwise(cut)
    out = out.select("shard", "place", "_source", "_start", "pass", *((new if c == text else F.col(f"_row.`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)))
    total = planned.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    out = shuffled(out, shards, int(total))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and which shards get how many of its words (shard:words, joined by commas)."""
    return takings(*mix(table(spark, sf_dir, "documents")))


def takings(laid: DataFrame, drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """A row for each laid document: doc_id, size, source_size, target, taken and shards."""
    nothing, nowhere = F.lit(0).cast("long"), F.lit(None).cast("int")
    row = ["_id", "_source", "_size", "_start"]
    both = laid.filter("_size > 0").select(*row, nowhere.alias("shard"), nothing.alias("n_words")).unionByName(drawn.select(*row, "shard", "n_words"))
    each = both.groupBy(*row, "shard").agg(F.sum("n_words").alias("n"))
    given = F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "n"))))  # as many as there are shards at most
    taken = each.groupBy(*row).agg(F.sum("n").alias("taken"), F.array_join(F.transform(given, lambda x: F.concat_ws(":", x["shard"], x["n"])), ",").alias("shards"))
    # rows without words may share all four columns, and nothing is ever taken of them
    taken = taken.unionByName(laid.filter("_size = 0").select(*row, nothing.alias("taken"), F.lit("").alias("shards")))
    out = taken.join(F.broadcast(planned.select("source", "source_size", "target")), F.col("_source").eqNullSafe(F.col("source")))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken", "shards")
