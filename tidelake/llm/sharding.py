"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that no cut may split. Groups are ordered by a 64-bit hash of their text, and a cell
holds the groups whose hashes share their leading bits; the number of cells is a parameter that follows the number of
shards, not the data. Only the cells' sums reach the driver. There a binary search finds the smallest capacity for which
greedy filling needs no more shards than asked for, and the cuts are placed under that capacity, as near to even as it
allows. All work on rows is DataFrame operations.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Rows that are numbered together in one task.
NUMBERED_TOGETHER = 4096


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which greedy filling in order takes at most so many shards. No sizes: 0."""
    ends = [0, *accumulate(sizes)]

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(ends, ends[at] + capacity) - 1
            if at == len(sizes):
                return True
        return False

    low = max([0, *sizes, -(-ends[-1] // shards)])
    high = max(low, ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Where each shard ends (an index, exclusive) so that the largest shard is as small as can be.

    Under that capacity every shard aims at an equal part of what is left, large groups aside, so that one of these doesn't
    leave other shards empty. Fewer groups than shards: the last shards are empty.
    """
    capacity, ends, n = smallest_capacity(sizes, shards), [0, *accumulate(sizes)], len(sizes)
    need = [0] * (n + 1)  # shards that greedy filling takes from here on
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[max(i + 1, bisect_right(ends, ends[i] + capacity) - 1)]
    large = [i for i, s in enumerate(sizes) if s * shards > ends[-1]]  # these stand alone where that is possible
    out, at, total = [], 0, ends[-1]
    for left in range(shards, 0, -1):
        furthest = bisect_right(ends, ends[at] + capacity) - 1
        ahead = large[bisect_right(large, at - 1):]
        if ahead and ahead[0] == at:
            to = at + 1
        else:  # an equal part of what stands before the next large one
            upto = ahead[0] if ahead else n
            even = (total - ends[at] - sum(sizes[i] for i in ahead)) / max(1, left - len(ahead))
            parts = max(1, round((ends[upto] - ends[at]) / even)) if even else 1
            aim = ends[at] + (ends[upto] - ends[at]) / parts
            to = bisect_right(ends, aim) - 1
            if to < upto and ends[to + 1] - aim < aim - ends[to]:
                to += 1
        to = min(max(to, min(at + 1, n)), furthest)
        while need[to] > left - 1:  # the rest must still fit
            to += 1
        at = n if left == 1 else to
        out.append(at)
    return out


def numbered(df: DataFrame, group: str, order: list[Column], rows: int, groups: int, slot: str) -> DataFrame:
    """Adds a gapless number from 0 to each group's rows. A group's rows are dealt to tasks by hash, counted there, and
    the counts of the tasks before are added, so that no group, however large, meets in one task."""
    deal = max(1, -(-rows // (max(1, groups) * NUMBERED_TOGETHER)))
    df = df.withColumn("_deal", F.pmod(F.xxhash64(*order), F.lit(deal)))
    counts = df.groupBy(group, "_deal").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_deal", (F.sum("_n").over(Window.partitionBy(group).orderBy("_deal")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_deal").orderBy(*order)) - 1
    return (df.withColumn("_own", own).join(before, [group, "_deal"])
            .withColumn(slot, (F.col("_before") + F.col("_own")).cast("long")).drop("_deal", "_own", "_before"))


def shard(df: DataFrame, text: str, size: Column, ident: str, shards: int, cells_per_shard: int = 1 << 11, keep: dict[str, Column] | None = None) -> DataFrame:
    """Shards by bytes. Returns ident, size, what `keep` names, shard (int) and slot (long, gapless from 0 in its shard).

    A null text counts as an empty one. Repeated rows, ties and rows without an ident keep their own slots. An empty
    table gives an empty result. Other columns are left out, whatever their names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    n_cells = 1 << (shards * cells_per_shard - 1).bit_length()
    cell = F.shiftrightunsigned(F.xxhash64(whole), 64 - n_cells.bit_length() + 1)
    rows = stored(df.select(F.col(ident).alias("_id"), size.cast("long").alias("_size"), cell.alias("_cell"),
                            *(c.alias(f"_keep_{k}") for k, c in (keep or {}).items())), "shard-rows")
    sums = sorted(tuple(r) for r in rows.groupBy("_cell").agg(F.sum("_size"), F.count("*")).collect())  # n_cells rows at most
    ends = cuts([s for _, s, _ in sums], shards)
    # a shard's cells end before the first cell of the next one
    bounds = [sums[e][0] for e in ends[:-1] if e < len(sums)]
    number = sum((F.when(F.col("_cell") >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)) if len(bounds) < 64 else \
        F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_cell")))
    dealt = rows.withColumn("_shard", number.cast("int"))
    out = numbered(dealt, "_shard", [F.col("_id"), F.col("_size"), *(F.col(f"_keep_{k}") for k in keep or {})], sum(n for *_, n in sums), shards, "_slot")
    return out.select(F.col("_id").alias(ident), F.col("_size").alias("size"), *(F.col(f"_keep_{k}").alias(k) for k in keep or {}),
                      F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes; equal texts stay together."""
    from .common import table

    whole = F.coalesce(F.col("text"), F.lit(""))
    out = shard(table(spark, sf_dir, "documents"), "text", F.octet_length(whole) + 16, "doc_id", 40, keep={"text_crc32": F.crc32(F.encode(whole, "utf-8"))})
    return out.select("doc_id", "size", F.col("text_crc32").cast("long"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
