"""Shards of nearly equal bytes: best-fit decreasing over indivisible groups.

Rows with equal texts are one group. Groups enter bins in order of size, each into the bin with the least
room that still holds it; a balanced tree keeps the bins by room. Groups of one size are alike, so what
is packed is the table of group sizes with their counts: `runs` says how many groups of a size go to which
bin. It is the only thing on the driver, and has at most sqrt(2 * total bytes) sizes, since that many
different sizes already add up to the total.

For a given number of shards the capacity is the least (to CAPACITY_STEPS halvings) for which best-fit
decreasing needs no more of them. A group larger than an equal share can't be split: it gets a shard of
its own, and the rest is packed into the others.

Defined cases: null and empty texts are two groups of their own; repeated rows are copies; an empty table
gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered

ROW_BYTES = 16
CAPACITY_STEPS = 24


class RoomTree:
    """(room, bin) pairs in order: a B-tree of two levels whose leaves hold at most 2 * LEAF pairs."""

    LEAF = 256

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]

    def _leaf(self, pair: tuple[int, int]) -> int:
        low, high = 0, len(self.leaves) - 1
        while low < high:
            mid = (low + high) // 2
            if self.leaves[mid] and self.leaves[mid][-1] >= pair:
                high = mid
            else:
                low = mid + 1
        return low

    def add(self, room: int, place: int) -> None:
        k = self._leaf((room, place))
        insort(self.leaves[k], (room, place))
        if len(self.leaves[k]) > 2 * self.LEAF:
            self.leaves[k:k + 1] = [self.leaves[k][:self.LEAF], self.leaves[k][self.LEAF:]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the pair with the least room of at least `size`."""
        pair = (size, -1)
        k = self._leaf(pair)
        at = bisect_left(self.leaves[k], pair)
        if at == len(self.leaves[k]):
            return None
        found = self.leaves[k].pop(at)
        if not self.leaves[k] and len(self.leaves) > 1:
            del self.leaves[k]
        return found


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, count, bin) runs for (size, count) pairs of falling size; None beyond `most` bins.

    A bin that has just taken a group is the tightest that holds the next of the same size, as long as it
    does; so it takes all that fit.
    """
    tree, bins, runs = RoomTree(), 0, []
    for size, count in sizes:
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            room, place = found
            n = min(count, room // size) if size else count
            runs.append((size, n, place))
            count -= n
            tree.add(room - n * size, place)
    return runs


def pack(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs that fill `shards` bins as evenly as best-fit decreasing can."""
    sizes = [list(p) for p in sorted(sizes, reverse=True)]
    alone, total, own = [], sum(s * c for s, c in sizes), 0
    while shards - own > 1 and sizes and sizes[0][0] * (shards - own) > total:
        size = sizes[0][0]
        alone.append((size, 1, own))
        own += 1
        total -= size
        sizes[0][1] -= 1
        if not sizes[0][1]:
            sizes.pop(0)
    if not sizes:
        return alone
    bins = shards - own
    low = max(-(-total // bins), sizes[0][0])
    found, step = best_fit_decreasing(sizes, low, bins), max(1, low >> 16)
    high = low
    while found is None:
        low, high = high, high + step
        step *= 2
        found = best_fit_decreasing(sizes, high, bins)
    for _ in range(CAPACITY_STEPS):
        if high - low <= 1:
            break
        mid = (low + high) // 2
        got = best_fit_decreasing(sizes, mid, bins)
        low, high, found = (low, mid, got) if got is not None else (mid, high, found)
    return alone + [(s, n, place + own) for s, n, place in found]


def sharded(docs: DataFrame, shards: int = 40, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.cut(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"), F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("digest")), "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("group_size"))
    groups = scratch.cut(numbered(groups, ["group_size"], ["digest"], "rank", scratch), "groups")
    counts = groups.groupBy("group_size").agg(F.count("*").alias("n")).toLocalIterator()
    runs, start = [], {}
    for size, n, place in pack([(r["group_size"], r["n"]) for r in counts], shards):
        first = start.get(size, 0)
        runs.append((size, first, first + n, place))
        start[size] = first + n
    table = spark.createDataFrame(runs, "group_size long, first long, past long, shard int")
    placed = groups.join(table, "group_size").filter("rank >= first and rank < past").select("digest", "shard")
    out = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    return numbered(out, ["shard"], ["doc_id"], "slot", scratch).withColumn("grown_shard", F.lit(None).cast("int"))
