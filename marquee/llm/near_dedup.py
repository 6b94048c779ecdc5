"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

A document's set is its distinct shingles of `width` consecutive words (A-Z lower-cased; a shorter text is
one shingle). Documents link if 100 * intersection >= percent * union, and a class is what links reach.

Banding with L tables of 2 * ROWS values each would need 2 * ROWS * L MinHash values. Here two small
collections of `m` keys, each of ROWS values, are computed, and table (i, j) has the key (a_i, b_j): m * m
tables from 2 * m * ROWS values. `collection_size` picks m so that a pair just at the threshold is missed
by all tables with a chance of at most MISS.

Copies with equal sets become one representative first. Keys that no other representative has are left
out before tables are formed. In each bucket all members are compared with its smallest one, its head; a bucket
whose members are then in one class is done. The members of large buckets are from then on looked at by their
heads, not bucket by bucket: where there are different classes under a head, all are compared with those that
come first in ORDERS random orders. Of what is left, buckets up to SMALL compare all members that are still in
different classes; members of larger ones go through an exact prefix join on their rarest shingles, so that no
bucket size loses a link and none is compared all with all.

Defined cases: null, empty or blank texts have no shingles, link with nothing and are kept; rows without
doc_id are neither linked nor dropped; repeated rows are copies; different texts of one doc_id are documents of
their own, in any order of rows; columns besides doc_id and text are left alone; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import Scratch, in_arrow, text_slices, word_bytes, word_codes

ROWS = 3
MISS = 1e-4
SMALL = 16
ORDERS = 8
SLICE_BYTES = 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def collection_size(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Least m for which both collections hold an equal key with a chance of at least 1 - miss."""
    one = 1 - (percent / 100) ** rows
    return max(1, math.ceil(math.log(miss / 2) / math.log(one))) if one > 0 else 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words begin (and the end), and a 64-bit hash of every word."""
    offsets, place, words = word_codes(pc.ascii_lower(texts))
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, word_bytes(words)), np.uint64, len(words))
    return offsets, one[place]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    offsets, words = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(width):
        whole = mixed(whole * MIX + words[k:k + n])
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        if b - a >= width:
            yield np.unique(whole[a:b - width + 1])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = mixed(x * MIX + words[k])
            yield mixed(x + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def digest_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def band_keys(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray, rows: int) -> np.ndarray:
    """One key for each `rows` MinHash values of a set."""
    least = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096]
        np.minimum(least, (part[None, :] * mult[:, None] + add[:, None]).min(axis=1), out=least)
    key = np.zeros(len(mult) // rows, np.uint64)
    for r in range(rows):
        key = mixed(key * MIX + least[r::rows])
    return key


def sketches(docs: DataFrame, width: int, m: int, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, digest of the set and its 2 * m band keys."""
    draw = np.random.default_rng(seed)
    mult = draw.integers(0, 1 << 63, 2 * m * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, 2 * m * rows, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, 1, SLICE_BYTES):
                sizes, digests, keys = [], [], []
                for s in shingle_sets(texts, width):
                    sizes.append(len(s))
                    digests.append(digest_of(s))
                    keys.append(band_keys(s, mult, add, rows).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)), batch.column(2).slice(start, len(texts)), pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "digest", "keys"])

    rows_ = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return in_arrow(rows_, run, "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """digest, shingles: the whole set of each document that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, 1, SLICE_BYTES):
                sets = [s for s in shingle_sets(texts, width) if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(map(digest_of, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    return in_arrow(docs.select("doc_id", "text"), run, "digest binary, shingles array<long>")


def table_rows(reps: DataFrame, m: int, scratch: Scratch) -> DataFrame:
    """key, rep, n: the tables a representative is in, with keys (a_i, b_j) of values that others share."""
    subs = reps.select("rep", "n", F.posexplode("keys").alias("place", "sub"))
    shared = subs.groupBy("place", "sub").agg(F.count("*").alias("c")).filter("c > 1").select("place", "sub")
    held = scratch.cut(subs.join(shared, ["place", "sub"], "left_semi"), "subkeys")
    one = F.when(F.col("place") < m, F.struct("place", "sub"))
    two = F.when(F.col("place") >= m, F.struct("place", "sub"))
    both = held.groupBy("rep", "n").agg(F.collect_list(one).alias("a"), F.collect_list(two).alias("b"))  # at most m each
    tables = both.select("rep", "n", F.explode("a").alias("a"), "b").select("rep", "n", "a", F.explode("b").alias("b"))
    return tables.select(F.xxhash64("a.place", "a.sub", "b.place", "b.sub").alias("key"), "rep", "n")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u > v) whose whole sets are alike enough. Both joins are sort-merge joins of which Spark splits
    the partitions of a set with many partners; sets are unique, so a split repeats one row."""
    one = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su"))
    two = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(one, "u").join(two, "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.withColumn("both", shared).filter(
        F.col("both") * 100 >= (F.size("su") + F.size("sv") - F.col("both")) * percent).select("u", "v")


def close_sizes(one: str, two: str, percent: int):
    return F.least(one, two) * 100 >= F.greatest(one, two) * percent


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node that edges (u, v) reach, for each node of an edge.

    Large-star and small-star steps in turn until nothing changes; every step is grouped minima and a join.
    """
    now = scratch.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = scratch.cut(small.filter("u != v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def as_links(label: DataFrame) -> DataFrame:
    return label.select(F.col("node").alias("u"), F.col("label").alias("v"))


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: members of different classes that share one of the rarest shingles a link must share."""
    shingles = members.join(sets, "rep").select("rep", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rare = shingles.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    order = W.Window.partitionBy("rep").orderBy("df", "s")
    ranked = shingles.join(rare, "s", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("k", F.row_number().over(order))
    prefix = ranked.filter((F.col("k") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1))
    whole = prefix.groupBy("rep", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s", "k"))).alias("p"))
    prefix = whole.select("rep", "label", "n", F.col("p.s").alias("p"), F.explode("p").alias("at")).select("*", "at.s", "at.k")
    left = prefix.select("s", F.col("rep").alias("u"), F.col("label").alias("lu"), F.col("n").alias("nu"), F.col("p").alias("pu"), F.col("k").alias("ku"))
    right = prefix.select("s", F.col("rep").alias("v"), F.col("label").alias("lv"), F.col("n").alias("nv"), F.col("p").alias("pv"), F.col("k").alias("kv"))
    first = F.get(F.array_intersect("pu", "pv"), F.lit(0)) == F.col("s")  # each pair at its rarest shared shingle only
    rest = F.least(F.col("nu") - F.col("ku"), F.col("nv") - F.col("kv")) + 1  # rarer ones are in one of the two only
    enough = rest * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent
    return left.join(right, "s").filter(
        (F.col("u") > F.col("v")) & (F.col("lu") != F.col("lv")) & close_sizes("nu", "nv", percent) & enough & first).select("u", "v").distinct()


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with the class of each representative."""
    return rows.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def small_unresolved(small: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of buckets whose members are in different classes, with their class."""
    classed = scratch.cut(labelled(small, label), "classed")
    mixed_up = classed.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1").select("key")
    return scratch.cut(classed.join(mixed_up, "key", "left_semi"), "unresolved")


def large_unresolved(large: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, n, v, label: the members of large buckets, by their heads v, under which there are different classes."""
    classed = scratch.cut(labelled(large, label), "classed")
    mixed_up = classed.groupBy("v").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1").select("v")
    return scratch.cut(classed.join(mixed_up, "v", "left_semi"), "unresolved")


def more_heads(left: DataFrame, percent: int, orders: int = ORDERS) -> DataFrame:
    """u, v: members of large buckets with those of the same head that come first in a few random orders."""
    heads = left.groupBy("v").agg(F.array(*[
        F.min_by(F.struct("rep", "n", "label"), F.xxhash64("rep", F.lit(k))) for k in range(orders)]).alias("h"))
    heads = heads.select("v", F.explode(F.array_distinct("h")).alias("h"))
    pairs = left.join(heads, "v").filter((F.col("label") != F.col("h.label")) & close_sizes("n", "h.n", percent))
    return pairs.select(F.greatest("rep", "h.rep").alias("u"), F.least("rep", "h.rep").alias("v")).distinct()


def representatives(some: DataFrame, scratch: Scratch) -> DataFrame:
    """digest, node, first: a number for each different set and the smallest doc_id that has it.

    The number is that doc_id, or a hash of the set where several sets have the same smallest doc_id.
    """
    first = scratch.cut(some.groupBy("digest").agg(F.min("doc_id").alias("first")), "first")
    again = first.groupBy("first").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("first").alias("again"))
    node = F.when(F.col("again").isNull(), F.col("first")).otherwise(F.xxhash64("digest"))
    return scratch.cut(first.join(again, F.col("first") == F.col("again"), "left").select("digest", node.alias("node"), "first"), "representatives")


def classes(docs: DataFrame, width: int, percent: int, rows: int = ROWS, m: int | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (null without shingles) and component_id, for each row of docs."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    m = m or collection_size(percent, rows)
    found = scratch.cut(sketches(docs, width, m, rows), "sketches")
    some = found.filter("digest is not null and doc_id is not null")
    same = representatives(some, scratch)
    nodes = same.select("digest", F.col("node").alias("rep"), "first")
    one = some.join(nodes, "digest").filter("doc_id = first").select("rep", F.col("n_shingles").alias("n"), "keys").dropDuplicates(["rep"])
    rows_ = scratch.cut(table_rows(one, m, scratch), "tables")

    heads = rows_.groupBy("key").agg(F.min("rep").alias("v"), F.min_by("n", "rep").alias("nv"), F.count("*").alias("c")).filter("c > 1")
    heads = scratch.cut(heads, "heads")
    members = scratch.cut(rows_.join(heads, "key"), "members")  # of buckets with others
    scratch.drop(rows_, heads)
    wanted = members.select("rep").distinct().join(nodes, "rep")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    whole = full_sets(texts, width).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = scratch.cut(whole.join(wanted, "digest").select("rep", "shingles"), "sets")

    star = members.filter((F.col("rep") != F.col("v")) & close_sizes("n", "nv", percent)).select(F.col("rep").alias("u"), "v").distinct()
    links = scratch.cut(confirmed(star, sets, percent), "links")
    label = scratch.cut(components(links, scratch), "labels")

    large = scratch.cut(members.filter(F.col("c") > SMALL).select("rep", "n", "v").distinct(), "large")
    left = large_unresolved(large, label, scratch)
    again = scratch.cut(confirmed(more_heads(left, percent), sets, percent), "again")
    if not again.isEmpty():
        label = scratch.cut(components(as_links(label).union(again), scratch), "labels")
        left = large_unresolved(large, label, scratch)
    few = small_unresolved(members.filter(F.col("c") <= SMALL), label, scratch)
    two = few.select("key", F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu"), F.col("v").alias("head"))
    pairs = two.join(few.select("key", F.col("rep").alias("w"), F.col("n").alias("nw"), F.col("label").alias("lw")), "key").filter(
        (F.col("u") > F.col("w")) & (F.col("w") != F.col("head")) & (F.col("lu") != F.col("lw")) & close_sizes("nu", "nw", percent))
    more = pairs.select("u", F.col("w").alias("v"))
    many = left.select("rep", "label").distinct()
    if not many.isEmpty():
        more = more.union(prefix_pairs(scratch.cut(many, "many"), sets, percent))
    more = scratch.cut(confirmed(more.distinct(), sets, percent), "more")
    if not more.isEmpty():
        label = scratch.cut(components(as_links(label).union(more), scratch), "labels")

    of = scratch.cut(labelled(nodes, label), "classes")
    least = of.groupBy("label").agg(F.min("first").alias("component"))
    of = scratch.cut(of.join(least, "label").select("digest", F.col("label").alias("class"), "component"), "classes")
    scratch.keep(found, of)
    linked = found.filter("digest is not null").select("doc_id", "text_hash", "n_shingles", "digest").join(of, "digest")
    linked = linked.filter("doc_id is not null").select("doc_id", "text_hash", "n_shingles", "class", F.col("component").alias("component_id"))
    alone = found.filter("digest is null or doc_id is null").select(
        "doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, m: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the class) and kept for each document."""
    return classes(docs, width, percent, rows, m).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each class, that with the smallest doc_id; rows without doc_id stay.

    Of rows with equal doc_id and text one stays, that with the least hash of all columns; so does, of different
    texts of the smallest doc_id in one class, that with the least hash.
    """
    found = classes(docs, width, percent).filter("doc_id is not null and doc_id = component_id")
    in_class = found.filter("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("w"))
    wanted = in_class.select("w.*").union(found.filter("class is null").select("doc_id", "text_hash").distinct())
    wanted = wanted.toDF("id", "hash")
    rows = docs.filter("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"id": F.col("row.doc_id").cast("long"), "hash": F.xxhash64(F.col("row.text").cast("string"))})
    rows = rows.join(wanted, ["id", "hash"], "left_semi")  # dealt by the same two columns as the groups below
    plain = [F.col(f"row.`{f.name}`") if not isinstance(f.dataType, (T.MapType, T.VariantType)) else F.to_json(F.struct(f"row.`{f.name}`"))
             for f in docs.schema.fields if f.name != "text"]
    one = rows.groupBy("id", "hash").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return one.select("row.*").union(docs.filter("doc_id is null"))
