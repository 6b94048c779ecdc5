"""Phrases that occur together more than their parts would: counted in counting quotient filters.

Texts are cut into pieces at `BREAKS` and into words between spaces and tabs, A-Z lower-cased. A word's id is the
head of its 64-bit hash; the dictionary of all words proves that no two share one (else another seed is taken), and
its size sets the number of bits. The ids of 1 to 4 words are packed side by side and pass through an invertible
permutation (Feistel rounds), so that any word sequence becomes an evenly spread number and can be had back.

A counting quotient filter holds such numbers: the leading bits (quotient) are not stored but marked in one bit for
each value that occurs and one bit for each entry that ends a run; the rest (full remainder) is stored whole, so
counts are exact; counts take a byte, with an escape. A task counts its share into sorted filters and cuts them into
parts by the first bits; the filters of a part are merged, sorted as they are, into the counts over all rows.

A phrase of n words that occurs `least` times consists of phrases of n - 1 words that do. Those of each length are
marked in a bitmap of PRUNE_BITS, which is all that is broadcast: a bit that is set by chance costs a needless
counter, never a phrase.

Defined cases: null texts are empty; a null lang is "und"; repeated rows count again; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, in_arrow, text_slices

LEAST = 30
LONGEST = 4
TOP = 2000
SLICE_BYTES = 1 << 23
PRUNE_BITS = 1 << 26
#: Counters that a task merges at once, and those after which it hands its filters on.
PENDING, HELD = 1_000_000, 2_000_000
#: Rows of a filter's part are dealt by so many leading bits; more for corpora beyond 2 ** 33 words.
PART_BITS, MORE_PART_BITS, MANY_WORDS = 8, 16, 1 << 33
#: Lower-cases A-Z, turns what ends a piece into a line feed and a tab into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
HEAD = struct.Struct("<BBBBQ")
ROUNDS = 3
MASK = (1 << 64) - 1


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(lanes: list[np.ndarray], bits: int, back: bool = False) -> list[np.ndarray]:
    """Word ids of `bits` bits, one array for each place, as the lanes of one permuted number (or back).

    Each step changes one lane by a function of the others alone, so the same steps in reverse undo it.
    """
    lanes = [x.copy() for x in lanes]
    mask = np.uint64((1 << bits) - 1)
    steps = [(r, k) for r in range(ROUNDS) for k in range(len(lanes) - 1, -1, -1)]
    for r, k in reversed(steps) if back else steps:
        seen = np.full(len(lanes[0]), (r * 16 + k + 1) * 0x632BE59BD9B4E019 & MASK, np.uint64)
        for j, other in enumerate(lanes):
            if j != k:
                seen = scrambled(seen + other * np.uint64(2 * j + 3))
        lanes[k] ^= (scrambled(seen) >> np.uint64(64 - bits)) & mask
    return lanes


def in_order(lanes: list[np.ndarray], bits: int) -> np.ndarray:
    """The order of permuted numbers; 64 leading bits nearly always decide."""
    key = lanes[0] << np.uint64(64 - bits)
    if len(lanes) > 1 and bits < 64:
        spare = 64 - bits
        key |= lanes[1] >> np.uint64(bits - spare) if bits > spare else lanes[1] << np.uint64(spare - bits)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if any((x[order[same + 1]] != x[order[same]]).any() for x in lanes):
        return np.lexsort(lanes[::-1])
    return order


class CountingFilter:
    """Sorted permuted numbers with their counts."""

    def __init__(self, lanes: list[np.ndarray], counts: np.ndarray, bits: int):
        self.lanes, self.counts, self.bits = lanes, counts, bits

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def merged(cls, filters: list[CountingFilter], bits: int) -> CountingFilter:
        """One filter with the sums of all counts."""
        if len(filters) == 1:
            return filters[0]
        lanes = [np.concatenate(x) for x in zip(*[f.lanes for f in filters])]
        order = in_order(lanes, bits)
        lanes = [x[order] for x in lanes]
        counts = np.concatenate([f.counts for f in filters])[order]
        new = np.ones(len(counts), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in lanes])
        first = np.flatnonzero(new)
        return cls([x[first] for x in lanes], np.add.reduceat(counts, first) if len(first) else counts, bits)

    @classmethod
    def of(cls, words: list[np.ndarray], counts: np.ndarray, bits: int) -> CountingFilter:
        """The filter of different phrases, given the ids at each place."""
        lanes = permuted(words, bits)
        order = in_order(lanes, bits)
        return cls([x[order] for x in lanes], counts[order].astype(np.int64), bits)

    def parts(self, part_bits: int) -> Iterator[tuple[int, CountingFilter]]:
        place = self.lanes[0] >> np.uint64(self.bits - part_bits)
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
        for a, b in zip(cuts, [*cuts[1:], len(place)]):
            yield int(place[a]), CountingFilter([x[a:b] for x in self.lanes], self.counts[a:b], self.bits)

    def to_bytes(self, part_bits: int) -> bytes:
        """The filter of one part. Head; occupied quotients and run ends, a bit each; remainders; counts."""
        m, width = len(self), self.bits // 8
        quotient_bits = 0
        while quotient_bits + 8 <= self.bits - part_bits - 8 and (1 << quotient_bits + 8) <= 4 * m:
            quotient_bits += 8
        skip = (part_bits + quotient_bits) // 8  # leading bytes that are not stored
        quotient = (self.lanes[0] >> np.uint64(self.bits - part_bits - quotient_bits)) & np.uint64((1 << quotient_bits) - 1)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotient] = True
        ends = np.ones(m, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        kept = [x.astype(">u8").view(np.uint8).reshape(m, 8)[:, 8 - width + (skip if k == 0 else 0):] for k, x in enumerate(self.lanes)]
        small = np.minimum(self.counts, 255).astype(np.uint8)
        large = self.counts[small == 255].astype("<i8")
        return b"".join([
            HEAD.pack(len(self.lanes), self.bits, part_bits, quotient_bits, m), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
            np.hstack(kept).tobytes(), small.tobytes(), large.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes, part: int) -> CountingFilter:
        n, bits, part_bits, quotient_bits, m = HEAD.unpack_from(data)
        width, skip, at = bits // 8, (part_bits + quotient_bits) // 8, HEAD.size

        def read(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.flatnonzero(np.unpackbits(read(-(-(1 << quotient_bits) // 8)))[:1 << quotient_bits])
        ends = np.unpackbits(read(-(-m // 8)))[:m].astype(np.int64)
        quotient = occupied[np.cumsum(ends) - ends].astype(np.uint64)
        kept = read(m * (n * width - skip)).reshape(m, n * width - skip)
        lanes, col = [], 0
        for k in range(n):
            size = width - (skip if k == 0 else 0)
            whole = np.zeros((m, 8), np.uint8)
            whole[:, 8 - size:] = kept[:, col:col + size]
            lanes.append(whole.reshape(-1).view(">u8").astype(np.uint64))
            col += size
        head = np.uint64(part << quotient_bits) | quotient
        lanes[0] |= head << np.uint64(bits - part_bits - quotient_bits)
        counts = read(m).astype(np.int64)
        large = counts == 255
        counts[large] = read(8 * int(large.sum())).view("<i8")
        return cls(lanes, counts, bits)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For the words of all texts: whether a piece begins there, the place among the different ones, and these."""
    data = b"\n".join(texts).translate(FOLD)
    chars = np.frombuffer(data, np.uint8)
    if not len(chars):
        return np.zeros(0, bool), np.zeros(0, np.int32), pa.array([], pa.string())
    lines = chars == 10
    inside = ~lines & (chars != 32)
    begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    sizes = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1 - begin
    line = np.cumsum(lines, dtype=np.int32)[begin]
    breaks = np.concatenate([[True], line[1:] != line[:-1]])[:len(begin)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(chars[inside])]).dictionary_encode()
    return breaks, words.indices.to_numpy().astype(np.int32), words.dictionary


def coded_texts(docs: DataFrame) -> DataFrame:
    """lang, codes (2 * place of each word, plus 1 where a piece begins), words and counts of the different ones, by slices."""
    names = ["lang", "codes", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.filter(pa.array(langs.indices.to_numpy() == k))
                for _, texts in text_slices(own, 1, SLICE_BYTES):
                    breaks, place, words = word_codes(texts.cast(pa.binary()).to_pylist())
                    counts = np.bincount(place, minlength=len(words))
                    codes = (place * 2 + breaks).astype("<i4").tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang]), pa.array([codes], pa.binary()), pa.array([words.to_pylist()], pa.list_(pa.string())),
                        pa.array([counts], pa.list_(pa.int64()))], names=names)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows.filter("text is not null"), run, "lang string, codes binary, words array<string>, counts array<long>")


def word_ids(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int, int]:
    """(word, id) of the different words, their number, the seed and the bits for which no two share an id."""
    unique = scratch.cut(words.select("word").distinct(), "dictionary")
    size = unique.count()
    bits = min(64, max(24, 8 * -(-(2 * size.bit_length() + 4) // 8)))
    for seed in range(100):
        ids = unique.select("word", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "word"), 64 - bits).alias("id"))
        if ids.groupBy("id").count().filter("count > 1").isEmpty():
            start = words.sparkSession.range(1).select(F.xxhash64(F.lit(seed))).first()[0]
            return ids, size, start & MASK, bits
    raise ValueError("no seed tells all words apart")


def slots(lang: str, lanes: list[np.ndarray]) -> np.ndarray:
    """The bit of the bitmap for each phrase."""
    x = np.full(len(lanes[0]), xxhash.xxh3_64_intdigest(lang), np.uint64)
    for lane in lanes:
        x = scrambled(x + lane)
    return x % np.uint64(PRUNE_BITS)


def bitmap_of(grams: DataFrame) -> np.ndarray:
    """The marked bits of frequent phrases (lang, ids), packed; at most PRUNE_BITS / 64 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.append(slots(lang, [np.array([x], np.int64).view(np.uint64) for x in ids]))
            at = np.concatenate(found)
            bit = (np.uint64(1) << (at % np.uint64(64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(64)).astype(np.int64)), pa.array(bit)], names=["at", "bit"])

    rows = in_arrow(grams.select("lang", "ids"), run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(PRUNE_BITS // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at // np.uint64(64)] >> (at % np.uint64(64)) & np.uint64(1)).astype(bool)


def phrases_in(lang: str, codes: np.ndarray, ids: np.ndarray, n: int, bitmaps: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The ids at each place of the different phrases of n words whose shorter ones are all marked, and their counts."""
    place, linked = (codes >> 1).astype(np.int64), (codes & 1) == 0
    lanes = [ids]
    index, at = place, np.arange(len(place))  # the phrase that begins at each place of `at`
    for size in range(2, n + 1):
        good = marked(bitmaps[size - 2], slots(lang, lanes))[index]
        keep = np.zeros(len(place) + 1, bool)  # places where a marked phrase of size - 1 words begins
        keep[at[good]] = True
        last = at + size - 1
        ok = good & keep[at + 1] & (last < len(place))
        ok[ok] = linked[last[ok]]
        index, at = index[ok], at[ok]
        key = index * len(ids) + place[at + size - 1]
        key, index, counts = np.unique(key, return_inverse=True, return_counts=True)
        head, tail = key // len(ids), key % len(ids)
        lanes = [x[head] for x in lanes] + [ids[tail]]
    return lanes, counts


def counted(coded: DataFrame, n: int, bitmaps: list, seed: int, bits: int, part_bits: int, least: int) -> DataFrame:
    """lang, ids and f of the phrases of n words that occur `least` times or more, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [b.value for b in bitmaps]
        held: dict[str, list[CountingFilter]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            whole = CountingFilter.merged(held.pop(lang), bits)
            parts = [(lang, p, f.to_bytes(part_bits)) for p, f in whole.parts(part_bits)]
            columns = list(zip(*parts)) or [[], [], []]
            return pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["lang", "part", "filter"])

        for batch in batches:
            for lang, codes, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = words.values.cast(pa.binary()).to_pylist()
                ids = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in text), np.uint64, len(text)) >> np.uint64(64 - bits)
                lanes, counts = phrases_in(lang, np.frombuffer(codes.as_py(), "<i4"), ids, n, maps)
                own = held.setdefault(lang, [])
                own.append(CountingFilter.of(lanes, counts, bits))
                if sum(map(len, own)) > PENDING:
                    own[:] = [CountingFilter.merged(own, bits)]
                if sum(len(f) for fs in held.values() for f in fs) > HELD:
                    for other in list(held):
                        yield rows(other)
        for lang in list(held):
            yield rows(lang)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending = None, []

        def rows() -> pa.RecordBatch:
            whole = CountingFilter.merged(pending, bits)
            often = whole.counts >= least
            ids = np.stack([x.view(np.int64) for x in permuted([x[often] for x in whole.lanes], bits, back=True)], axis=1)
            return pa.RecordBatch.from_arrays([
                pa.array([key[1]] * len(ids), pa.string()), pa.FixedSizeListArray.from_arrays(pa.array(ids.reshape(-1)), n).cast(pa.list_(pa.int64())),
                pa.array(whole.counts[often])], names=["lang", "ids", "f"])

        for batch in batches:
            for part, lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != (part, lang):
                    if pending:
                        yield rows()
                    key, pending = (part, lang), []
                pending.append(CountingFilter.from_bytes(data.as_py(), part))
                if sum(map(len, pending)) > max(PENDING, 2 * len(pending[0])):
                    pending[:] = [CountingFilter.merged(pending, bits)]
        if pending:
            yield rows()

    filters = in_arrow(coded.select("lang", "codes", "words"), count, "lang string, part int, filter binary")
    dealt = filters.select("part", "lang", "filter").repartition("part", "lang").sortWithinPartitions("part", "lang")
    return in_arrow(dealt, merge, "lang string, ids array<long>, f long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, ids, f) of all phrases up to `longest` words that occur often enough in their lang, (id, word) and (lang, n words)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    coded = scratch.cut(coded_texts(docs), "coded", "zstd")
    words = coded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(
        F.sum("w.counts").alias("f"))
    words = scratch.cut(words, "words")
    ids, _, seed, bits = word_ids(words, scratch)
    totals = scratch.cut(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    everything = totals.agg(F.sum("n")).first()[0] or 0
    part_bits = PART_BITS if everything < MANY_WORDS else MORE_PART_BITS
    often = words.filter(F.col("f") >= least).join(ids, "word")
    found = [scratch.cut(often.select("lang", F.array("id").alias("ids"), "f"), "grams")]
    names = scratch.cut(often.select("id", "word").distinct(), "names")
    bitmaps: list = []
    for n in range(2, longest + 1):
        bitmaps.append(spark.sparkContext.broadcast(bitmap_of(found[-1])))
        found.append(scratch.cut(counted(coded, n, bitmaps, seed, bits, part_bits, least), "grams"))
    for b in bitmaps:
        b.unpersist()
    scratch.drop(coded)
    out = found[0]
    for grams in found[1:]:
        out = out.union(grams)
    return out, names, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, within: int = 80, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each lang.

    A phrase of two words or more with frequency a is cut after each word; l and r are the frequencies of the two
    parts, and the cut with the least floor(scale * a / (l + r)) counts (then the first). A phrase that lies in a
    longer one of at least `within` percent of its frequency is left out.
    """
    grams, names, totals = frequent_phrases(docs, least, longest)
    scratch = Scratch(docs.sparkSession, "collocations")
    size = F.size("ids")
    phrases = grams.filter(size > 1)
    cuts = phrases.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("one"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("two"))
    part = lambda ids, f: grams.select("lang", F.col("ids").alias(ids), F.col("f").alias(f))
    score = F.expr(f"(cast(a as decimal(25,0)) * {scale}) div (cast(l as decimal(25,0)) + r)").cast("long")
    scored = cuts.join(part("one", "l"), ["lang", "one"]).join(part("two", "r"), ["lang", "two"]).withColumn("score", score)
    best = scored.groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("ids", s, m)))
    inside = phrases.filter(size > 2).select("lang", "f", F.explode(F.array_distinct(F.flatten(inner))).alias("ids"))
    longer = inside.groupBy("lang", "ids").agg(F.max("f").alias("f"))
    big = lambda c: F.col(c).cast("decimal(25,0)")
    covered = F.coalesce(big("f") * 100 >= big("a") * within, F.lit(False))
    kept = scratch.cut(best.join(longer, ["lang", "ids"], "left").filter(~covered).select("lang", "ids", "a", "cut.*"), "kept")
    spelled = kept.select("lang", "ids", F.posexplode("ids").alias("place", "id")).join(names, "id").groupBy("lang", "ids").agg(
        F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    rows = kept.join(spelled, ["lang", "ids"]).select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "score")
    order = W.Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
