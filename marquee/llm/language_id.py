"""Language of a text by rank-order profiles.

A text's letters are lower-cased; runs of letters are words with a blank on either side. Its n-grams of
one to three letters (blanks only at an end) are ranked by count, then by code; the first `top` make its
profile, and those of a language's training texts the language's. The out-of-place distance adds, for each
n-gram of the text, how far its ranks lie apart, or `top` if the language lacks it. The nearest language
wins (the smaller name on ties); the score is 1 - distance / (n-grams * top).

Profiles are learned from at most `per_language` labelled texts of each language, those with the least
hash of doc_id; predictions look at the text alone, all of it.

Defined cases: null texts and texts without letters are "und" with score 0, and so is everything if nothing
could be learned; an empty table gives an empty result; columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import in_arrow, text_slices

TOP = 300
PER_LANGUAGE = 2000
SLICE_BYTES = 1 << 20
HELD_GRAMS = 500_000
NONE = "und"
#: The floor of a recognised text's score is this quantile of the held-out texts' scores, less the margin.
FLOOR_QUANTILE = 0.01
FLOOR_MARGIN = 0.15
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different n-gram codes and their counts for each text. A code holds three code points of 21 bits; the
    first two are 0 for one letter, the middle one is for two letters, which have the top bit set."""
    joined = "\0".join(["", *pc.utf8_lower(texts).to_pylist(), ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(pc.utf8_lower(texts)).to_numpy(zero_copy_only=False) + 1)])
    code = np.where(letters()[code], code, 0).astype(np.uint64)
    letter = code > 0
    two = (code[:-1] << np.uint64(42)) | code[1:] | np.uint64(1 << 63)
    two_ok = letter[:-1] | letter[1:]
    three = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):  # code[a] and code[b] are blanks
        grams = np.concatenate([code[a:b][letter[a:b]], two[a:b][two_ok[a:b]], three[a:b - 1][letter[a + 1:b]]])
        yield np.unique(grams, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    if len(codes) > top:
        floor = -np.partition(-counts, top - 1)[top - 1]
        keep = counts >= floor
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


def training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text of the labelled documents to learn from."""
    usable = docs.filter("text is not null and lang is not null and doc_id is not null").select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64(F.col("doc_id").cast("long")).alias("hash"))
    place = F.row_number().over(W.Window.partitionBy("lang").orderBy("hash", "doc_id"))
    first = usable.withColumn("k", place).filter(F.col("k") <= per_language)
    last = first.groupBy("lang").agg(F.max("hash").alias("last")).withColumnRenamed("lang", "of")  # one row per language
    rows = docs.filter("text is not null and lang is not null and doc_id is not null").select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("hash"))
    return rows.join(F.broadcast(last), F.col("lang") == F.col("of")).filter("hash <= last").select("lang", "text")


def profiles(train: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """Ranked n-gram codes (as signed 64-bit) of each language; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}

        def rows() -> pa.RecordBatch:
            flat = [(lang, g, n) for lang, grams in held.items() for g, n in grams.items()]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.int64()),
                pa.array([r[2] for r in flat], pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for start, texts in text_slices(batch, 1, SLICE_BYTES):
                for k, (codes, counts) in enumerate(gram_counts(texts), start):
                    grams = held.setdefault(batch.column(0)[k].as_py(), {})
                    for g, n in zip(codes.view(np.int64).tolist(), counts.tolist()):
                        grams[g] = grams.get(g, 0) + n
                if sum(map(len, held.values())) > HELD_GRAMS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    sums = in_arrow(train.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.desc("n"), F.expr("gram < 0"), "gram"))
    out: dict[str, list[int]] = {}
    for r in sums.withColumn("k", order).filter(F.col("k") <= top).orderBy("lang", "k").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predicted(docs: DataFrame, learned: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """docs with lang_pred and score; `learned` has at most `top` codes for each language."""
    langs = sorted(learned)
    codes = np.array(sorted({g for p in learned.values() for g in p}), np.int64)
    ranks = np.full((len(codes) + 1, len(langs)), -1, np.int64)  # the last row is for codes of no profile
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(codes, learned[lang]), j] = np.arange(len(learned[lang]))
    at = docs.columns.index("text")
    table = docs.sparkSession.sparkContext.broadcast((codes, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ranks = table.value
        for batch in batches:
            names, scores = [], []
            for _, texts in text_slices(batch, at, SLICE_BYTES):
                for grams, counts in gram_counts(texts):
                    if not len(grams) or not langs:
                        names.append(NONE)
                        scores.append(0.0)
                        continue
                    mine = ranked(grams, counts, top).view(np.int64)
                    place = np.searchsorted(codes, mine)
                    place[place < len(codes)] = np.where(
                        codes[place[place < len(codes)]] == mine[place < len(codes)], place[place < len(codes)], len(codes))
                    theirs = ranks[place]
                    apart = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
                    best = int(apart.argmin())
                    names.append(langs[best])
                    scores.append(1 - float(apart[best]) / (len(mine) * top))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return in_arrow(docs, run, schema)


def held_out():
    """Documents that nothing is learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each document."""
    learned = profiles(training_rows(docs.filter(~held_out()), per_language), top)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return predicted(rows, learned, top).select("doc_id", "held_out", "lang_pred", "score")


def score_floor(docs: DataFrame, learned: dict[str, list[int]], top: int = TOP) -> float:
    """Scores below it are not those of a learned language: all held-out documents whose label is found count;
    0 without any. On sf0.01 their 1 % quantile is 0.51, while texts in other languages come to 0.3."""
    rows = docs.filter(held_out()).select(F.col("lang").cast("string").alias("lang"), "text")
    found = predicted(rows, learned, top).filter("lang_pred = lang")
    low = found.agg(F.percentile_approx("score", FLOOR_QUANTILE, 10_000)).first()[0]
    return 0.0 if low is None else max(0.0, low - FLOOR_MARGIN)


def with_language(docs: DataFrame, least: float = 0.0, per_language: int = PER_LANGUAGE, top: int = TOP) -> DataFrame:
    """The rows of docs in which a language is recognised with a score of at least `least` and the floor, columns unchanged."""
    learned = profiles(training_rows(docs.filter(~held_out()), per_language), top)
    least = max(least, score_floor(docs, learned, top))
    named = predicted(docs.select(*[F.col(c).alias(f"c{k}") if c != "text" else F.col(c) for k, c in enumerate(docs.columns)]), learned, top)
    kept = named.filter((F.col("lang_pred") != NONE) & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.toDF(*docs.columns)
