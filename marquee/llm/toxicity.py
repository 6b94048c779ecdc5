"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all ordered thresholds t_0 < t_1 < ...;
the expected severity is the sum of these chances. Features are words (letters, lower-cased) and word
beginnings of some lengths; x is ln(1 + count).

Training uses at most `sample` different (doc_id, label) rows, those with the least hash of doc_id. Features are
the FEATURES ones in at least SUPPORT texts of the sample whose share differs most between the lowest label and
the others (chi-square). Labels of 0 and 1 only are graded by cues, features whose log odds exceed ODDS: documents
of label 1 with at most the median number of cues are grade 1, the others grade 2. Other labels are taken as they
are: grade k is the k-th different label of the sample, from 0.

Defined cases: null and empty texts have no features and get the severity of the thresholds alone; without
two different labels every severity is 0; repeated rows are scored alike, repeated label rows count once; an empty table gives an empty
result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, text_slices

SAMPLE = 10_000
FEATURES = 1_000
SUPPORT = 8
STEMS = (4, 6)
ODDS = 3.0
STEPS = 500
RIDGE = 1e-5
SLICE_BYTES = 1 << 22
#: Marks below U+0080 and digits become blanks before words are split.
BLANK = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's words begin, each word's place among the different ones, and these."""
    from .common import word_codes

    data = pc.utf8_lower(texts).cast(pa.binary())
    none, ends, values = data.buffers()
    blanked = pa.py_buffer(values.to_pybytes().translate(BLANK)) if values else values
    offsets, place, words = word_codes(pa.Array.from_buffers(pa.string(), len(data), [none, ends, blanked], offset=data.offset))
    return offsets, place, words.to_pylist()


def features_of(word: str) -> list[str]:
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


class Model:
    """Weights of features and ordered thresholds."""

    def __init__(self, names: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.place = {n: k for k, n in enumerate(names)}
        self.weights, self.cuts = weights, cuts

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, count) triples of the features that occur."""
        offsets, place, words = words_in(texts)
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        pairs = []
        for part in range(1 + len(STEMS)):
            of = np.array([self.place.get(f[part], -1) if part < len(f := features_of(w)) else -1 for w in words] or [-1], np.int64)
            got = of[place]
            hit = got >= 0
            pairs.append(rows[hit] * len(self.weights) + got[hit])
        both, counts = np.unique(np.concatenate(pairs), return_counts=True)
        size = max(1, len(self.weights))
        return both // size, both % size, counts

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))

    def severity(self, texts: pa.Array) -> np.ndarray:
        row, feature, count = self.counted(texts)
        score = np.bincount(row, self.weights[feature] * np.log1p(count), len(texts)) if len(row) else np.zeros(len(texts))
        return self.above(score)


def fit(rows: np.ndarray, features: np.ndarray, counts: np.ndarray, grades: np.ndarray, names: list[str]) -> Model:
    """Maximum likelihood with a ridge, by gradient steps scaled per parameter (Adam), all rows at once."""
    x, n, top = np.log1p(counts), len(grades), int(grades.max())
    rates = np.array([(grades > k).mean() for k in range(top)]).clip(1e-6, 1 - 1e-6)
    first = np.log((1 - rates) / rates)
    theta = np.concatenate([np.zeros(len(names)), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    moment, square, size = np.zeros_like(theta), np.zeros_like(theta), len(names)

    def cuts_of(t: np.ndarray) -> np.ndarray:
        return np.concatenate([t[size:size + 1], t[size] + np.cumsum(np.exp(t[size + 1:]))])

    for step in range(1, STEPS + 1):
        w, cuts = theta[:size], cuts_of(theta)
        score = np.bincount(rows, w[features] * x, n)
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -500, 500)))  # P(grade > k)
        full = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        own = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
        by_score = (slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / own
        by_cut = np.zeros((n, top))
        for k in range(top):
            by_cut[:, k] = (np.where(grades == k, slope[:, k + 1], 0) - np.where(grades == k + 1, slope[:, k + 1], 0)) / own
        cut_sum = by_cut.sum(axis=0)
        tail = np.array([cut_sum[k:].sum() for k in range(top)])
        tail[1:] *= np.exp(theta[size + 1:])
        gradient = -np.concatenate([np.bincount(features, by_score[rows] * x, size), tail]) / n
        gradient[:size] += RIDGE * w
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        theta -= 0.1 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Model(names, theta[:size], cuts_of(theta))


def chosen_features(train: DataFrame, lowest: int) -> dict[str, float]:
    """The features told apart best, with their log odds; `train` has text and a label above `lowest` for toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[Counter, Counter] = Counter(), Counter()
            for start, texts in text_slices(batch, 0, SLICE_BYTES):
                offsets, place, words = words_in(texts)
                kinds = [features_of(w) for w in words]
                for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist()), start):
                    held[int(batch.column(1)[k].as_py() > lowest)].update({f for w in set(place[a:b].tolist()) for f in kinds[w]})
            names = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.string()), pa.array([held[0][f] for f in names], pa.int64()),
                pa.array([held[1][f] for f in names], pa.int64())], names=["feature", "clean", "toxic"])

    sums = in_arrow(train.select("text", "label"), run, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= SUPPORT)
    n = {bool(r["t"]): r["n"] for r in train.groupBy((F.col("label") > lowest).alias("t")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    apart = F.pow(F.col("toxic") / toxic - F.col("clean") / clean, 2) / (share * (1 - share) + 1e-9)
    top = sums.select("feature", odds.alias("odds"), apart.alias("apart")).orderBy(F.desc("apart"), "feature").limit(FEATURES)
    return {r["feature"]: r["odds"] for r in top.collect()}


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from (doc_id, label) rows; None unless there are two grades.

    To the driver go the chosen features and their counts in the sample, both of bounded size.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    some = labels.filter("doc_id is not null and label is not null").select(
        F.col("doc_id").cast("long"), F.col("label").cast("int")).distinct().withColumn("hash", F.xxhash64("doc_id"))
    some = some.orderBy("hash", "doc_id", "label").limit(sample).select(F.col("doc_id").alias("labelled"), "label")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    train = scratch.cut(texts.join(F.broadcast(some), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "label"), "train")
    lowest, highest = train.agg(F.min("label"), F.max("label")).first()
    if lowest == highest:
        return None
    odds = chosen_features(train, lowest)
    names = sorted(odds)
    blank = Model(names, np.zeros(len(names)), np.zeros(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in text_slices(batch, 1, SLICE_BYTES):
                row, feature, count = blank.counted(part)
                found: list[list] = [[] for _ in range(len(part))]
                for k, f, c in zip(row.tolist(), feature.tolist(), count.tolist()):
                    found[k] += f, c
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(part)), batch.column(2).slice(start, len(part)),
                    pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "label", "found"])

    got = in_arrow(train.select("doc_id", "text", "label"), run, "doc_id long, label int, found array<long>")
    held = sorted(got.toLocalIterator(), key=lambda r: (r["doc_id"], r["label"], r["found"]))
    grades = np.array([r["label"] for r in held])
    if lowest == 0 and highest == 1:
        cue = np.array([odds[n] > ODDS for n in names])
        cues = np.array([sum(c for f, c in zip(r["found"][::2], r["found"][1::2]) if cue[f]) for r in held])
        grades = np.where((grades == 1) & (cues > np.median(cues[grades == 1])), 2, grades)
    rows = np.repeat(np.arange(len(held)), [len(r["found"]) // 2 for r in held])
    flat = np.array([x for r in held for x in r["found"]], np.int64).reshape(-1, 2)
    _, grades = np.unique(grades, return_inverse=True)
    return fit(rows, flat[:, 0], flat[:, 1], grades, names)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, severity (expected grade), toxic_chance (of any grade above 0) and toxic for each document."""
    table = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        for batch in batches:
            for start, texts in text_slices(batch, 1, SLICE_BYTES):
                above = model.severity(texts) if model else np.zeros((len(texts), 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)), pa.array(above.sum(axis=1)), pa.array(above[:, 0]),
                    pa.array(above[:, 0] >= 0.5)], names=["doc_id", "severity", "toxic_chance", "toxic"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, severity double, toxic_chance double, toxic boolean")


def severities(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labels (doc_id, label) and score every document."""
    return scored(docs, learned(docs, labels, sample))
