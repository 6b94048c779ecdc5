"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

A text is cut before each space (a mark stands for it), with a mark before the first word. In each piece
an Aho-Corasick automaton lists the vocabulary entries that end at every character; the best score of a
path to each of the last characters, as many as the longest entry has, and its number of tokens are all that is kept. Ties and unknown characters are as
in the tokenizer: an entry replaces another only if its score is larger, those that begin earlier come
first, a character that is no entry itself costs the least score less UNKNOWN, and neighbours that are
unknown are one token, or a token per byte where the vocabulary has all byte entries.

Pieces repeat, so each process keeps the counts of those of up to SHORT characters that it has seen (at most
CACHE, then it starts anew).

Defined cases: null and empty texts have 0 tokens and score 0; repeated rows are counted alike; an empty
table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_slices, unit_codes

MARK = "▁"
UNKNOWN = 10.0
CACHE = 500_000
SHORT = 64
SLICE_BYTES = 1 << 22


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(entry, score) of a sentencepiece model, in id order."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    """Counts tokens of pieces that begin with MARK."""

    def __init__(self, entries: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for entry, score in entries:
            if entry:
                self.automaton.add_word(entry, (len(entry), score))
        self.automaton.make_automaton()
        names = {e for e, _ in entries}
        self.longest = max(map(len, names), default=1)
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in entries) - UNKNOWN
        self.single = {e for e in names if len(e) == 1}
        self.cache: dict[str, tuple[int, float]] = {}

    def count(self, piece: str) -> tuple[int, float]:
        """Tokens of the best path, and its score."""
        n = len(piece)
        width = min(n, self.longest) + 1  # of the window; the place of a character is its number modulo this
        score: list[float | None] = [0.0] + [None] * (width - 1)
        tokens, open_ = [0] * width, [False] * width  # open_: the path ends in an unknown character
        matches = self.automaton.iter(piece)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            best, at, before = None, end % width, (end - 1) % width
            ending = []
            while ahead is not None and ahead[0] == end - 1:
                ending.append(ahead[1])
                ahead = next(matches, None)
            for size, value in sorted(ending, reverse=True) if len(ending) > 1 else ending:
                begin = (end - size) % width
                if score[begin] is None:
                    continue
                total = value + score[begin]
                if best is None or total > best:
                    best, tokens[at], open_[at] = total, tokens[begin] + 1, False
            char = piece[end - 1]
            if char not in self.single and score[before] is not None:
                total = self.unknown + score[before]
                if best is None or total > best:
                    more = len(char.encode("utf-8", "surrogatepass")) if self.bytes else int(not open_[before])
                    best, tokens[at], open_[at] = total, tokens[before] + more, True
            score[at] = best
        return tokens[n % width], score[n % width]

    def counts(self, pieces: list[str]) -> list[tuple[int, float]]:
        if len(self.cache) > CACHE:
            self.cache = {}
        got = list(map(self.cache.get, pieces))
        for k, x in enumerate(got):
            if x is None:
                got[k] = self.count(MARK + pieces[k])
                if len(pieces[k]) <= SHORT:
                    self.cache[pieces[k]] = got[k]
        return got

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of texts."""
        offsets, place, pieces = unit_codes(pc.replace_substring(texts, MARK, " "))
        got = self.counts(pieces)
        tokens = np.array([t for t, _ in got] + [0], np.int64)[place]
        scores = np.array([s for _, s in got] + [0.0], np.float64)[place]
        blank = np.array([p == "" for p in pieces] + [True])[place]
        heads = offsets[:-1][blank[offsets[:-1]]]  # a text that begins with a space has no word before it
        tokens[heads], scores[heads] = 0, 0.0
        if not len(texts):
            return tokens[:0], scores[:0]
        return np.add.reduceat(tokens, offsets[:-1]), np.add.reduceat(scores, offsets[:-1])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and score of the best path for each document; `model` is a sentencepiece file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(model)
        for batch in batches:
            for start, texts in text_slices(batch, 1, SLICE_BYTES):
                tokens, scores = mine.texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(tokens), pa.array(scores)], names=["doc_id", "n_tokens", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, score double")
