"""Benchmark text in documents, found with a generalised suffix automaton of the test items.

Words are runs of 0-9, a-z (A-Z lower-cased) and characters from U+0080. One automaton over words holds
all items of a block; a document's words stream through it while the length of the longest match that
ends at each word is tracked. A match of `window` words or more is a hit and so are all its words; an item
of fewer words (but some) hits where it occurs whole.

Items are taken in blocks of at most `block_words` words (an item longer than that is a block of its own).
Tasks build the automata and write them to the shared folder; the driver hands on one at a time, as bytes, and a
task holds one. With one block the documents pass through it in one go; with more they are written once,
pass through block after block, and what each finds is put together by row.

Defined cases: null texts have no words and no hits; items that are null or have no words hit nothing; a
null item_id is listed as "null"; repeated items count once; an empty items table gives no hits.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, text_slices, word_bytes, word_codes

WINDOW = 10
BLOCK_WORDS = 1_000_000
PART_BYTES = 16 << 20
SLICE_BYTES = 1 << 22
#: Lower-cases A-Z and blanks everything below U+0080 that is not in a word.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The one automaton that this process holds, and the name of its block.
_HELD: list = []


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Automaton:
    """Suffix automaton of many word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids = sorted({i for i, w in items if w})
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        number = {i: k for k, i in enumerate(self.ids)}
        coded = [(number[i], [self.word.setdefault(w, len(self.word)) for w in words]) for i, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self.extend(last, w)
        by_size = sorted(range(len(self.next)), key=self.size.__getitem__)
        self.holder = [-1] * len(self.next)  # the state that holds the last `window` words of what a state ends with
        for state in by_size:
            if self.size[state] >= window:
                up = self.link[state]
                self.holder[state] = state if self.size[up] < window else self.holder[up]
        self.items: dict[int, set[int]] = {}  # of the state that holds a window
        self.whole: dict[int, list[tuple[int, int]]] = {}  # (words, item) where a short item ends
        self.shortest = min([window, *(len(w) for _, w in coded)])
        for item, words in coded:
            state = 0
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.items.setdefault(self.holder[state], set()).add(item)
            if len(words) < window:
                self.whole.setdefault(state, []).append((len(words), item))
        self.above = [-1] * len(self.next)  # nearest state on the way to the root where a short item ends
        if self.whole:
            for state in by_size:
                up = self.link[state]
                self.above[state] = state if state in self.whole else self.above[up] if up >= 0 else -1

    def state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        return len(self.next) - 1

    def split(self, state: int, at: int, w: int) -> int:
        """The state after `at` for the strings that end there, apart from longer ones in `state`."""
        if self.size[at] + 1 == self.size[state]:
            return state
        copy = self.state(self.size[at] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = copy
        while at >= 0 and self.next[at].get(w) == state:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def extend(self, last: int, w: int) -> int:
        there = self.next[last].get(w)
        if there is not None:
            return self.split(there, last, w)
        new, at = self.state(self.size[last] + 1, 0, {}), last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self.split(self.next[at][w], at, w)
        return new

    def scan(self, words: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Stream words through; note the first and last word of each hit, the former plus `at`."""
        state = length = 0
        following, link, size, holder = self.next, self.link, self.size, self.holder
        held: set[int] = set()
        for k, w in enumerate(words, at):
            step = following[state].get(w)
            while step is None and state:
                state = link[state]
                length = size[state]
                step = following[state].get(w)
            if step is None:
                continue
            state, length = step, length + 1
            if length >= self.window:
                held.add(holder[state])
                first = k - length + 1
                if spans and spans[-1][0] <= first <= spans[-1][1] + 1:
                    first = spans.pop()[0]
                spans.append((first, k))
            if self.whole:
                short = self.above[state]
                while short >= 0:
                    for n, item in self.whole[short]:
                        if n <= length:
                            found.add(item)
                            spans.append((k - n + 1, k))
                    up = link[short]
                    short = self.above[up] if up >= 0 else -1
        found.update(*[self.items[h] for h in held])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def hits(texts: pa.Array, automata: list[Automaton]) -> tuple[np.ndarray, dict[int, tuple[list, set[str]]]]:
    """Words of each text; merged spans and item ids of those with hits."""
    data = texts.cast(pa.binary())
    none, ends, values = data.buffers()
    folded = pa.py_buffer(values.to_pybytes().translate(FOLD)) if values else values
    folded = pa.Array.from_buffers(pa.string(), len(data), [none, ends, folded], offset=data.offset)
    offsets, place, words = word_codes(folded)
    out: dict[int, tuple[list, set[str]]] = {}
    words = word_bytes(words)
    for automaton in automata:
        if not automaton.ids:
            continue
        known = np.array([automaton.word.get(w, -1) for w in words] or [-1], np.int64)
        codes = known[place]
        cut = codes < 0
        inner = offsets[(offsets > 0) & (offsets < len(codes))]
        begins = np.zeros(len(codes) + 1, bool)  # a run of known words of one text begins or ends here
        begins[1:-1] = cut[1:] != cut[:-1]
        begins[[0, -1]] = begins[inner] = True
        edges = np.flatnonzero(begins)
        a, b = edges[:-1], edges[1:]
        good = (b - a >= automaton.shortest) & ~cut[a] if len(codes) else np.zeros(0, bool)
        rows = np.searchsorted(offsets, a[good], "right") - 1
        for k, x, y in zip(rows.tolist(), a[good].tolist(), b[good].tolist()):
            spans, found = [], set()
            automaton.scan(codes[x:y].tolist(), x - int(offsets[k]), spans, found)
            if spans:
                held = out.setdefault(k, ([], set()))
                held[0].extend(merged(spans))
                held[1].update(automaton.ids[i] for i in found)
    return np.diff(offsets), {k: (merged(s), i) for k, (s, i) in out.items()}


class Blocks:
    """Automata of the items (item_id, text), built by tasks and kept as bytes in the shared folder."""

    def __init__(self, items: DataFrame, scratch: Scratch, window: int = WINDOW, block_words: int = BLOCK_WORDS):
        self.spark = items.sparkSession
        held = scratch.cut(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").distinct(), "items")
        words = held.agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), NO_WORD), "")))).first()[0] or 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def built() -> Iterator[pa.RecordBatch]:
                data, name = pickle.dumps(Automaton(taken, window), pickle.HIGHEST_PROTOCOL), uuid.uuid4().hex
                for k, at in enumerate(range(0, len(data), PART_BYTES)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name]), pa.array([k], pa.int32()), pa.array([data[at:at + PART_BYTES]], pa.binary())], names=["block", "part", "data"])

            taken, size = [], 0
            for batch in batches:
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    mine = item_words(text)
                    if taken and size + len(mine) > block_words:
                        yield from built()
                        taken, size = [], 0
                    if mine:
                        taken.append((item, mine))
                        size += len(mine)
            if taken:
                yield from built()

        dealt = held.repartition(1 if words <= block_words else -(-words * 5 // (block_words * 4)))  # a quarter more than would do, as shares differ
        self.table = scratch.cut(in_arrow(dealt, run, "block string, part int, data binary"), "automata")
        self.names = sorted(r["block"] for r in self.table.filter("part = 0").select("block").collect())

    def sent(self, name: str):
        """A broadcast of the name and the bytes of one block's automaton."""
        parts = self.table.filter(F.col("block") == name).select("part", "data").collect()
        return self.spark.sparkContext.broadcast((name, b"".join(bytes(r["data"]) for r in sorted(parts, key=lambda r: r["part"]))))


def automaton_of(sent) -> Automaton:
    """The automaton of a broadcast block; it takes the place of the one that this process held."""
    name, data = sent.value
    if not _HELD or _HELD[0] != name:
        _HELD.clear()
        _HELD.extend([name, pickle.loads(data)])
    return _HELD[1]


SPANS = "array<struct<first long, last long>>"
SPANS_KIND = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def pairs(spans: pa.Array) -> list[list[tuple[int, int]]]:
    return [merged([(s["first"], s["last"]) for s in row or []]) for row in spans.to_pylist()]


def scanned(docs: DataFrame, sent, key: str, all_rows: bool) -> DataFrame:
    """`key`, n_words, spans and item ids of the documents (key, text) with hits in a block, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, 1, SLICE_BYTES):
                counts, found = hits(texts, [automaton_of(sent)] if sent else [])
                rows = list(range(len(texts))) if all_rows else sorted(found)
                out = [found.get(k, ([], set())) for k in rows]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)).take(pa.array(rows, pa.int64())), pa.array(counts[rows], pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in s] for s, _ in out], SPANS_KIND),
                    pa.array([sorted(i) for _, i in out], pa.list_(pa.string()))], names=[key, "n_words", "spans", "ids"])

    return in_arrow(docs.select(key, "text"), run, f"{key} long, n_words long, spans {SPANS}, ids array<string>")


def found_by_row(held: DataFrame, blocks: Blocks, scratch: Scratch, all_rows: bool) -> DataFrame:
    """_row, n_words, spans and ids over all blocks: of rows with hits, or of all rows. One block is in use at a time."""
    tables = []
    for name in blocks.names:
        sent = blocks.sent(name)
        tables.append(scratch.cut(scanned(held, sent, "_row", all_rows and not tables), "hits"))
        sent.destroy()
    union = tables[0]
    for t in tables[1:]:
        union = union.union(t)
    return union.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("ids")).alias("ids"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (first and last word) per document."""
    scratch = Scratch(docs.sparkSession, "benchmark")
    blocks = Blocks(items, scratch, window, block_words)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if len(blocks.names) > 1:
        held = scratch.cut(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
        found = found_by_row(held, blocks, scratch, True).join(held.select("_row", "doc_id"), "_row")
    else:
        found = scanned(docs, blocks.sent(blocks.names[0]) if blocks.names else None, "doc_id", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, ids = pairs(batch.column(2)), [sorted(set(i)) for i in batch.column(3).to_pylist()]
            n_hit = [sum(b - a + 1 for a, b in s) for s in spans]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()),
                pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], SPANS_KIND)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return in_arrow(found.select("doc_id", "n_words", "spans", "ids"), run,
        f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {SPANS}")


def without_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with all hit spans cut out of the text; documents of which they are more than `coverage` go.

    A space takes the place of a span. An n_chars column is set to the new length of a changed text.
    """
    scratch = Scratch(docs.sparkSession, "benchmark")
    blocks, names = Blocks(items, scratch, window, block_words), docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])
    columns, schema = docs.columns, docs.schema

    def cut(text: str, spans: list[tuple[int, int]]) -> str:
        places = [m.span() for m in WORD.finditer(text)]
        out, end = [], 0
        for a, b in spans:
            out.append(text[end:places[a][0]].rstrip())
            end = places[b][1]
        return " ".join([*out, text[end:].lstrip()]).strip()

    def run(found_in: Callable) -> Callable:
        def batches_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                changed: dict[int, str | None] = {}
                for k, count, spans, text in found_in(batch):
                    covered = sum(b - a + 1 for a, b in spans)
                    changed[k] = None if covered > coverage * count else cut(text, spans)
                batch = batch.select(range(len(columns)))
                if changed:
                    kept = [k for k in range(len(batch)) if changed.get(k, "") is not None]
                    arrays = [c.take(pa.array(kept, pa.int64())) for c in batch.columns]
                    texts = arrays[at].to_pylist()
                    arrays[at] = pa.array([changed.get(k, t) for k, t in zip(kept, texts)], batch.schema.field(at).type)
                    if chars is not None:
                        sizes = [len(changed[k]) if k in changed else x for k, x in zip(kept, arrays[chars].to_pylist())]
                        arrays[chars] = pa.array(sizes, batch.schema.field(chars).type)
                    batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
                yield batch

        return batches_run

    if len(blocks.names) > 1:
        held = scratch.cut(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
        found = found_by_row(held.select("_row", F.col(columns[at]).alias("text")), blocks, scratch, False).select(F.col("_row").alias("_of"), "n_words", "spans")
        both = held.join(found, F.col("_row") == F.col("_of"), "left").select(*columns, "n_words", "spans")

        def known(batch: pa.RecordBatch) -> Iterator[tuple]:
            counts, spans = batch.column(len(columns)), pairs(batch.column(len(columns) + 1))
            yield from ((k, counts[k].as_py(), s, batch.column(at)[k].as_py()) for k, s in enumerate(spans) if s)

        return in_arrow(both, run(known), schema).toDF(*names)
    if not blocks.names:
        return docs.toDF(*names)
    sent = blocks.sent(blocks.names[0])

    def scan(batch: pa.RecordBatch) -> Iterator[tuple]:
        for start, texts in text_slices(batch, at, SLICE_BYTES):
            counts, found = hits(texts, [automaton_of(sent)])
            yield from ((start + k, counts[k], spans, texts[k].as_py()) for k, (spans, _) in found.items())

    return in_arrow(docs, run(scan), schema).toDF(*names)
