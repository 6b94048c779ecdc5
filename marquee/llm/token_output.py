"""Token ids in files: a static range asymmetric numeral system over independent blocks.

Every text is encoded once, where it is read, and an end id is added; the ids, a quarter of the text in size, are
then put in `doc_id` order (nulls first, equal ones by a hash of the text). Tasks count ids as they encode, and the
counts of all give one frequency table, which every block shares. A block holds whole documents,
as many as fill `BLOCK_TOKENS` ids, dealt in turn over interleaved lanes; each lane is a coder of its own
with a 64-bit state and all write 32-bit words into one stream. Every `CHECKPOINT_STEPS` steps the states
and the place in the stream are kept, so that parts of a block can be decoded side by side, and a block
carries checksums of its bytes and of its ids.

Files below a folder (Parquet holds the blocks, so that Spark's committer takes care of lost executors):
  blocks   part int, pos long (ids before it in its part), n_tokens long, doc_ids, lengths, payload binary
  table    id int, freq int: shares of 2 ** bits, above 0 for each id that occurs
  parts    part int, base long: ids of all parts before it
A payload, little-endian: magic "RANS", bits u4, lanes u4, checkpoint steps u4, ids u8, words u8, crc32 of
the ids u4; for each checkpoint (the first is step 0) the place of its first word u8 and `lanes` states
u8; the words u4; crc32 of all bytes before u4.

Defined cases: null and empty texts give the end id alone; an empty table gives an empty result; columns
besides doc_id and text are not read; repeated rows are documents of their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, text_slices

END_ID = 0
SCALE_BITS = 20
LANES = 4096
BLOCK_TOKENS = 1 << 20
CHECKPOINT_STEPS = 128
UNIT_CACHE = 1_000_000
RUN, BATCH = 64, 1024
#: How byte-level vocabularies write a space.
SPACE_MARK = "\u0120"
SLICE_CHARS = 1 << 23
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIIQQI")


class UnitEncoder:
    """Encodes with a byte-level tokenizer, each different unit of the texts at hand once at most.

    Such a tokenizer never merges over a space that is followed by something else than white space, so a
    text is cut there. Only the first id of a unit holds a space: many units are encoded as one string.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = re.compile(r" (?=\S)")
        pieces = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(pieces.values()) + 1, bool)
        self.spaced[[k for p, k in pieces.items() if p.startswith(SPACE_MARK)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if len(self.spaced) <= 1 << 16 else "<u4")
        self.units = pa.array([], pa.string())  # those seen, with their ids one after another
        self.ids, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64)

    def each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings one after another, and how many are of each."""
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for k in range(0, len(strings), BATCH):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(strings[k:k + BATCH], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), self.kind, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def known(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like `after_space`, for different units; what was encoded before is looked up."""
        if len(self.units) > UNIT_CACHE:
            self.units, self.ids, self.sizes = self.units[:0], self.ids[:0], self.sizes[:0]
        new = units.filter(pc.invert(pc.is_in(units, self.units)))
        ids, sizes = self.after_space(new)
        self.units = pa.concat_arrays([self.units, new])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        at = pc.index_in(units, self.units).to_numpy().astype(np.int64)
        sizes, begin = self.sizes[at], (np.cumsum(self.sizes) - self.sizes)[at]
        shift = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[np.arange(len(shift)) + shift], sizes

    def after_space(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like `each`, of units that follow a space, begin with no white space and hold no space."""
        cuts = np.append(np.arange(0, len(units), RUN), len(units))
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), units), " ")
        ids, _ = self.each([" " + r for r in runs.to_pylist()] if len(units) else [])
        begin = np.flatnonzero(self.spaced[ids])
        if len(begin) != len(units):
            return self.each([" " + u for u in units.to_pylist()])
        return ids, np.diff(np.append(begin, len(ids)))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many are of each text."""
        docs, lists = len(texts), pc.split_pattern(texts, " ")
        coded = lists.values.dictionary_encode()
        offsets, place, units = lists.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary
        heads, total = offsets[:-1], len(units)
        inner = np.ones(len(place), bool)
        inner[heads] = False
        blank = pc.or_(pc.equal(pc.binary_length(units), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(units, 0, 1)))
        blank = blank.to_numpy(zero_copy_only=False)
        whole = np.zeros(docs, bool)  # with a token that is cut out before all others
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        odd = whole.copy()  # a space before white space is no boundary
        odd[np.searchsorted(offsets, np.flatnonzero(blank[place] & inner), "right") - 1] = True
        inner &= ~np.repeat(odd, np.diff(offsets))

        # Ids of: units after a space; the first unit of each text; what odd texts have after spaces; the end id.
        used = np.zeros(total, bool)
        used[place[inner]] = True
        ids, found = self.known(units.filter(pa.array(used)))
        sizes = np.zeros(total, np.int64)
        sizes[used] = found
        first = units.take(pa.array(place[heads])).to_pylist()
        rest: dict[str, int] = {}
        parts: dict[int, list[int]] = {}
        for k in np.flatnonzero(odd).tolist():
            text = texts[k].as_py()
            first[k], *others = [text] if whole[k] else self.cut.split(text)
            parts[k] = [rest.setdefault(" " + u, len(rest)) for u in others]
        first_ids, first_sizes = self.each(first)
        rest_ids, rest_sizes = self.each(list(rest))
        ends = np.array([] if end_id is None else [end_id], self.kind)
        flat = np.concatenate([ids, first_ids, rest_ids, ends])
        sizes = np.concatenate([sizes, first_sizes, rest_sizes, [len(ends)]])

        place[heads] = total + np.arange(docs)
        last = len(sizes) - 1
        pieces, at = [], 0
        for k, others in parts.items():
            pieces += place[at:offsets[k] + 1], total + docs + np.array(others, np.int64)
            at = offsets[k + 1]
        counts = np.diff(offsets)
        counts[list(parts)] = [1 + len(p) for p in parts.values()]
        place = np.concatenate([*pieces, place[at:]])
        order = np.full(len(place) + docs, last, np.int64)  # each text ends with the end id
        order[np.arange(len(place)) + np.repeat(np.arange(docs), counts)] = place
        lengths = sizes[order]
        shift = (np.cumsum(sizes) - sizes)[order] - (np.cumsum(lengths) - lengths)
        out = flat[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)]
        tops = np.cumsum(counts + 1) - counts - 1
        return out, np.add.reduceat(lengths, tops) if docs else lengths


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def shares(counts: np.ndarray, bits: int = SCALE_BITS) -> tuple[np.ndarray, int]:
    """Frequencies that sum to 2 ** bits, at least 1 for each id that occurs; bits grow with their number."""
    present = int((counts > 0).sum())
    bits = max(bits, present.bit_length() + 1)
    whole = 1 << bits
    if not present:
        counts = np.zeros(max(1, len(counts)), np.int64)
        counts[0] = 1
    out = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * whole)), 0).astype(np.int64)
    left = whole - int(out.sum())
    while left:
        k = int(out.argmax())
        change = left if left > 0 else -min(-left, max(1, int(out[k]) // 2))
        out[k] += change
        left -= change
    return out, bits


class Coder:
    """Codes arrays of ids against one shared table."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.shift = bits, np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol: np.ndarray | None = None

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
        n = len(ids)
        lanes = min(lanes, 1 << max(0, (-(-n // 256) - 1).bit_length()))
        steps = -(-n // lanes)
        freq, start = self.freq[ids], self.start[ids]
        limit = freq << np.uint64(63 - self.bits)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        count, kept = 0, []
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            now, f = x[:b - a], freq[a:b]
            full = now >= limit[a:b]
            out = now[full]
            if len(out):
                words.append(out.astype(np.uint32))
                count += len(out)
                now[full] = out >> np.uint64(32)
            whole = now // f
            x[:b - a] = (whole << self.shift) + (now - whole * f) + start[a:b]
            if t % every == 0:
                kept.append((count, x.copy()))
        if not steps:
            kept.append((0, x.copy()))
        body = [HEAD.pack(b"RANS", self.bits, lanes, every, n, count, zlib.crc32(ids.astype("<u4").tobytes()))]
        for emitted, state in reversed(kept):
            body += [struct.pack("<Q", count - emitted), state.astype("<u8").tobytes()]
        body += [w.astype("<u4").tobytes() for w in reversed(words)]
        data = b"".join(body)
        return data + struct.pack("<I", zlib.crc32(data))

    def decode(self, data: bytes) -> np.ndarray:
        """All ids of a payload; every part between checkpoints is decoded from its own checkpoint."""
        if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block checksum differs")
        magic, bits, lanes, every, n, count, crc = HEAD.unpack_from(data)
        if magic != b"RANS" or bits != self.bits:
            raise ValueError("block was written with another table")
        if self.symbol is None:
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.uint32
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        steps = -(-n // lanes)
        points = max(1, -(-steps // every))
        words = np.frombuffer(data, "<u4", count, HEAD.size + points * 8 * (lanes + 1)).astype(np.uint64)
        ids = np.empty(n, np.uint32)
        for p in range(points):
            at = HEAD.size + p * 8 * (lanes + 1)
            place = struct.unpack_from("<Q", data, at)[0]
            x = np.frombuffer(data, "<u8", lanes, at + 8).astype(np.uint64)
            self._part(x, words, place, ids, lanes, p * every, min(steps, (p + 1) * every))
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("ids checksum differs")
        return ids

    def _part(self, x, words, place, ids, lanes, begin, end) -> None:
        mask, n = np.uint64((1 << self.bits) - 1), len(ids)
        for t in range(begin, end):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            now = x[:b - a]
            slot = now & mask
            s = self.symbol[slot]
            ids[a:b] = s
            now = self.freq[s] * (now >> self.shift) + slot - self.start[s]
            low = now < LOW
            k = int(np.count_nonzero(low))
            if k:
                now[low] = (now[low] << np.uint64(32)) | words[place:place + k]
                place += k
            x[:b - a] = now


def tokenised(docs: DataFrame, tokenizer: str, wide: bool, end_id: int = END_ID) -> DataFrame:
    """doc_id, text_hash, ids: each text's ids with the end id, where the text is read; last in each task a row
    with counts, how often each id occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "ids", "counts"]
        coder, total = encoder(tokenizer), np.zeros(0, np.int64)
        for batch in batches:
            for start, texts in text_slices(batch, 1, SLICE_CHARS):
                ids, lengths = coder.encode(texts, end_id)
                got = np.bincount(ids, minlength=len(total)).astype(np.int64)
                got[:len(total)] += total
                total, n = got, len(lengths)
                ids = ids.astype("<u4" if wide else "<u2", copy=False)
                offsets = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
                rows = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), batch.column(2).slice(start, n), rows, pa.nulls(n, pa.binary())], names=names)
        if len(total):
            none = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    rows_ = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return in_arrow(rows_, run, "doc_id long, text_hash long, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n over all documents, from the counts of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                total = np.frombuffer(counts, "<i8")
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["id", "n"])

    return in_arrow(tokens.filter("counts is not null").select("counts"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def blocks_of(tokens: DataFrame, freq, bits: int, wide: bool, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of whole documents in doc_id order over the parts; freq is a broadcast of the table."""
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, pos = Coder(freq.value, bits), TaskContext.get().partitionId(), 0
        names = ["part", "pos", "n_tokens", "doc_ids", "lengths", "payload"]
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join([r[1] for r in held]), kind)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([pos], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[len(r[1]) // kind.itemsize for r in held]], pa.list_(pa.int64())),
                pa.array([coder.encode(ids)], pa.binary())], names=names)

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(row)
                size += len(row[1]) // kind.itemsize
                if size >= block_tokens:
                    yield block()
                    held, pos, size = [], pos + size, 0
        if held:
            yield block()

    order = ["doc_id", "text_hash"]
    ordered = tokens.filter("ids is not null").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    return in_arrow(ordered, run, "part int, pos long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode documents (doc_id, text) into `folder`.

    To the driver go the counts of the ids, at most one per id of the vocabulary, and one number per part.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    wide = vocabulary > 1 << 16
    scratch = Scratch(spark, "token-ids")
    tokens = scratch.cut(tokenised(docs, tokenizer, wide, end_id), "ids", "zstd")
    counts = np.zeros(max(vocabulary, end_id + 1), np.int64)
    for row in id_counts(tokens).toLocalIterator():
        counts[row["id"]] = row["n"]
    freq, bits = shares(counts)
    found = np.flatnonzero(freq)
    rows = [(int(k), int(freq[k])) for k in found]
    spark.createDataFrame(rows, "id int, freq int").coalesce(1).write.parquet(f"{folder}/table")
    table = spark.sparkContext.broadcast(freq)
    blocks_of(tokens, table, bits, wide).write.option("compression", "none").parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    ends = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, parts = 0, []
    for row in ends:
        parts.append((row["part"], base))
        base += row["n"]
    spark.createDataFrame(parts, "part int, base long").coalesce(1).write.parquet(f"{folder}/parts")
    scratch.drop(tokens)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files of a folder."""
    freq = np.zeros(0, np.int64)
    rows = spark.read.parquet(f"{folder}/table").collect()  # at most the vocabulary
    if rows:
        freq = np.zeros(max(r["id"] for r in rows) + 1, np.int64)
        for r in rows:
            freq[r["id"]] = r["freq"]
    bits = max(1, int(freq.sum())).bit_length() - 1
    table = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value, bits)
        for batch in batches:
            for first, doc_ids, lengths, payload in zip(*[batch.column(k) for k in range(4)]):
                ids = coder.decode(payload.as_py())
                sizes = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                out = [doc_ids.values, pa.array(first.as_py() + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    parts = spark.read.schema("part int, base long").parquet(f"{folder}/parts")
    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(parts), "part")  # a row for each part written
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return in_arrow(blocks.select((F.col("base") + F.col("pos")).alias("first"), "doc_ids", "lengths", "payload"), run, schema)


def encoded_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write documents as token files in the shared folder and return what reading them back gives."""
    scratch = Scratch(docs.sparkSession, "token-files")
    write_tokens(docs, scratch.root, tokenizer, end_id)
    return read_tokens(docs.sparkSession, scratch.root)
