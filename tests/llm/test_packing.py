"""Packing against a plain dot-product packer, with every id in one piece and no padding where cuts are free."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from marquee.llm import instruction_packing as packing
from marquee.llm import queries

SF = "/root/testdata/sf0.001"


def check_sequences(rows, limits):
    """rows: (id, start, length, loss, sequence, offset); every sequence is gapless and within limits."""
    by = {}
    for r in rows:
        by.setdefault(r[4], []).append(r)
    for pieces in by.values():
        at = 0
        for _, _, length, _, _, offset in sorted(pieces, key=lambda r: r[5]):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p[3] for p in pieces) <= limits.loss
    return {k: sum(p[2] for p in v) for k, v in by.items()}


def check_documents(got, texts, limits=packing.Limits()):
    coder = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    ids = {k: np.array(coder.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, t in texts.items()}
    seen = {}
    for doc, start, length, crc, total, _, _ in got:
        assert total == len(ids[doc]) and crc == zlib.crc32(ids[doc][start:start + length].tobytes())
        seen.setdefault(doc, []).append((start, length))
    assert set(seen) == set(ids)
    for doc, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(ids[doc])
    used = check_sequences([(d, s, n, n, q, o) for d, s, n, _, _, q, o in got], limits)
    assert all(packing.padded(n, limits.tokens) == n for n in used.values())


def test_query_keeps_every_id_and_pads_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op12_packing(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = [tuple(r) for r in got.collect()]
    check_documents(rows, {r.doc_id: r.text for r in docs.collect()})
    assert sorted(rows) == sorted(map(tuple, queries.op12_packing(spark, SF).collect()))


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(1024, 2, 1024), packing.Limits(100, 3, 60)])
def test_odd_documents(spark, limits):
    from pyspark.sql import functions as F

    texts = [None, "", " ", "x", "x", "é" * 3000, "word " * 9000, "z" * 200_000, "<|endoftext|> a"] + ["tiny"] * 300
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, start int").repartition(2)
    got = packing.packed_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"), limits, pool=50)
    rows = got.select("id", "start", "length", F.crc32("ids"), "total", "sequence_id", "offset").collect()
    check_documents([tuple(r) for r in rows], dict(enumerate(texts)), limits)


def test_repeated_rows_and_no_rows(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(7, "same text"), (7, "same text"), (None, "no id")], "doc_id long, text string")
    got = packing.packed_documents(docs, path).collect()
    assert sum(r.length for r in got if r.id == 7) == 2 * next(r.total for r in got if r.id == 7)
    assert sum(r.length for r in got if r.id is None) > 0
    assert packing.packed_documents(docs.limit(0), path).collect() == []


def plain_pack(items, limits):
    """Indivisible (id, tokens, loss): each place by the dot product over all that wait, one sequence after another."""
    left, out, sequence = list(items), [], 0
    while left:
        t, s, b = limits
        offset = 0
        while True:
            fit = [(x[1] * t / limits.tokens ** 2 + x[2] * b / limits.loss ** 2, x) for x in left if x[1] <= t and x[2] <= b and s]
            if not fit:
                break
            best = max(p for p, _ in fit)
            x = next(x for p, x in fit if p >= best - 1e-12)
            left.remove(x)
            out.append((*x, sequence, offset))
            t, s, b, offset = t - x[1], s - 1, b - x[2], offset + x[1]
        sequence += 1
    return out


def test_whole_examples_follow_the_heuristic(spark):
    rng = random.Random(2)
    limits = packing.Limits(64, 4, 24)
    items = []
    for k in range(300):
        n = rng.randrange(1, 60)
        mask = [rng.random() < 0.4 for _ in range(n)]
        items.append((k, [rng.randrange(1000) for _ in range(n)], mask))
    good = [x for x in items if sum(x[2]) <= 24]
    frame = spark.createDataFrame(items, "id long, ids array<int>, loss array<boolean>").coalesce(1).sortWithinPartitions("id")
    got = packing.packed(frame, limits, pool=10_000).collect()
    assert {r.id for r in got if r.sequence_id is None} == {k for k, _, m in items if sum(m) > 24}
    rows = [r for r in got if r.sequence_id is not None]
    used = check_sequences([(r.id, r.start, r.length, r.loss_tokens, r.sequence_id, r.offset) for r in rows], limits)
    want = plain_pack([(k, len(i), sum(m)) for k, i, m in good], limits)
    shape = lambda rows: sorted(sorted((n, b) for n, b, q in rows if q == s) for s in {q for *_, q in rows})
    assert shape([(r.length, r.loss_tokens, r.sequence_id) for r in rows]) == shape([(x[1], x[2], x[3]) for x in want])
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == items[r.id][1]
    assert len(used) < 1.25 * max(sum(r.length for r in rows) / 64, len(rows) / 4, sum(r.loss_tokens for r in rows) / 24)


def test_cut_examples_with_masks(spark):
    rng = random.Random(4)
    limits = packing.Limits(64, 3, 20)
    items = [(k, list(range(n)), None if k % 5 == 0 else [rng.random() < 0.5 for _ in range(max(0, n - k % 3))]) for k in range(60) for n in [rng.randrange(0, 300)]]
    frame = spark.createDataFrame([*items, (None, None, None)], "id long, ids array<int>, loss array<boolean>").repartition(2)
    got = packing.packed(frame, limits, cut=True, pool=20).collect()
    used = check_sequences([(r.id, r.start, r.length, r.loss_tokens, r.sequence_id, r.offset) for r in got], limits)
    assert all(packing.padded(n, 64) == n for n in used.values())
    for k, ids, mask in items:
        parts = sorted((r for r in got if r.id == k), key=lambda r: r.start)
        assert [x for p in parts for x in np.frombuffer(p.ids, "<u4").tolist()] == ids
        bears = [True] * len(ids) if mask is None else mask + [True] * (len(ids) - len(mask))
        assert all(p.loss_tokens == sum(bears[p.start:p.start + p.length]) for p in parts)
