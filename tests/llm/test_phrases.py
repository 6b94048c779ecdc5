"""Collocations against plain counting, and the filters' round trip."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marquee.llm import phrases, queries

SF = "/root/testdata/sf0.001"


def plain(rows, least, top=2000):
    found, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    found[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in found.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        cover = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    cover[p[i:i + m]] = max(cover[p[i:i + m]], a)
        rows = []
        for p, a in often.items():
            if 100 * cover[p] < 80 * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_query_equals_plain_counting(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    got = queries.op11_phrases(spark, SF)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 30)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = ["Re", "la", "x\x85y", "é", "日本", "a\x0bb", "w\x00", "Q"]
    texts = [None, "", " \t ", "...", "one", "a b,c\td.E f!g\rh", "z " * 20_000 + "z", "zz" * 100_000]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", "."]) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(k, t, rng.choice([None, "und", "fr", ""]), "ids", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], rows[-1], (None, "re la re la", "fr", None, None, None)],
                                 "doc_id long, text string, lang string, ids string, f int, part int").repartition(4)


@pytest.mark.parametrize("least,top", [(1, 50), (3, 2000)])
def test_nulls_long_texts_ties_and_clashing_names(odd, least, top):
    rows = [tuple(r) for r in odd.select("lang", "text").collect()]
    assert sorted(map(tuple, phrases.collocations(odd, least=least, top=top).collect())) == plain(rows, least, top)


def test_small_buffers_and_another_seed_change_nothing(odd, monkeypatch):
    want = sorted(map(tuple, phrases.collocations(odd, least=2).collect()))
    once = phrases.word_ids

    def other_seed(words, scratch):
        from pyspark.sql import functions as F

        ids, size, _, _ = once(words, scratch)
        seed = words.sparkSession.range(1).select(F.xxhash64(F.lit(7))).first()[0]
        return ids.select("word", F.shiftrightunsigned(F.xxhash64(F.lit(7), "word"), 24).alias("id")), size, seed & phrases.MASK, 40

    monkeypatch.setattr(phrases, "word_ids", other_seed)
    monkeypatch.setattr(phrases, "MANY_WORDS", 1)  # more parts
    assert sorted(map(tuple, phrases.collocations(odd, least=2).collect())) == want


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


@pytest.mark.parametrize("bits", [24, 40, 64])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_filters_lose_nothing(bits, n):
    draw = np.random.default_rng(bits + n)
    words = [draw.integers(0, 1 << 20, 5000, np.uint64) * np.uint64(977) & np.uint64((1 << bits) - 1) for _ in range(n)]
    for back, x in zip(phrases.permuted(phrases.permuted(words, bits), bits, back=True), words):
        assert (back == x).all()
    counts = draw.integers(1, 600, 5000)
    want = Counter()
    for *p, c in zip(*[w.tolist() for w in words], counts.tolist()):
        want[tuple(p)] += c
    one = phrases.CountingFilter.of([w[:3000] for w in words], counts[:3000], bits)
    two = phrases.CountingFilter.of([w[3000:] for w in words], counts[3000:], bits)
    got = Counter()
    whole = phrases.CountingFilter.merged([one, two], bits)
    for part_bits in (8, 16):
        got.clear()
        for part, f in whole.parts(part_bits):
            again = phrases.CountingFilter.from_bytes(f.to_bytes(part_bits), part)
            lanes = phrases.permuted(again.lanes, bits, back=True)
            for *p, c in zip(*[x.tolist() for x in lanes], again.counts.tolist()):
                assert tuple(p) not in got
                got[tuple(p)] = c
        assert got == want
    if n == 2 and bits == 40:  # a part's bytes: remainders without the leading bytes, a byte a count, a few bits
        part, f = max(whole.parts(8), key=lambda x: len(x[1]))
        assert len(f.to_bytes(8)) <= len(f) * 11 + 200


def test_equal_leading_bits_are_told_apart():
    lanes = [np.array([5, 5, 5, 4], np.uint64), np.array([1, 1, 1, 9], np.uint64), np.array([3, 1, 2, 0], np.uint64)]
    assert phrases.in_order(lanes, 48).tolist() == [3, 1, 2, 0]
