"""The training-text operators against plain versions, and their defined edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import (
    decontaminate,
    language_id,
    mixing,
    near_dedup,
    quality_rules,
    queries,
    sharding,
    token_counts,
    token_output,
    toxicity,
    url_filter,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score int, kept string, _bucket int, label int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, copies, repeated rows and clashing names."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épée", "日本"]) + str(rng.randrange(3000)) for _ in range(30_000))
    texts = [None, "", "  \n\t ", "One two three four five six seven eight nine ten eleven twelve", "x", "x", "\n\nx  y", "12 34 !!", long, long + " end",
             "One two three four five six seven eight nine ten eleven twelve", "<|endoftext|> é\x85a\xa0b"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "s", None, 1, 2, "k", 3, None) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id here", None, None, None, None, None, None, None, None)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 1 token counts -----------------------------------------------------------------------
def test_token_counts_equal_the_library(spark, odd, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_path("piece_bpe_32k.model")
    plain = Tokenizer(models.Unigram(token_counts.vocabulary(path), 0, True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for df in (odd, docs):
        want = sorted((r.doc_id if r.doc_id is not None else -1, len(plain.encode(r.text or "").ids)) for r in df.collect())
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in token_counts.token_counts(df, path).collect()) == want


@pytest.mark.parametrize("seed", range(20))
def test_token_ties_equal_the_library(seed):
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(seed)
    pieces = {"".join(rng.choice("ab▁é") for _ in range(rng.randint(1, 4))) for _ in range(12)}
    entries = [("<unk>", 0.0), *[(p, float(-rng.randint(1, 4))) for p in sorted(pieces) if "▁" not in p[1:]]]
    plain = Tokenizer(models.Unigram(entries, 0, False))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 15))) for _ in range(50)]
    got = token_counts.Counter(entries, False).texts(pa.array(texts))[0].tolist()
    assert got == [len(e.ids) for e in plain.encode_batch(texts)]


def test_long_piece_takes_bounded_memory():
    """5 million characters without a space: counted as by the library, in little more memory than the text."""
    import tracemalloc

    from tokenizers import Tokenizer, models

    entries = [("<unk>", 0.0), ("▁", -3.0), *[(p, -float(k + 1)) for k, p in enumerate(["a", "b", "ab", "bab", "aabb", "é"])]]
    mine = token_counts.Counter(entries, False)
    plain = Tokenizer(models.Unigram(entries, 0, False))
    rng = random.Random(1)
    piece = "▁" + "".join(rng.choice("abcé") for _ in range(100_000))
    assert mine.count(piece)[0] == len(plain.encode(piece).ids)
    text = "".join(rng.choice("abcé") for _ in range(50_000)) * 100
    tracemalloc.start()
    mine.counts([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and not mine.cache


# --- 2 sharding ---------------------------------------------------------------------------
def test_packing_equals_plain_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 80))), reverse=True)
        rooms = []
        for s in sizes:
            fits = [k for k, r in enumerate(rooms) if r >= s]
            best = min(fits, key=lambda k: (rooms[k], k)) if fits else None
            if best is None:
                rooms.append(100 - s)
            else:
                rooms[best] -= s
        used = collections.Counter()
        for s, n, place in sharding.best_fit_decreasing(sorted(collections.Counter(sizes).items(), reverse=True), 100):
            used[place] += s * n
        assert sorted(used.values()) == sorted(100 - r for r in rooms)


def test_tree_of_many_bins():
    tree, plain, rng = sharding.RoomTree(), set(), random.Random(2)
    for k in range(5000):
        pair = (rng.randint(0, 999), k)
        tree.add(*pair)
        plain.add(pair)
        if k % 3 == 0:
            size = rng.randint(0, 1100)
            want = min((p for p in plain if p[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            plain.discard(want)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_shards(request, which):
    df = request.getfixturevalue(which)
    out = sharding.sharded(df, 7).collect()
    assert len(out) == df.count() and {r.shard for r in out} <= set(range(7)) and {r.law for r in out} == {"bytes"}
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32(r.text.encode()) if r.text is not None else None) for r in df.collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in out} == texts
    groups = collections.defaultdict(set)
    for r in out:
        groups[r["size"], r.text_crc32].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    if which == "docs":
        size = collections.Counter()
        for r in out:
            size[r.shard] += r["size"]
        assert max(size.values()) <= 1.02 * sum(size.values()) / 7


# --- 3 language ---------------------------------------------------------------------------
def test_language_equals_plain_ranks(docs, rows):
    def grams(text):
        n = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            p = f"\0{w}\0"
            n.update([(1, c) for c in w])
            n.update([(2, p[k:k + 2]) for k in range(len(p) - 1)])
            n.update([(3, p[k:k + 3]) for k in range(len(p) - 2)])
        return n

    def key(g):
        kind, text = g
        c = [ord(x) for x in text]
        return c[0] if kind == 1 else c[0] << 42 | c[1] | 1 << 63 if kind == 2 else c[0] << 42 | c[1] << 21 | c[2]

    def top(n):
        return [key(g) for g in sorted(n, key=lambda g: (-n[g], key(g)))[:50]]

    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in rows}
    sums = collections.defaultdict(collections.Counter)
    for d, r in rows.items():
        if not held[d]:
            sums[r.lang].update(grams(r.text))
    known = {lang: {g: k for k, g in enumerate(top(n))} for lang, n in sums.items()}
    out = language_id.identified(docs, top=50).collect()
    right = []
    for r in out:
        mine = top(grams(rows[r.doc_id].text))
        apart = {lang: sum(abs(k - p[g]) if g in p else 50 for k, g in enumerate(mine)) for lang, p in known.items()}
        best = min(sorted(apart), key=apart.get)
        assert (r.lang_pred, r.held_out) == (best, held[r.doc_id]) and r.score == 1 - apart[best] / (len(mine) * 50)
        right.append(r.lang_pred == rows[r.doc_id].lang)
    assert len(out) == len(rows) and np.mean(right) > 0.97


def test_language_edges(spark, odd):
    out = {r.doc_id: r for r in language_id.identified(odd).collect()}
    assert {d for d, r in out.items() if r.lang_pred == "und"} >= {0, 1, 2, 7} and all(0 <= r.score <= 1 for r in out.values())
    none = language_id.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    kept = language_id.with_language(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2, 7})


def test_language_stage_rejects_what_was_not_learned(spark, docs):
    go = ["Tervetuloa kaupunkiin, jossa jokainen päivä alkaa hyvällä kahvilla ja pitkällä kävelyllä järven rannalla.",
          "Dzisiaj jest piękna pogoda i wszyscy chcą wyjść na spacer do parku, żeby odpocząć po pracy.",
          "Ma nagyon szép idő van, és mindenki sétálni szeretne a parkban munka után.", "xq zj vk wq pz", "12 34"]
    stay = ["The station and the house on the other side of the street are then the best.", "the one and the other",
            "Der Hund und die Katze sind nicht in der Stadt, aber ich gehe mit dir.",
            "La maison est dans la rue et les enfants ne sont pas là.", "La casa de la ciudad es muy grande y los niños están en el parque."]
    more = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(go + stay)], "doc_id long, text string")
    kept = corpus_pipeline.recognised(spark, docs.unionByName(more, allowMissingColumns=True), SF)
    assert {r.text for r in kept.filter("doc_id >= 1000000").collect()} == set(stay)
    assert kept.filter("doc_id < 1000000").count() == docs.count()


# --- 4 mixing -----------------------------------------------------------------------------
def test_targets_share_what_is_cut():
    got = mixing.targets({"a": 100, "b": 10, "c": 100, None: 0})
    assert got[None] == 0 and got["b"] == 20 and abs(got["a"] - 177) < 1e-9 and abs(got["c"] - 118) < 1e-9


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(request, which):
    df = request.getfixturevalue(which)
    first, again = table(mixing.mixed(df)), table(mixing.mixed(df))
    assert first == again
    got = mixing.mixed(df).collect()
    want = collections.Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in df.collect())
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in got) == want
    taken, goal, largest = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - goal[s]) <= 2 * largest[s] for s in goal)
    copies = mixing.copies_of(df)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in got)


# --- 5 toxicity ---------------------------------------------------------------------------
def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = np.repeat(np.arange(600), 2)
    features = np.stack([np.where(grades > 0, 0, 1), np.where(grades > 1, 2, 3)], axis=1).ravel()
    model = toxicity.fit(rows, features, np.ones(1200, np.int64), grades, ["mild", "none", "hard", "soft"])
    assert np.all(np.diff(model.cuts) > 0)
    s = model.severity(pa.array(["none soft", "mild soft", "mild hard", None or ""])).sum(axis=1)
    assert s[0] < s[1] < s[2]


def test_toxicity(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    out = toxicity.severities(docs, labels)
    both = out.join(labels, "doc_id").collect()
    assert out.count() == docs.count() and np.mean([r.toxic == bool(r.label) for r in both]) > 0.95
    assert toxicity.severities(odd, labels.limit(0)).filter("severity != 0 or toxic").count() == 0
    assert toxicity.severities(odd, labels).count() == odd.count()


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    out = toxicity.severities(docs, labels.filter("doc_id % 4 != 0")).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    assert np.mean([r.toxic == bool(r.label) for r in out]) > 0.9


def test_labels_without_zero_and_repeated_labels(spark):
    texts = [(k, f"mild words number {k} calm" if k % 2 else f"harsh words number {k} angry") for k in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    of = lambda f: spark.createDataFrame([(k, f(k)) for k, _ in texts], "doc_id long, label int")
    for low, high in ((1, 2), (0, 3), (-1, 0)):
        out = {r.doc_id: r for r in toxicity.severities(df, of(lambda k: low if k % 2 else high)).collect()}
        assert all(out[k].toxic == (k % 2 == 0) and out[k].severity >= 0 for k in out) and len(out) == 80
    assert toxicity.severities(df, of(lambda k: 2)).filter("severity != 0").count() == 0
    once = of(lambda k: int(k % 2 == 0))
    many = once.union(spark.createDataFrame([(3, 0)] * 500, "doc_id long, label int"))
    assert table(toxicity.severities(df, many, sample=80)) == table(toxicity.severities(df, once, sample=80))


# --- 6 URLs -------------------------------------------------------------------------------
def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host):])[0]


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "https://A.Example.COM/en/x?u=http://z.net/es/", "http://www.example.com/en/", "ftp://b.net/es/1#f",
            "http://net/fr/", "http://xnet/fr/", "http://com", "http://a.com/", "http://q.org/%7E?x", "http://é.net/es", "a://b://c.com/", "http://q.org/%7E?x"]
    urls += [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    out = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))).collect()
    assert len(out) == len(urls)
    for r in out:
        host, path = url_parts(urls[r.page_id])
        best = (None, None)
        for rule, verdict in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
                best = rule, verdict
        assert (r.host, r.path, r.rule) == (host, path, best[0]) and r.verdict in ("allow", "block")
        assert best[1] is None or r.verdict == best[1]


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(none).count() == 0
    one = url_filter.judged(spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")).collect()
    assert [r.verdict for r in one] == ["allow"]


def test_url_trees_learn(spark):
    out = url_filter.judged(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).filter("rule is not null").collect()
    assert np.mean([r.verdict == r.learned_verdict for r in out]) > 0.8


def test_url_trees_judge_hosts_they_have_not_seen(spark):
    """Better than the majority on held-out hosts by a wide margin; URLs without a rule are not all judged alike."""
    held = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = url_filter.judged(pages, held_out=held).select("*", held.alias("held")).collect()
    test = [r for r in out if r.rule and r.held]
    blocked = np.mean([r.verdict == "block" for r in test])
    right = np.mean([r.verdict == r.learned_verdict for r in test])
    assert len(test) > 100 and right > max(blocked, 1 - blocked) + 0.15, (len(test), blocked, right)
    free = np.mean([r.verdict == "block" for r in out if not r.rule])
    assert 0.1 < free < 0.95, free


def test_repeated_url_does_not_fill_the_sample(spark):
    urls = [f"http://a{k}.com/" for k in range(50)] + [f"http://b.net/es/{k}/{k}" for k in range(50)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    first = df.orderBy(F.xxhash64("url")).first()["url"]
    more = ["http://a7.org/", "http://b.org/es/3/3"]
    pages = spark.createDataFrame(list(enumerate([*urls, *[first] * 300, *more])), "page_id long, url string")
    out = url_filter.judged(pages, sample=60).collect()
    assert len(out) == 402 and {r.learned_verdict for r in out} == {"allow", "block"}


# --- 7 decontamination --------------------------------------------------------------------
def plain_contamination(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a:a + k])].add(str(i))
    sizes, out = {len(w) for w in windows}, []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a:a + k])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=repr)


def test_contamination(spark, docs, odd):
    items = [(1, "Two, three! four"), (2, None), (3, "?"), (4, "five six seven eight nine ten eleven twelve x y z w v u"), (10, "x"), (4, "x"),
             (5, "one TWO three four five six seven eight nine ten eleven twelve")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = table(decontaminate.contamination(odd, df).drop("spans"))
    assert got == plain_contamination([(r.doc_id, r.text) for r in odd.collect()], items)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = table(decontaminate.contamination(docs, bench).drop("spans"))
    assert got == plain_contamination([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    none = decontaminate.contamination(odd, df.limit(0))
    assert none.filter("contaminated or n_items > 0").count() == 0 and none.count() == odd.count()
    cut = decontaminate.without_benchmark(docs, bench)
    assert cut.columns == docs.columns and decontaminate.contamination(cut, bench).filter("contaminated").count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_automaton_blocks(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items, texts = [(str(k), text(rng.randint(0, 9))) for k in range(8)], [text(rng.randint(0, 40)) for _ in range(10)]
    automata = [decontaminate.Automaton([(i, decontaminate.item_words(t)) for i, t in part], 4) for part in (items[:3], items[3:])]
    counts, found = decontaminate.hits(pa.array(texts), automata)
    for k, t in enumerate(texts):
        w, hit, ids = t.split(), set(), set()
        for i, item in items:
            x = item.split()
            n = min(4, len(x))
            for a in range(len(x) - n + 1 if x else 0):
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == x[a:a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(i)
        spans, got = found.get(k, ([], set()))
        assert {p for a, b in spans for p in range(a, b + 1)} == hit and got == ids and counts[k] == len(w)


def test_repeated_word_takes_linear_time():
    import time

    begin = time.monotonic()
    automaton = decontaminate.Automaton([("1", [b"na"] * 100_000), ("2", [b"na"] * 30 + [b"x"] * 12)])
    counts, found = decontaminate.hits(pa.array(["na " * 100_000, "so " + "na " * 12 + "so", "na " * 9, "x " * 11]), [automaton])
    assert counts.tolist() == [100_000, 14, 9, 11] and time.monotonic() - begin < 20
    assert found == {0: ([(0, 99_999)], {"1", "2"}), 1: ([(1, 12)], {"1", "2"}), 3: ([(0, 10)], {"2"})}


def test_many_blocks_equal_one(spark, docs, odd):
    """Automata are built in tasks, none in the driver; many small blocks find and cut what one does."""
    def none_here(*_):
        raise AssertionError("built in the driver")

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    here = decontaminate.Automaton.__init__
    try:
        decontaminate.Automaton.__init__ = none_here
        for df, items in ((docs, bench), (odd, spark.createDataFrame([(1, "two three four"), (2, "five six"), (1, "x"), (None, "beta")], "item_id long, text string"))):
            one, many = [decontaminate.contamination(df, items, block_words=n) for n in (10**6, 300 if df is docs else 2)]
            assert table(one) == table(many) and many.filter("contaminated").count() > 0
            one, many = [decontaminate.without_benchmark(df, items, block_words=n) for n in (10**6, 300 if df is docs else 2)]
            assert one.columns == many.columns and table(one) == table(many)
    finally:
        decontaminate.Automaton.__init__ = here
    assert len(decontaminate.Blocks(bench, decontaminate.Scratch(spark, "t"), block_words=300).names) > 2


# --- 8 quality ----------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_counts(request, which):
    df = request.getfixturevalue(which)
    texts = df.collect()
    want = []
    for r in texts:
        w = WORD.findall(r.text or "")
        n = collections.Counter(tuple(w[a:a + 8]) for a in range(len(w) - 7))
        hit = {p for a in range(len(w) - 7) if n[tuple(w[a:a + 8])] > 1 for p in range(a, a + 8)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", r.text or ""))
        want.append((r.doc_id, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    got = quality_rules.judged(df)
    assert table(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=repr)
    assert got.filter("base_failed and kept").count() == 0


def test_quality_limits_follow_groups(spark):
    rows = [(k, "en", "s", 100, 400, k % 3, 0, 0, 5, False) for k in range(200)] + [(999, "en", "s", 100, 400, 200, 0, 0, 5, False)]
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean"
    df = spark.createDataFrame(rows, schema)
    limit = quality_rules.limits(quality_rules.sketched(df), ["lang", "source"]).filter("share = 'symbols'").first()
    assert limit["rows"] == 201 and 2 / 400 < limit["limit"] < 200 / 400
    halves = quality_rules.sketched(df.filter("doc_id < 70")).union(quality_rules.sketched(df.filter("doc_id >= 70")))
    assert table(quality_rules.limits(halves, ["lang"])) == table(quality_rules.limits(quality_rules.sketched(df), ["lang"]))


def plain_limit(values, share):
    """HIGH quantile of the values in its bounds; sketch buckets are 2 % wide."""
    at = lambda q, of=sorted(values): of[max(0, math.ceil(q * len(of) - 1e-9) - 1)]
    slack, some = quality_rules.SLACK[share], sorted(v for v in values if v > 0)
    usual = min(1.5 * slack, max(0.5 * slack, len(some) / len(values) * at(0.5, some) if some else 0))
    return max(quality_rules.FLOOR[share], min(at(0.98), at(0.5) + 6 * max(at(0.5) - at(0.25), usual)))


def weighted_median(limits, sizes):
    flat = sorted(v for v, n in zip(limits, sizes) for _ in range(round(1000 * n / (n + 100))))
    return (flat[(len(flat) - 1) // 2] + flat[len(flat) // 2]) / 2


def shares_of(r):
    return {"symbols": r.n_symbols / (r.word_chars or 1), "dup_lines": r.n_dup_lines / (r.n_lines or 1), "repeats": r.n_repeat_words / (r.n_words or 1)}


def test_quality_limits_equal_plain_quantiles(spark):
    """Limits and decisions on real documents: groups differ in all shares, and each rule rejects something beyond the base rules."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 0")
    lines = {r.doc_id: r for r in quality_rules.signals(docs).select("doc_id", "lang", "source", "n_lines").collect()}
    out = quality_rules.judged(docs).collect()
    full = [SimpleNamespace(**r.asDict(), lang=lines[r.doc_id].lang, source=lines[r.doc_id].source, n_lines=lines[r.doc_id].n_lines) for r in out]
    groups, langs, every = collections.defaultdict(list), collections.defaultdict(list), [r for r in full if not r.base_failed]
    for r in every:
        groups[r.lang, r.source].append(r)
        langs[r.lang].append(r)
    want = {}
    for s in quality_rules.SLACK:
        of = lambda rows: plain_limit([shares_of(x)[s] for x in rows], s)
        own, whole = {g: of(rows) for g, rows in groups.items()}, of(every)
        middle = weighted_median(own.values(), [len(groups[g]) for g in own])
        for (lang, source), limit in own.items():
            mine = [g for g in own if g[0] == lang]
            n, m, parent = len(groups[lang, source]), len(langs[lang]), of(langs[lang])
            lang_middle = weighted_median([own[g] for g in mine], [len(groups[g]) for g in mine])
            blended = (n * limit + 100 * (m * parent + 100 * whole) / (m + 100)) / (n + 100)
            want[lang, source, s] = min(blended, 2 * min(whole, middle), 2 * min(parent, lang_middle))
    seen, beyond = collections.defaultdict(set), collections.Counter()
    for r in full:
        for s in quality_rules.SLACK:
            got, plain = getattr(r, f"limit_{s}"), want[r.lang, r.source, s]
            assert plain / 1.03 <= got <= plain * 1.03
            seen[s].add(round(got, 6))
            beyond[s] += not r.base_failed and shares_of(r)[s] > got
        assert r.kept == (not r.base_failed and all(v <= getattr(r, f"limit_{s}") for s, v in shares_of(r).items()))
    assert min(map(len, seen.values())) > 20 and max(seen["repeats"]) < 0.3 and min(beyond.values()) > 10


def test_one_row_more_moves_a_limit_little(spark):
    """Groups of any size are blended: verdicts do not hang on a group passing a number of rows."""
    def limits(n):
        rows = [(k, " ".join(f"w{(k * 31 + j) % 9973}" for j in range(30)) + "$" * (k % 4), "en", "a" if k < n else f"s{k % 5}") for k in range(n + 400)]
        out = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        return out.filter("doc_id = 0").select("limit_symbols", "limit_dup_lines", "limit_repeats").first()

    for a, b in zip(limits(99), limits(101)):
        assert a / 1.05 <= b <= a * 1.05


@pytest.mark.parametrize("share,hot,mixed", [(0.3, 200, False), (0.3, 2000, False), (0.3, 2000, True), (0.8, 200, True)])
def test_dirty_source_keeps_no_junk(spark, share, hot, mixed):
    """A source with much junk, also one that holds a third of all rows, is held to what the others show."""
    rng = random.Random(hot)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    symbols = lambda: " ".join(f"w{rng.randrange(10**4)}$$$" for _ in range(40))
    lines = lambda: "\n".join([prose(6)] * 2 + [prose(30)])
    rows = [(k, prose(40), "en", f"s{k % 20}") for k in range(4000)]
    rows += [(10_000 + k, (lines() if mixed and k % 2 else symbols()) if k < share * hot else prose(40), "en", "dirty") for k in range(hot)]
    out = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    junk = [r for r in out if 10_000 <= r.doc_id < 10_000 + share * hot]
    assert not any(r.base_failed for r in out)
    assert not any(r.kept for r in junk) and all(r.kept for r in out if r.doc_id < 10_000)


# --- 9 token files ------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    plain, want, at = Tokenizer.from_file(path), [], 0
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or "")):
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert table(token_output.encoded_documents(df, path)) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_units_encode_like_the_library(seed):
    """White space of all kinds, added tokens and repeated units; units of earlier calls come from the cache."""
    from tokenizers import Tokenizer

    rng, path = random.Random(seed), queries.tokenizer_path("byte_bpe_50k.json")
    parts = ["a", "word", " word", "é", "'s", "'", "12", " ", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "\u200b",
             "...", "中文", "<|endoftext|>", "😀", "a\u0301", "\x00", "\u0120"]
    plain, coder = Tokenizer.from_file(path), token_output.UnitEncoder(path)
    for _ in range(20):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(60)]
        ids, lengths = coder.encode(pa.array(texts), 0)
        want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert lengths.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_coder_round_trip_and_checksums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 300_000):
        ids = rng.zipf(1.3, n).clip(max=50_000).astype(np.uint32)
        freq, bits = token_output.shares(np.bincount(ids, minlength=50_257))
        assert freq.sum() == 1 << bits and (freq[np.unique(ids)] > 0).all()
        coder = token_output.Coder(freq, bits)
        data = coder.encode(ids, lanes=256, every=16)
        assert (coder.decode(data) == ids).all()
        for k in (10, len(data) - 1):
            with pytest.raises(ValueError, match="checksum"):
                coder.decode(data[:k] + bytes([data[k] ^ 1]) + data[k + 1:])


# --- 10 near duplicates -------------------------------------------------------------------
def plain_classes(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, odd, width, percent):
    for df in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        got = table(near_dedup.near_duplicates(df, width, percent))
        assert got == sorted(plain_classes([(r.doc_id, r.text) for r in df.collect()], width, percent), key=repr)
    out = near_dedup.near_duplicates(odd)
    assert out.count() == odd.count() and out.filter("doc_id is null").first().kept
    kept = near_dedup.without_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 11]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Copies of copies: neighbours in the chain are alike, far ones are not; all are one class."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[3 * k:3 * k + 120] + words[:120])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = table(near_dedup.near_duplicates(df, 3, 85))
    assert got == sorted(plain_classes(rows, 3, 85), key=repr)


def test_components(spark):
    from marquee.llm.common import Scratch

    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "t")).collect()}
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {n: r for n, r in root.items() if any(n in p and p[0] != p[1] for p in pairs)}


# --- all ----------------------------------------------------------------------------------
def test_empty_tables(spark, odd):
    none, path = odd.limit(0), queries.tokenizer_path("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, label int")
    items = spark.createDataFrame([], "item_id long, text string")
    outs = [token_counts.token_counts(none, queries.tokenizer_path("piece_bpe_32k.model")), sharding.sharded(none), language_id.identified(none),
            mixing.mixed(none), toxicity.severities(none, labels), decontaminate.contamination(none, items), quality_rules.judged(none),
            token_output.encoded_documents(none, path), near_dedup.near_duplicates(none)]
    assert [df.count() for df in outs] == [0] * len(outs)


def test_pipeline_stages(spark, docs, rows):
    """Each stage against a plain version of its decision."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "token_ids"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF)
        assert name == "token_ids" or now.columns == docs.columns
        if name == "language_id":
            assert now.count() == before.count()  # all have letters
        if name == "near_dedup":
            keep = {d for d, _, _, kept in plain_classes([(r.doc_id, r.text) for r in before.collect()], 5, 80) if kept}
            assert {r.doc_id for r in now.collect()} == keep
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            hit = {r.doc_id for r in decontaminate.contamination(before, items).filter("contaminated").collect()}
            assert {r.doc_id: r.text for r in now.collect() if r.doc_id not in hit} == {d: rows[d].text for d in {r.doc_id for r in before.collect()} - hit}
        if name == "mixing":
            mix = {r.doc_id: r.copies for r in mixing.mixed(before).collect()}
            assert collections.Counter(r.doc_id for r in now.collect()) == collections.Counter({d: n for d, n in mix.items() if n})
        if name == "token_ids":
            assert now.count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == now.count()
