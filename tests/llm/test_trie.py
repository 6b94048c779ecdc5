"""The prefix trie against plain recursion, and contraction on trees of several shapes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from marquee.llm import conversation_trie as trie
from marquee.llm import queries
from marquee.llm.common import Scratch

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Rows (conv_id, turn, role, text) to the nodes' columns."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    new = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(turns.get(c - c % 20, [])[:h] + t[h:])
    members, kids, out = defaultdict(list), defaultdict(list), {}
    for c, t in new.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        ends = sorted(c for c in members[k] if len(new[c]) == len(k))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]),
                  sum(out[x][5] for x in kids[k]) or 1, (len(members[k]) - 1) * words + sum(out[x][6] for x in kids[k]),
                  hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_plain_recursion(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows_of(queries.op13_conversation_trie(spark, SF)) == plain([tuple(r) for r in rows])


def test_nulls_ties_repeats_long_conversations_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN_TURNS", 3)  # conversations of many runs
    rng = random.Random(8)
    rows = []
    for c in [*range(45), 100, 101, 102, 160, 165]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 40])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "bot", None, ""]), rng.choice([None, "", "a", "a b", "b\x85c \n d"])))
    rows += rows[:20] + [(None, 1, "user", "nobody's turn"), (7, 3, "user", "long " * 50_000)]
    rows += [(c, t, "user", "always the same") for c in range(200, 260) for t in range(6)]
    frame = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], "conv_id long, turn int, role string, text string, pos int, share string, at string, words int")
    assert rows_of(trie.rebuilt_trie(frame.repartition(5))) == plain(rows)


def test_no_rows(spark):
    assert rows_of(trie.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))) == []


def test_conversation_without_a_turn_left_is_a_member_of_the_root(spark):
    lone = next(c for c in range(1, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 1, "user", "gone"), (lone, 2, "bot", "gone too")]
    got = rows_of(trie.rebuilt_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    assert got == plain(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_contraction_finds_every_total(spark, shape):
    rng = random.Random(shape)
    n = 100
    up = {0: None} | {k: {"chain": k - 1, "star": 0, "random": rng.randrange(k), "caterpillar": max(0, k - 1 - k % 2)}[shape] for k in range(1, n)}
    value = {k: rng.randrange(100) for k in up}
    leaves = {k: int(k not in set(up.values())) for k in up}
    want = {k: [value[k], leaves[k]] for k in up}
    for k in range(n - 1, 0, -1):
        for j in (0, 1):
            want[up[k]][j] += want[k][j]
    tree = spark.createDataFrame([(k, up[k], value[k], leaves[k]) for k in up], "v long, parent long, saved long, leaves long")
    got = {r.v: [r.saved, r.leaves] for r in trie.contracted(tree, Scratch(spark, "tree")).collect()}
    assert got == want
