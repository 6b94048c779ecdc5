"""Greedy clusters in rounds: many rows in one block, few rounds, the result of the sequential rule."""

import random

import pandas as pd
import pytest

from marquee.operators import cluster as C


@pytest.mark.parametrize("with_sites", [False, True])
def test_large_block_takes_few_rounds(spark, monkeypatch, with_sites):
    rng = random.Random(1)
    n = 2_000
    sites = lambda: [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 1, 2]))] if with_sites else []
    rows = [("b", f"{k:06d}", [f"f{rng.randrange(n // 3)}" for _ in range(3)], sites()) for k in range(n)]
    rows += [("star", f"{k:06d}", ["all"], ["one"] if with_sites and k < 3 else []) for k in range(300)]  # one leader takes all at once
    cuts = []
    whole = C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: cuts.append(1) or whole(df))
    got = {(r.block, r.ord): r.leader for r in C.greedy_star(spark.createDataFrame(rows, C._NODE), 0).collect()}
    assert (len(cuts) - 1) / 4 <= 20
    for block in ("b", "star"):
        want = C._greedy(pd.DataFrame([r for r in rows if r[0] == block], columns=["block", "ord", "feats", "sites"]))
        assert {k: v for k, v in got.items() if k[0] == block} == {(block, o): x for o, x in zip(want.ord, want.leader)}
