"""Clusters and id mappings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A block up to this size is clustered inside one task; larger ones take the distributed rounds.
BLOCK_LIMIT = 5_000
_NODE = "block string, ord string, feats array<string>, sites array<string>"


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Seeds in order; each takes the rows that match it and bring only sites it does not have."""
    pdf = pdf.sort_values("ord", kind="stable")
    seeds_by_feature: dict[str, list[int]] = {}
    owned: list[set[str]] = []
    seed_ord: list[str] = []
    leaders = []
    for row in pdf.itertuples(index=False):
        sites = set(row.sites)
        candidates = sorted({s for f in row.feats for s in seeds_by_feature.get(f, ())})
        chosen = next((s for s in candidates if not (owned[s] & sites)), None)
        if chosen is None:
            owned.append(sites)
            seed_ord.append(row.ord)
            for f in row.feats:
                seeds_by_feature.setdefault(f, []).append(len(owned) - 1)
            leaders.append(row.ord)
        else:
            owned[chosen] |= sites
            leaders.append(seed_ord[chosen])
    return pd.DataFrame({"block": pdf["block"], "ord": pdf["ord"], "leader": leaders})


def greedy_star(nodes: DataFrame, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """(block, ord, leader): sequential greedy star clustering within blocks.

    ``nodes`` has block, ord (a sortable text unique in the block), feats (two rows match when they
    share one) and sites (rows whose sites meet never join; empty when sites do not matter). In
    the order of ord, a row joins the earliest leader that it matches and whose cluster has none
    of its sites; otherwise it leads a cluster itself. Not transitive.

    Blocks are counted first. Small ones, the normal case, run in one pass per block; a block
    above the limit runs the same rule as rounds of grouped minima, so no task ever holds it.
    """
    nodes = cut_lineage(
        nodes.select(F.col("block").cast("string"), F.col("ord").cast("string"), "feats", "sites")
    )
    sizes = nodes.groupBy("block").agg(F.count("*").alias("n"))
    small = nodes.join(sizes.filter(F.col("n") <= block_limit).select("block"), "block", "left_semi")
    out = small.groupBy("block").applyInPandas(_greedy, "block string, ord string, leader string")
    large_blocks = sizes.filter(F.col("n") > block_limit).select("block")
    if large_blocks.isEmpty():
        return out
    return out.unionByName(_greedy_rounds(nodes.join(large_blocks, "block", "left_semi")))


def _greedy_rounds(nodes: DataFrame) -> DataFrame:
    """The same rule for blocks of any size.

    Per round every (block, feature, site set) keeps its first open row and first open leader.
    A free row whose first compatible neighbour is none leads. A free row whose first compatible
    neighbour is a leader joins it, unless an earlier free row could bring one of its sites there
    first. All such rows of a round are settled at once; rows without sites never wait for each
    other, so the rounds follow the longest chain of undecided neighbours, not the cluster sizes.
    """
    decided: list[DataFrame] = []
    free = nodes
    leaders = nodes.limit(0).withColumn("own", F.col("sites"))
    while not free.isEmpty():
        active = free.select("block", "ord", "feats", F.col("sites").alias("own"), F.lit(False).alias("leads")).unionByName(
            leaders.select("block", "ord", "feats", "own", F.lit(True).alias("leads"))
        )
        spread = active.select("block", F.explode("feats").alias("f"), "own", "leads", "ord")
        firsts = spread.groupBy("block", "f", "own", "leads").agg(F.min("ord").alias("first"))
        free_feats = free.select("block", "ord", "sites", F.explode("feats").alias("f"))
        earliest = (
            free_feats.join(firsts, ["block", "f"])
            .filter(~F.arrays_overlap("sites", "own") & (F.col("first") < F.col("ord")))
            .groupBy("block", "ord").agg(F.min(F.struct("first", "leads")).alias("e"))
        )
        keys = ["block", "leader", "site"]
        free_firsts = firsts.filter(~F.col("leads")).select("block", "f", F.col("own").alias("s"), F.col("first").alias("cand"))
        bringing = (
            leaders.select("block", F.col("ord").alias("leader"), "own", F.explode("feats").alias("f"))
            .join(free_firsts.filter(F.size("s") > 0), ["block", "f"])
            .filter(~F.arrays_overlap("own", "s"))
            .select("block", "leader", F.explode("s").alias("site"), "cand")
            .groupBy(*keys).agg(F.min("cand").alias("cand"))
        )
        state = free.join(earliest, ["block", "ord"], "left")
        new_leaders = cut_lineage(state.filter(F.col("e").isNull()).select("block", "ord", "feats", "sites"))
        ready = state.filter(F.col("e.leads")).select("block", "ord", "sites", F.col("e.first").alias("leader"))
        late = (
            ready.select("block", "leader", "ord", F.explode("sites").alias("site")).join(bringing, keys)
            .filter(F.col("cand") < F.col("ord")).select("block", "ord").distinct()
        )
        joined = cut_lineage(ready.join(late, ["block", "ord"], "left_anti"))
        gained = joined.select("block", F.col("leader").alias("ord"), F.explode("sites").alias("site")).groupBy("block", "ord").agg(
            F.collect_set("site").alias("gain"))
        empty = F.array().cast("array<string>")
        leaders = cut_lineage(
            leaders.join(gained, ["block", "ord"], "left")
            .withColumn("own", F.array_sort(F.array_union("own", F.coalesce("gain", empty))))
            .select("block", "ord", "feats", "sites", "own")
            .unionByName(new_leaders.withColumn("own", F.col("sites")))
        )
        decided += [
            new_leaders.select("block", "ord", F.col("ord").alias("leader")),
            joined.select("block", "ord", "leader"),
        ]
        done = new_leaders.select("block", "ord").unionByName(joined.select("block", "ord"))
        free = cut_lineage(free.join(done, ["block", "ord"], "left_anti"))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def resolve_chains(mapping: DataFrame) -> DataFrame:
    """(old_id, keep_id) with every chain A -> B -> C followed to its end.

    Each round doubles the distance covered, so the number of rounds is the logarithm of the
    longest chain. More rounds than that can only come from a cycle, which is an error.
    """
    current = cut_lineage(mapping.select("old_id", "keep_id").filter("old_id <> keep_id").distinct())
    for _ in range(current.count().bit_length() + 1):
        onward = current.select(F.col("old_id").alias("keep_id"), F.col("keep_id").alias("next_id"))
        jumped = current.join(onward, "keep_id", "left")
        if jumped.filter(F.col("next_id").isNotNull()).isEmpty():
            return current
        current = cut_lineage(jumped.select("old_id", F.coalesce("next_id", "keep_id").alias("keep_id")))
    raise ValueError("the mapping has a cycle")


def survivors(rows: DataFrame, group: list[str], rank: Column, id_col: str = "id") -> DataFrame:
    """(old_id, keep_id) per group with at least two rows: everything maps to the best-ranked row.

    The best row is a minimum over a struct, reduced map-side, so a group of any size costs one
    row per task in the shuffle.
    """
    keyed = rows.select(*group, F.col(id_col).alias("old_id"), rank.alias("_rank"))
    best = keyed.groupBy(*group).agg(
        F.min(F.struct("_rank", "old_id")).alias("_best"), F.count("*").alias("_n")
    )
    best = best.filter("_n > 1").select(*group, F.col("_best.old_id").alias("keep_id"))
    return keyed.join(best, group).filter("old_id <> keep_id").select("old_id", "keep_id")


def batches_of(n: int):
    """Split an Arrow-backed iterator of frames into frames of at most n rows."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), n):
                yield frame.iloc[at : at + n]

    return split
