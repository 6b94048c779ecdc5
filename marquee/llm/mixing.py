"""Mixing sources to target weights: entropy balancing with capped rates.

Each source has a target of words. Document rates w are those closest to 1 in relative entropy,
sum(w * ln(w) - w), for which every source's sum of rate * size is its target and no rate is above `most`:
w = min(most, exp(lambda * size)), one lambda per source. The dual is convex; its gradient and curvature
for all sources at once are one grouped sum per Newton step over the table of (source, size, documents).
Sums are of integers (rates in units of 2 ** -30), so reruns take the same steps. A step that leaves the
bracket of its root is replaced by a bisection.

Rates become copies by running sums over the sizes of a source, rounded down at both ends: a document gets
the floor or the ceiling of its rate, and as sizes only grow along the sum, a source's words differ from
its target by at most twice its largest document. That rest is closed by turning floors into ceilings, or
the other way round, from the largest size down, and by exchanges of one for one. Both look at one row per size of a source: there are at
most sqrt(2 * words) of them.

Words are runs other than white space. Weights repeat over the sources in code point order, null last.
On the driver: one row per source, the size of the weights themselves.

Defined cases: null and empty texts have size 0, rate 1 and take 0; an empty table gives an empty result;
repeated rows are documents of their own; other columns are not read (`copies_of` keeps them).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import WORD, Scratch, numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
STEPS = 60
UNIT = 1 << 30
CLOSE = 1e-9
SWAPS = 64


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Words for each source: `share` of all by weight; what is above `most` times a source goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def rate(tilt, scaled, most: int = MOST):
    """Rates in units of 1 / UNIT; exponents are cut where the cap holds anyway."""
    power = F.exp(F.least(tilt * scaled, F.lit(math.log(most))))
    return F.round(F.least(power, F.lit(float(most))) * UNIT).cast("long")


def tilts(sizes: DataFrame, total: dict, docs: dict, goal: dict, most: int = MOST) -> dict[str | None, tuple[float, float]]:
    """(lambda, mean size) per source from (source, size, n) rows, by Newton steps on the dual."""
    spark = sizes.sparkSession
    mean = {s: max(1.0, total[s] / docs[s]) for s in total}
    now = {s: 0.0 for s in total if 0 < goal[s] < most * total[s] * (1 - 1e-12)}
    low, high = {s: -math.inf for s in now}, {s: math.inf for s in now}
    open_ = set(now)
    for _ in range(STEPS):
        if not open_:
            break
        table = spark.createDataFrame([(s, now[s], mean[s]) for s in sorted(open_, key=str)], "key string, tilt double, mean double")
        both = sizes.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("key")))  # one row per source
        w = rate(F.col("tilt"), F.col("size") / F.col("mean"), most)
        words = F.col("n").cast("decimal(20,0)") * F.col("size")
        free = w < most * UNIT
        sums = both.groupBy("source").agg(
            F.sum(words * w).cast("double").alias("taken"),
            F.sum(F.when(free, (words * w) * F.col("size"))).cast("double").alias("slope")).collect()
        for r in sums:
            s = r["source"]
            gap = r["taken"] / UNIT - goal[s]
            if abs(gap) <= CLOSE * goal[s] or high[s] - low[s] <= 1e-13 * abs(now[s]):
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = now[s]
            step = gap / (r["slope"] / UNIT / mean[s]) if r["slope"] else math.copysign(1.0, gap) * max(1.0, abs(now[s]))
            new = now[s] - step
            if not low[s] < new < high[s]:
                new = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else now[s] - math.copysign(max(1.0, abs(now[s])), gap)
            now[s] = new
    full = {s: math.inf if goal[s] > 0 else -math.inf for s in total if s not in now}
    return {s: (now.get(s, full.get(s, 0.0)), mean[s]) for s in total}


def rounded(classes):
    """How many documents of each size get the ceiling of their rate, the others getting the floor.

    The running sum of rates over growing sizes, rounded down, gives the number for each size. What is then
    left of the target is closed from the largest size down, then by exchanges that leave less.
    """
    classes = classes.sort_values("size")
    sizes, counts, rates = (classes[c].tolist() for c in ("size", "n", "rate"))
    ups, run, taken = [], 0, 0
    for size, n, w in zip(sizes, counts, rates):
        floor = w // UNIT
        up = (run + n * w) // UNIT - run // UNIT - n * floor
        run += n * w
        ups.append(up)
        taken += size * (n * floor + up)
    gap = round(float(classes["target"].iloc[0])) - taken
    sizes, counts, ups = np.array(sizes, np.int64), np.array(counts, np.int64), np.array(ups, np.int64)
    free = (sizes > 0) & (np.array(rates, np.int64) % UNIT > 0)
    for k in np.flatnonzero(free)[::-1].tolist():
        change = min(int(counts[k] - ups[k]), gap // int(sizes[k])) if gap > 0 else -min(int(ups[k]), -gap // int(sizes[k]))
        ups[k] += change
        gap -= change * int(sizes[k])
    for _ in range(SWAPS):  # one more document up and one less, or only one of them
        up, down = np.flatnonzero(free & (ups < counts)), np.flatnonzero(free & (ups > 0))
        add, cut = np.concatenate([[0], sizes[up]]), np.concatenate([[0], sizes[down]])
        near = np.clip(np.searchsorted(cut, add - gap)[:, None] + np.array([-1, 0]), 0, len(cut) - 1)
        left = np.abs(gap - (add[:, None] - cut[near]))
        i, j = np.unravel_index(int(left.argmin()), left.shape)
        if left[i, j] >= abs(gap):
            break
        gap -= int(add[i] - cut[near[i, j]])
        if i:
            ups[up[i - 1]] += 1
        if near[i, j]:
            ups[down[near[i, j] - 1]] -= 1
    return classes.assign(ups=ups)[["source", "size", "source_size", "target", "rate", "ups"]]


def words_in(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source and text_hash for each document.

    Documents of one size in a source take their copies by doc_id, then by a hash of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), words_in(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    rows = scratch.cut(numbered(rows, ["source", "size"], ["doc_id", "text_hash"], "rank", scratch), "ranked")
    sizes = scratch.cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()
    total, count = {r["source"]: r["words"] for r in sums}, {r["source"]: r["n"] for r in sums}
    goal = targets(total, weights, share, most)
    found = tilts(sizes, total, count, goal, most)
    table = spark.createDataFrame(
        [(s, total[s], float(goal[s]), *found[s]) for s in total], "key string, source_size long, target double, tilt double, mean double")
    table = F.broadcast(table)  # one row per source
    held = sizes.join(table, F.col("source").eqNullSafe(F.col("key")))
    w = F.when(F.col("size") == 0, UNIT).when(F.col("tilt") == math.inf, most * UNIT).when(F.col("tilt") == -math.inf, 0).otherwise(
        rate(F.col("tilt"), F.col("size") / F.col("mean"), most)).cast("long")
    held = held.select("source", "size", "n", w.alias("rate"), "source_size", "target")
    schema = "source string, size long, source_size long, target double, rate long, ups long"
    held = held.groupBy("source").applyInPandas(rounded, schema)  # different sizes of a source only
    held = held.withColumnsRenamed({"source": "from", "size": "words"})
    joined = rows.join(held, F.col("source").eqNullSafe(F.col("from")) & (F.col("size") == F.col("words")))
    copies = F.floor(F.col("rate") / UNIT).cast("long") + F.when(F.col("rank") < F.col("ups"), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), "source", "text_hash").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "text_hash")


def copies_of(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs with every row as often as the mix takes it; rows of equal doc_id, source and text are matched in order of a hash of all columns."""
    plain = [F.to_json(F.struct(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mine = docs.select(row.alias("row"), F.struct(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.col("text").cast("string"))).alias("id"), F.xxhash64(*plain).alias("order"))
    theirs = mixed(docs, weights, share, most).select(F.struct("doc_id", "source", "text_hash").alias("id"), "copies")
    mine = mine.withColumn("nth", F.row_number().over(W.Window.partitionBy("id").orderBy("order")))
    theirs = theirs.withColumn("nth", F.row_number().over(W.Window.partitionBy("id").orderBy(F.desc("copies"))))
    taken = theirs.filter("copies > 0").select(F.col("id").alias("of"), F.col("nth").alias("no"), "copies")
    both = mine.join(taken, F.col("id").eqNullSafe(F.col("of")) & (F.col("nth") == F.col("no")))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
