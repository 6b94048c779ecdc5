"""Quality rules whose limits follow the data: quantile sketches per language and source.

For each document five counts and three shares are taken. Values of a share are counted in buckets whose
bounds grow by GROWTH (a quantile is known to GROWTH - 1 of its value); such a sketch is a table
(lang, source, share, bucket, n), and merging sketches is adding n. Only documents that the base rules pass
count in n, so that the bulk of copies and scraps does not set the limits for the others.

A group's limit for a share is its HIGH quantile, at least FLOOR, and at most its median plus SPREAD times a
distance. That is the larger one of lower quartile to median and of the part of rows that are not zero times the
median of those (where most rows are zero, quartiles say nothing; this product is held between 0.5 and 1.5 times
SLACK, so that dirt does not set it). A document above a limit is not kept.

Limits are blended with those of the parents by row count: a group of n rows takes n / (n + PRIOR) of its own limit
and the rest of its language's, which is blended with that of all documents in the same way. So one row more moves a
limit a little, and no size switches rules. No limit is more than LOOSER times that of the language or of all, nor
than LOOSER times the median of the limits of their groups, where each group weighs n / (n + PRIOR) and one hot
source therefore no more than another full one. So a source that is mostly dirt, or unlike all others, is held to
about what the others show.

Everything is DataFrame expressions. A text's 8-word windows are compared as 64-bit hashes.

Defined cases: null and blank texts have no words and fail; null lang and null source are groups of their
own; repeated rows are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, let, words_of

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
GROWTH = 1.02
SPREAD = 6.0
HIGH = 0.98
#: Rows for which a group trusts its own limit as much as that of its parent.
PRIOR = 100
#: How much looser than those of its language and of all documents a limit may be.
LOOSER = 2.0
#: What is always let pass, for each share.
FLOOR = {"symbols": 0.02, "dup_lines": 0.1, "repeats": 0.05}
#: Usual distance of quartiles, for each share.
SLACK = {"symbols": 0.01, "dup_lines": 0.1, "repeats": 0.05}


def repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more. Sorted by hash, then place, equal windows are neighbours."""
    def covered(places: Column) -> Column:  # of sorted places of repeated windows
        return F.aggregate(
            F.sequence(F.lit(0), F.size(places) - 1), F.lit(0),
            lambda n, k: n + F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(places, k) - F.get(places, k - 1))))

    def places(pairs: Column) -> Column:
        hashed = lambda k: F.get(pairs, k)["h"]
        twice = F.filter(pairs, lambda p, k: p["h"].eqNullSafe(hashed(k - 1)) | p["h"].eqNullSafe(hashed(k + 1)))
        return F.array_sort(F.transform(twice, lambda p: p["at"]))

    def counted(hashes: Column) -> Column:
        def spread() -> Column:
            pairs = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
            return let(pairs, lambda p: let(places(p), covered))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(spread())

    def windows(codes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(codes) - WINDOW), lambda k: F.xxhash64(*[F.get(codes, k + j) for j in range(WINDOW)]))

    codes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(let(codes, lambda c: let(windows(c), counted)))


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and base_failed for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    found = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), counts.alias("c"),
        (F.length(text) - F.coalesce(F.length(F.array_join(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]+"), 0), "")), F.lit(0))).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"))
    words, repeated = F.col("c.n_words").cast("long"), F.col("c.n_repeat_words").cast("long")
    return found.select(
        "doc_id", "lang", "source", words.alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        F.col("l.dup").cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines"),
        ((words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)).alias("base_failed"))


def shares() -> dict[str, Column]:
    def of(n: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(n) / F.col(total)).otherwise(F.lit(0.0))

    return {"symbols": of("n_symbols", "word_chars"), "dup_lines": of("n_dup_lines", "n_lines"), "repeats": of("n_repeat_words", "n_words")}


def sketched(rows: DataFrame) -> DataFrame:
    """lang, source, share, bucket, n: the mergeable sketch; bucket null holds zeros, n leaves out what the base rules fail."""
    values = F.array(*[F.struct(F.lit(k).alias("share"), v.alias("value")) for k, v in shares().items()])
    passed = F.when(F.col("base_failed"), 0).otherwise(1).alias("passed")
    flat = rows.select("lang", "source", passed, F.explode(values).alias("v")).select("lang", "source", "passed", "v.*")
    bucket = F.when(F.col("value") > 0, F.floor(F.log("value") / math.log(GROWTH)).cast("int"))
    return flat.groupBy("lang", "source", "share", bucket.alias("bucket")).agg(F.sum("passed").alias("n"))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One limit for each share of each group of `keys`, with the rows of the group."""
    merged = sketch.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n"))
    group = W.Window.partitionBy(*keys, "share")
    upto = group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket") + 1))  # no value of the bucket is above
    zeros = F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))).over(group), F.lit(0))
    run = merged.select(*keys, "share", value.alias("value"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("rows"),
                        zeros.alias("zeros"))
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("value")))
    both = run.groupBy(*keys, "share").agg(
        quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(HIGH).alias("high"), F.max("rows").alias("rows"),
        F.max("zeros").alias("zeros"),
        F.min(F.when(F.col("upto") >= (F.col("rows") + F.col("zeros")) * 0.5, F.col("value"))).alias("middle"))  # of what is not zero
    of = lambda table: F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.col("share")]
    usual = F.when(F.col("rows") > 0, (1 - F.col("zeros") / F.col("rows")) * F.col("middle"))
    usual = F.greatest(0.5 * of(SLACK), F.least(1.5 * of(SLACK), usual))
    fence = F.col("q2") + SPREAD * F.greatest(F.col("q2") - F.col("q1"), usual)
    return both.select(*keys, "share", "rows", F.greatest(of(FLOOR), F.least(F.col("high"), fence)).alias("limit"))


def middle_limit(groups: DataFrame, *keys: str) -> DataFrame:
    """The weighted median of groups' limits; in buckets, so that their number has a bound."""
    bucket = F.floor(F.log("limit") / math.log(GROWTH))
    weight = F.round(1000 * F.col("rows") / (F.col("rows") + PRIOR)).cast("long")
    return groups.groupBy(*keys).agg(F.pow(F.lit(GROWTH), F.percentile(bucket, 0.5, weight)).alias("middle"))


def thresholds(sketch: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source and the limit of each share."""
    sketch = scratch.cut(sketch, "sketch")
    own, by_lang, every = limits(sketch, ["lang", "source"]), limits(sketch, ["lang"]), limits(sketch.withColumn("all", F.lit(1)), ["all"])
    lang_middle = middle_limit(own, "lang", "share").toDF("l4", "s4", "m4")
    middle = middle_limit(own, "share").toDF("s5", "m5")
    by_lang = by_lang.select(F.col("lang").alias("l2"), F.col("share").alias("s2"), F.col("rows").alias("r2"), F.col("limit").alias("m2")).join(
        lang_middle, F.col("l2").eqNullSafe(F.col("l4")) & (F.col("s2") == F.col("s4")), "left")
    every = every.select(F.col("share").alias("s3"), F.col("limit").alias("m3")).join(middle, F.col("s3") == F.col("s5"), "left")
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("share") == F.col("s2"))).join(
        F.broadcast(every), F.col("share") == F.col("s3"))  # one row per share
    blend = lambda own_limit, rows, parent: (rows * own_limit + PRIOR * parent) / (rows + PRIOR)
    blended = blend(F.col("limit"), F.col("rows"), blend(F.col("m2"), F.col("r2"), F.col("m3")))
    limit = F.least(blended, LOOSER * F.least("m3", "m5"), LOOSER * F.least("m2", "m4"))  # medians are null without any weight
    wide = both.groupBy("lang", "source")
    return wide.agg(*[F.max(F.when(F.col("share") == s, limit)).alias(f"limit_{s}") for s in SLACK]).select(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[f"limit_{s}" for s in SLACK])


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the counts, base_failed and kept, with the limits that were applied."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.cut(signals(docs), "signals")
    table = thresholds(sketched(rows), scratch)
    both = rows.join(table, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")))
    fine = ~F.col("base_failed")
    for s, value in shares().items():
        fine = fine & (value <= F.col(f"limit_{s}"))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       fine.alias("kept"), *[f"limit_{s}" for s in SLACK])
