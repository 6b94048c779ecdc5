"""URL verdicts: longest matching rule, else gradient-boosted trees on lexical features.

A rule is a host and the beginning of a path ("net/es/"); it fits the host and all its subdomains. A URL
is looked up under every suffix of its host by one join with the rules; the longest rule that fits wins.
The URLs that a rule decides are the labelled ones: the trees learn from at most `sample` different ones, those
with the least hash, and judge the others. Features are the shape of host and path and, as statistics of
suffixes, the share of blocked ones among labelled URLs with the same last label, the same last two, and the same
first part of the path. These shares are drawn to the overall one by PRIOR rows, which is what a suffix without
labels has; a URL of the sample takes them from the hosts of other folds, so that it never sees its own label. How
common a suffix is among all URLs is no feature: it only tells suffixes apart by chance.

Everything is DataFrame expressions and the DataFrame API of Spark's tree learner.

Defined cases: a null URL or one without "://" has empty host and path and goes to the trees; if the rules
give no or only one label, all others get that label, or "allow" without any; an empty table gives an
empty result; repeated rows are judged alike; columns besides page_id and url are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

SAMPLE = 10_000
TREES = 20
DEPTH = 4
SEED = 7
FOLDS = 5
PRIOR = 10.0
#: (host/path, verdict)
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters",
    "has_fragment", "has_extension", "secure", "last_label_length",
)
#: Features that are shares of blocked URLs, and the column whose value each is for.
RATES = {"suffix_blocked": "last", "domain_blocked": "domain", "part_blocked": "part"}


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    lower = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", url.alias("url"), lower.alias("host"), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def ruled(rows: DataFrame, rules: tuple = RULES) -> DataFrame:
    """rows with `rule` and its verdict, null where none fits."""
    table = [(k, r.partition("/")[0], "/" + r.partition("/")[2], r, v, len(r)) for k, (r, v) in enumerate(rules)]
    spark = rows.sparkSession
    known = F.broadcast(spark.createDataFrame(table, "place int, rule_host string, begin string, rule string, rule_verdict string, size int"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = let(labels, lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda k: F.array_join(F.slice(a, k, F.size(a)), ".")))
    each = numbered.select("*", F.explode(suffixes).alias("suffix")).join(
        known, (F.col("suffix") == F.col("rule_host")) & F.expr("startswith(path, begin)"), "left")
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct("size", -F.col("place")))
    return each.groupBy("_row", *rows.columns).agg(best.alias("r")).select(*rows.columns, "r.rule", "r.rule_verdict")


def entropy(text: Column) -> Column:
    """Bits per character, from the counts of its different characters."""
    def of(chars: Column) -> Column:
        def part(total: Column, c: Column) -> Column:
            share = F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
            return total - share * F.log2(share)

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), part)

    return F.when(F.length(text) > 0, let(F.split(text, ""), of)).otherwise(F.lit(0.0))


def featured(rows: DataFrame) -> DataFrame:
    """rows with the features but the RATES, and the columns that these are for."""
    labels = F.split("host", r"\.")
    length = F.length("url")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    ratio = lambda n: F.when(length > 0, n / length).otherwise(F.lit(0.0))
    return rows.withColumns({
        "last": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
        "part": F.regexp_extract("path", r"^/([^/]*)", 1), "length": length, "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.regexp_count("path", F.lit("/")), "labels": F.size(labels), "digit_ratio": ratio(F.regexp_count("url", F.lit("[0-9]"))),
        "hyphens": F.regexp_count("host", F.lit("-")), "entropy": entropy(F.col("host")),
        "parameters": F.when(query != "", F.regexp_count(query, F.lit("&")) + 1).otherwise(0),
        "has_fragment": F.col("url").contains("#").cast("int"), "has_extension": F.col("path").rlike(r"\.[a-z]+$").cast("int"),
        "secure": F.col("url").startswith("https").cast("int"),
        "last_label_length": F.length(F.substring_index("host", ".", -1)),
    })


def with_rates(rows: DataFrame, train: DataFrame, prior: float, place: Column) -> DataFrame:
    """rows with the RATES; `place` is the fold to leave out, or FOLDS for none. `train` has a bounded number of rows."""
    for name, column in RATES.items():
        sums = lambda c: F.array(*[F.sum(F.when(F.col("fold") != k, c).otherwise(0.0)) for k in range(FOLDS)], F.sum(c))
        seen = train.groupBy(F.col(column).alias("_value")).agg(sums(F.lit(1.0)).alias("_n"), sums(F.col("label")).alias("_blocked"))
        of = lambda c: F.coalesce(F.get(F.col(c), place), F.lit(0.0))
        rows = rows.join(F.broadcast(seen), F.col(column) == F.col("_value"), "left").withColumn(
            name, (of("_blocked") + prior * PRIOR) / (of("_n") + PRIOR)).drop("_value", "_n", "_blocked")
    return rows


def judged(pages: DataFrame, rules: tuple = RULES, sample: int = SAMPLE, held_out: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' own verdict for each page.

    URLs for which `held_out` (a condition on host, path or url) holds are not trained on.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rows = scratch.cut(featured(ruled(parts(pages), rules)), "features")
    vectors = VectorAssembler(inputCols=[*FEATURES, *RATES], outputCol="features")
    labelled = rows.filter("rule is not null") if held_out is None else rows.filter("rule is not null").filter(~held_out)
    labelled = labelled.dropDuplicates(["url"])  # rows of one URL have equal features
    train = labelled.withColumn("hash", F.xxhash64("url")).orderBy("hash", "url").limit(sample)
    train = scratch.cut(train.select(
        *FEATURES, *RATES.values(), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"),
        (F.col("rule_verdict") == "block").cast("double").alias("label")), "train")
    prior = train.agg(F.avg("label")).first()[0]
    if prior in (None, 0.0, 1.0):
        named = rows.withColumn("prediction", F.lit(prior or 0.0))
    else:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False)
        known = scratch.cut(with_rates(train, train, prior, F.col("fold")).select(*FEATURES, *RATES, "label"), "known")
        named = trees.fit(vectors.transform(known)).transform(vectors.transform(with_rates(rows, train, prior, F.lit(FOLDS))))
    own = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return named.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), own.alias("learned_verdict"))
