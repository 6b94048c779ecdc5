"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from marquee.session import ensure_checkpoint_dir

#: White space between words, and what stands between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
#: Spark's switch for removing the shuffle files of a query when it ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that one job writes below the shared checkpoint folder and reads again.

    A step that is read more than once is written here: what follows restarts from the files when an
    executor is lost. Shuffle files of a step go as soon as its table is written, not when the driver next
    collects its garbage. `drop` removes a table as soon as nothing reads it any more, `keep` all but some.
    """

    def __init__(self, spark: SparkSession, job: str):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{job}-{uuid.uuid4().hex}"
        self.written = 0

    def path(self, name: str) -> str:
        self.written += 1
        return f"{self.root}/{self.written:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
        path, before = self.path(name), self.spark.conf.get(CLEANUP_CONF, None)
        self.spark.conf.set(CLEANUP_CONF, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP_CONF) if before is None else self.spark.conf.set(CLEANUP_CONF, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that `cut` returned, through the file system that holds them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if self.root.rpartition("/")[2] in folder:
                path.getFileSystem(conf).delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables that `cut` has written for this job but these."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        wanted = {f.split("/")[-2] for t in tables for f in t.inputFiles()}
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        for status in root.getFileSystem(conf).listStatus(root):
            if status.getPath().getName() not in wanted:
                root.getFileSystem(conf).delete(status.getPath(), True)


def release() -> None:
    """Hand memory that is free in this Python process back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_BYTES, where the session has Spark's own bound: whole
    texts are large, and a batch is in memory several times. Free memory is given back after each task."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF).rstrip("bB") == str(64 << 20):
        conf.set(BATCH_CONF, str(BATCH_BYTES))

    def released(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between white space; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, scratch: Scratch, buckets: int = 256) -> DataFrame:
    """df with a gapless number from 0 within each group, ordered by a hash of `order`, then by it.

    A group is dealt over `buckets` by that hash, so that a hot group is numbered by many tasks; the
    numbers of rows in a group's buckets (at most `buckets` rows per group) give each its start.
    `order` should tell rows apart; equal rows take the next numbers in any order.
    """
    held = scratch.cut(df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")), name)
    counts = held.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = W.Window.partitionBy(*group).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    keys = [*group, "_bucket"]
    starts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.Window.partitionBy(*keys).orderBy(*order)
    ranked = held.withColumn("_rank", F.row_number().over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return ranked.join(starts, same, "left").select(*df.columns, (F.col("_start") + F.col("_rank") - 1).cast("long").alias(name))


def text_slices(batch, column: int, most_bytes: int = 1 << 20) -> Iterator[tuple]:
    """(first row, Arrow texts, null as "") of a batch, in slices of about `most_bytes`; a longer text stands alone."""
    import pyarrow.compute as pc

    texts = pc.fill_null(batch.column(column), "")
    start, held = 0, 0
    for k, size in enumerate(pc.binary_length(texts).to_pylist()):
        if k > start and held + size > most_bytes:
            yield start, texts.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(texts):
        yield start, texts.slice(start)


def unit_codes(texts, white: bool = False) -> tuple:
    """Texts split at each space (or at runs of ASCII white space): where each text's units begin, each
    unit's place among the different units, and these. With `white`, units may be empty at a text's ends."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts) if white else pc.split_pattern(texts, " ")
    units = lists.values.dictionary_encode()
    offsets = lists.offsets.to_numpy().astype("int64")
    return offsets, units.indices.to_numpy().astype("int64"), units.dictionary.to_pylist()


def word_codes(texts) -> tuple:
    """Words of Arrow texts between ASCII white space: where each text's words begin (and the last ends),
    each word's place among the different ones, and these as an Arrow array (it may hold an unused "")."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts)
    units = lists.values.dictionary_encode()
    place, words = units.indices.to_numpy(), units.dictionary
    filled = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[place]  # texts can end with empty ones
    before = np.concatenate([[0], np.cumsum(filled)])
    return before[lists.offsets.to_numpy()], place[filled], words


def word_bytes(words) -> list[bytes]:
    """The values of an Arrow text array."""
    import pyarrow as pa

    return words.cast(pa.binary()).to_pylist()
