"""Repeated doc_ids and clashing column names, in any order of rows."""

import itertools
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marquee.llm import decontaminate, mixing, near_dedup, queries, token_output
from marquee.llm.common import Scratch

WORDS = [f"w{k}" for k in range(60)]
A, B = " ".join(WORDS[:40]), " ".join(WORDS[20:])
A2, B2 = A + " more", B + " more"


def frame(spark, rows, more="", values=()):
    return spark.createDataFrame([(*r, *values) for r in rows], "doc_id long, text string" + more)


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::11])
def test_each_text_of_a_doc_id_is_a_document(spark, order):
    rows = [(1, A), (1, B), (2, A2), (3, B2)]
    df = frame(spark, [rows[k] for k in order]).coalesce(1)
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "component_id", "kept").collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert sorted(tuple(r) for r in near_dedup.without_copies(df).collect()) == sorted(rows[:2])


def test_kept_text_of_a_doc_id_that_also_has_a_dropped_one(spark):
    rows = [(1, A), (2, A2), (2, B), (3, B2), (4, None), (4, None), (4, ""), (None, A), (None, A), (5, A), (5, A)]
    kept = sorted((tuple(r) for r in near_dedup.without_copies(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, A), (2, B), (4, None), (4, ""), (None, A), (None, A)], key=str)


def test_two_texts_of_the_smallest_id_in_one_class(spark):
    kept = near_dedup.without_copies(frame(spark, [(1, A), (1, A2), (2, A)])).collect()
    assert len(kept) == 1 and kept[0].doc_id == 1


def test_of_equal_texts_the_same_row_stays(spark):
    rows = [(1, A, k) for k in range(6)]
    stay = {near_dedup.without_copies(spark.createDataFrame(rows[n:] + rows[:n], "doc_id long, text string, extra int").coalesce(1)).first().extra for n in (0, 3)}
    assert len(stay) == 1


CLASH = ", source string, wanted int, hash int, row int, id int, _id string, _copies int, copies int, _row int, nth int, `of` int, _n int, n_words int, order int, `a.b` int"
VALUES = ("s", 1, 2, 3, 4, "mine", 5, 6, 7, 8, 9, 10, 11, 12, 13)


def test_stages_leave_columns_of_any_name_alone(spark):
    df = frame(spark, [(k, f"{A} {k} " + " ".join(f"own{k}x{j}" for j in range(40))) for k in range(8)] + [(9, None)], CLASH, VALUES)
    items = spark.createDataFrame([(k, f"own{k}x1 own{k}x2 own{k}x3 own{k}x4 own{k}x5 own{k}x6 own{k}x7 own{k}x8 own{k}x9 own{k}x10 own{k}x11") for k in range(3)], "item_id int, text string")
    outs = [near_dedup.without_copies(df), mixing.copies_of(df), decontaminate.without_benchmark(df, items), decontaminate.without_benchmark(df, items, block_words=11)]
    for out in outs:
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(tuple(r)[2:] == VALUES for r in rows)
    assert sorted(map(str, outs[2].collect())) == sorted(map(str, outs[3].collect()))
    ids = token_output.encoded_documents(df, queries.tokenizer_path("byte_bpe_50k.json"))
    assert ids.count() == df.count()


def test_mix_of_repeated_rows_is_the_same_again(spark):
    rows = [(k % 5, f"{A} t{k % 7}", "s" if k % 3 else None, k) for k in range(60)]
    found = []
    for turn in (0, 30):
        df = spark.createDataFrame(rows[turn:] + rows[:turn], "doc_id long, text string, source string, extra int").repartition(3)
        found.append(Counter(tuple(r) for r in mixing.copies_of(df).collect()))
    assert found[0] == found[1]


def test_token_files_order_equal_and_null_ids(spark):
    df = frame(spark, [(7, f"text {k}") for k in range(30)] + [(None, "none"), (3, "three")]).repartition(4)
    runs = [token_output.encoded_documents(x, queries.tokenizer_path("byte_bpe_50k.json")).orderBy("start").collect() for x in (df, df.repartition(2))]
    assert runs[0] == runs[1]
    assert [r.doc_id for r in runs[0]] == [None, 3] + [7] * 30
    at = 0
    for r in runs[0]:
        assert r.start == at
        at += r.n_tokens


def test_rows_are_dealt_once_where_copies_are_left_out(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near_dedup.without_copies(frame(spark, [(1, A), (2, A2), (3, None)]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.split("\n")
    last = next(k for k, x in enumerate(lines) if "functions=[min_by(row" in x)
    first = next(k for k, x in enumerate(lines) if "functions=[partial_min_by(row" in x)
    assert not any("Exchange" in x for x in lines[last:first])


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in folders for p in Path(d.getPath()).rglob("shuffle_*")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    scratch, before = Scratch(spark, "cleanup"), shuffle_files(spark)
    rows = scratch.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert sorted(map(tuple, rows.collect()))[0] == (0, 143)


def test_only_kept_tables_stay(spark):
    scratch = Scratch(spark, "keep")
    scratch.cut(spark.range(3), "one")
    two = scratch.cut(spark.range(5), "two")
    folder = Path(scratch.root.removeprefix("file:"))
    scratch.keep(two)
    assert [p.name for p in folder.iterdir()] == ["002-two"] and two.count() == 5
