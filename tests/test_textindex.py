"""The stored text index against scans of the same texts."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import search, textindex
from daybook.sources.store import signature

COLUMNS = ["text", "app"]


@pytest.fixture(autouse=True)
def few_files(monkeypatch):
    monkeypatch.setattr(textindex, "BUCKETS", 4)
    monkeypatch.setattr(textindex, "PARTS", 4)


def rows(spark, seed=1, n=120):
    rng = random.Random(seed)
    words = ["spark", "Delta", "naïve", "of", "the", "plan", "42"]
    made = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["Editor", "the app", None])) for i in range(n)]
    made += [(900, None, None), (901, "", ""), (902, "of the " * 5000, "x")]
    return spark.createDataFrame(made, "id long, text string, app string")


PHRASES = [[["spark"]], [["of", "the"]], [["naive"], ["42"], ["nothing"]], [["of", "the", "plan"]], [["nothing"]], [[]]]


def scores(df):
    return sorted((r["id"], round(r["score"], 9)) for r in df.collect())


def test_scores_equal_those_of_a_scan(spark, tmp_path):
    df = rows(spark)
    index = textindex.build(df, COLUMNS, str(tmp_path), "s")
    assert index.rows == df.count() and not textindex.damaged(index)
    for phrases in PHRASES:
        assert scores(search.bm25(None, COLUMNS, phrases, index=index)) == scores(search.bm25(df, COLUMNS, phrases)), phrases
    plan = index.postings("spark")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_a_changed_table_is_mended(spark, tmp_path):
    folder, df = str(tmp_path), rows(spark)
    first = textindex.ensure(df, COLUMNS, folder, "one")
    assert textindex.ensure(df, COLUMNS, folder, "one").generation == first.generation
    changed = df.where("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 7 == 1, "wholly new words").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(5000, "the plan", "y")], df.schema))
    found = {r["id"]: r["problem"] for r in textindex.differences(first, changed).collect()}
    assert found[5000] == "missing" and found[5] == "extra" and found[8] == "stale" and 2 not in found
    second = textindex.ensure(changed, COLUMNS, folder, "two")
    assert second.generation != first.generation and textindex.differences(second, changed).count() == 0
    for phrases in PHRASES:
        assert scores(search.bm25(None, COLUMNS, phrases, index=second)) == scores(search.bm25(changed, COLUMNS, phrases))
    assert textindex.current(spark, folder).generation == second.generation and textindex.current(spark, folder, "one").generation == first.generation
    assert textindex.differences(first, df).count() == 0  # the older generation stands as it was


def size(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))


def test_a_small_change_writes_a_small_segment(spark, tmp_path):
    folder, df = str(tmp_path), rows(spark, n=890)
    index = textindex.build(df, COLUMNS, folder)
    whole = {t: size(f"{index.path}/{t}/seg={index.segments[0][0]}") for t in ("texts", "rows", "tops")}
    few = df.where("id < 9").withColumn("text", F.concat("text", F.lit(" fresh")))
    second = textindex.change(index, folder, "t", rows=few, ids=spark.createDataFrame([(900,), (31,), (77_777,)], "id long"))
    assert [n for _, n, _ in second.segments] == [index.rows, 9] and second.gone[0][1] == 11 and second.rows == index.rows - 2
    # rows and texts written are a hundredth (their files hold a fixed part too)
    assert sum(second.table(t, [second.segments[1][0]]).count() for t in ("texts", "rows")) <= 0.02 * sum(index.table(t).count() for t in ("texts", "rows"))
    assert all(size(f"{index.path}/{t}/seg={second.segments[1][0]}") < w / 2 for t, w in whole.items() if t != "rows")
    changed = df.where("id not in (900, 31) and id >= 9").unionByName(few)
    assert textindex.differences(second, changed).count() == 0 and not textindex.damaged(second)
    for phrases in [*PHRASES, [["fresh"]]]:
        assert scores(search.bm25(None, COLUMNS, phrases, index=second)) == scores(search.bm25(changed, COLUMNS, phrases)), phrases
    one = textindex.compact(second, folder)
    assert len(one.segments) == 1 and not one.gone and one.rows == second.rows
    assert scores(search.bm25(None, COLUMNS, [["spark"]], index=one)) == scores(search.bm25(changed, COLUMNS, [["spark"]]))
    assert textindex.vacuum(spark, folder, keep=1) == sorted(x for x, *_ in second.segments)
    assert textindex.there(textindex.current(spark, folder)) and not textindex.there(second)


def test_segments_of_like_size_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "FANOUT", 2)
    folder, df = str(tmp_path), rows(spark, n=16)
    index = textindex.build(df.where("id < 4"), COLUMNS, folder)
    for k in (1, 2, 3):
        index = textindex.change(index, folder, "", rows=df.where(f"id between {4 * k} and {4 * k + 3}"))
    assert sum(n for _, n, _ in index.segments) == 16 and len(index.segments) == 1
    assert scores(search.bm25(None, COLUMNS, [["of", "the"]], index=index)) == scores(search.bm25(df.where("id < 16"), COLUMNS, [["of", "the"]]))


def test_the_best_rows_of_a_frequent_term_come_from_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "FREQUENT", 16)
    rng = random.Random(9)
    made = [(i, " ".join(["spark"] * rng.choice([1, 1, 1, 2, 3, 9]) + ["word"] * rng.randint(0, 40)), rng.choice(["Editor", "word"])) for i in range(1500)]
    df = spark.createDataFrame(made, "id long, text string, app string")
    folder = str(tmp_path)
    index = textindex.build(df, COLUMNS, folder)
    more = spark.createDataFrame([(5, "spark spark", "word"), (2000, "spark " * 30, "x"), (2001, "nothing", "x")], df.schema)
    for index, source in ((index, df), (textindex.change(index, folder, "", rows=more), df.where("id <> 5").unionByName(more))):  # noqa: B020
        for allowed in (source.select("id"), source.where("id % 7 = 0").select("id")):
            want = search.bm25(source, COLUMNS, [["spark"]]).join(allowed, "id", "left_semi").orderBy("score", "id").limit(25)
            got = search.best_of_term(index, "spark", allowed, 25)
            assert [(r["id"], round(r["score"], 9)) for r in got.orderBy("score", "id").collect()] == [(r["id"], round(r["score"], 9)) for r in want.collect()]
        _, n, read = index.best("spark", 25)
        assert n >= 1500 and read < n / 3  # counted in rows of the blocks that were read
    # a rare term and one of both columns have no blocks
    assert search.best_of_term(index, "nothing", df.select("id"), 5) is None and search.best_of_term(index, "word", df.select("id"), 5) is None


@pytest.mark.parametrize("harm", ["postings", "texts", "tops"])
def test_a_damaged_index_is_rebuilt(spark, tmp_path, monkeypatch, harm):
    monkeypatch.setattr(textindex, "FREQUENT", 16)
    folder, df = str(tmp_path), rows(spark)
    index = textindex.build(df, COLUMNS, folder, "s")
    victim = max(glob.glob(f"{index.path}/{harm}/**/*.parquet", recursive=True), key=os.path.getsize)
    os.remove(victim)
    spark.catalog.refreshByPath(index.path)
    assert textindex.damaged(index)
    new = textindex.repair(df, COLUMNS, folder, "s")
    assert new.generation != index.generation and not textindex.damaged(new)
    assert scores(search.bm25(None, COLUMNS, [["spark"]], index=new)) == scores(search.bm25(df, COLUMNS, [["spark"]]))


def test_a_cleared_store_is_built_anew(spark, tmp_path):
    folder, df = str(tmp_path), rows(spark)
    index = textindex.ensure(df, COLUMNS, folder, "s")
    for f in glob.glob(f"{index.path}/**/*.parquet", recursive=True):
        os.remove(f)
    spark.catalog.refreshByPath(index.path)
    new = textindex.ensure(df, COLUMNS, folder, "s")
    assert new.generation != index.generation and scores(search.bm25(None, COLUMNS, [["spark"]], index=new)) == scores(search.bm25(df, COLUMNS, [["spark"]]))


def test_empty_table_and_signature(spark, tmp_path):
    index = textindex.build(rows(spark).where("false"), COLUMNS, str(tmp_path / "i"))
    assert index.rows == 0 and search.bm25(None, COLUMNS, [["spark"]], index=index).count() == 0
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    before = signature(spark, path)
    assert signature(spark, path) == before
    spark.range(1).write.mode("append").parquet(path)
    assert signature(spark, path) != before


def moved(spark):
    """Rows that stages of this session have written to exchanges."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_building_moves_each_posting_once(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(words, 300)), None) for i in range(120)], "id long, text string, app string")
    before = moved(spark)
    index = textindex.build(df, COLUMNS, str(tmp_path))
    assert index.table("postings").count() == 300 * 120 and moved(spark) - before < 2 * 300 * 120


def test_rows_that_share_texts_are_indexed_by_key(spark, tmp_path):
    df = rows(spark)
    cells = df.select("id", F.array(*[textindex.cell(F.col(c)) for c in COLUMNS]).alias("cells"))
    texts = df.select(F.coalesce("text", F.lit("")).alias("text")).union(df.select(F.coalesce("app", F.lit("")))).union(spark.createDataFrame([("of no row",)], "text string"))
    index = textindex.build(textindex.Source(cells, texts), COLUMNS, str(tmp_path))
    assert textindex.differences(index, df).count() == 0 and not textindex.damaged(index)
    for phrases in PHRASES[:2]:
        assert scores(search.bm25(None, COLUMNS, phrases, index=index)) == scores(search.bm25(df, COLUMNS, phrases))
