"""What building the text index moves, and its tables when texts, terms and files are many."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import search, textindex

COLUMNS = ["text", "app"]


@pytest.fixture(autouse=True)
def few_files(monkeypatch):
    monkeypatch.setattr(textindex, "BUCKETS", 4)
    monkeypatch.setattr(textindex, "PARTS", 4)


def rows(spark, n=160):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["app", "7"]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["app 7", "app", "w3 w3", None])) for i in range(n)], "id long, text string, app string")


def scores(df):
    return sorted((r["id"], round(r["score"], 9)) for r in df.collect())


def moved(spark):
    """Rows that stages of this session have written to exchanges."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_building_moves_no_postings(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(words, 300)), None) for i in range(120)], "id long, text string, app string")
    before = moved(spark)
    index = textindex.build(df, COLUMNS, str(tmp_path))
    assert index.table("postings").count() == 300 * 120 and moved(spark) - before < 300 * 120 / 4


def test_many_files_and_rounds_of_frequent_terms(spark, tmp_path, monkeypatch):
    for name, value in (("SPLIT", 500), ("MANY", 1), ("FREQUENT", 8), ("SMALL", 5)):
        monkeypatch.setattr(textindex, name, value)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = rows(spark)
    index = textindex.build(df, COLUMNS, str(tmp_path))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert len(glob.glob(f"{index.path}/postings/seg=*/bucket=0/*.parquet")) > 4  # a file of each part of the texts
    assert not textindex.damaged(index) and textindex.differences(index, df).count() == 0
    for phrases in ([["w5"]], [["app"], ["7"]], [["app", "7"]], [["w3"]]):
        assert scores(search.bm25(None, COLUMNS, phrases, index=index)) == scores(search.bm25(df, COLUMNS, phrases)), phrases
    want = search.bm25(df, COLUMNS, [["w5"]]).orderBy("score", "id").limit(9)
    assert scores(search.best_of_term(index, "w5", df.select("id"), 9)) == scores(want)


def test_a_term_of_several_columns_counts_a_row_once(spark, tmp_path):
    df = rows(spark)
    index = textindex.build(df, COLUMNS, str(tmp_path))
    index = textindex.change(index, str(tmp_path), "", rows=spark.createDataFrame([(900, "app app", "app"), (3, "w3", "w3 w3")], df.schema))
    now = df.where("id <> 3").unionByName(spark.createDataFrame([(900, "app app", "app"), (3, "w3", "w3 w3")], df.schema))
    for term in ("app", "7", "w3", "w8"):
        n, _, rare = index.frequency(term)
        assert n == now.where(F.array_contains(textindex.tokens(F.concat_ws(" ", "text", "app")), term)).count(), term
        assert len(rare) == len(set(rare))
