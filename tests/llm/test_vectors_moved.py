"""What the vector search moves grows with its vectors, not with queries times annuli."""

from pyspark.sql import functions as F

from daybook.llm import topk_search


def written(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_queries_are_not_copied_to_each_annulus(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "TILE", 16)
    n, dim = 16_000, 24
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(i).cast("float") for i in range(dim)]).alias("embedding"))
    before = written(spark)
    out = topk_search.top_k(rows).collect()
    assert len(out) == 5 * n // 50
    assert written(spark) - before < 4 * n * dim * 4
