"""Language ID learns from every language and from whole texts."""

from daybook.llm import lang_id


def test_sample_per_language_and_whole_texts(spark):
    rows = [(i, "the cat sat", "en") for i in range(300)] + [(1000, "zzyx " * 2000 + "qwoph", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs, max_rows=5)
    assert model.langs == ["en", "xx"]
    assert {"zzyx", "qwoph"} <= set(model.words)
    got = lang_id.predict(spark.createDataFrame([(1, "zzyx"), (2, "cat")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "xx", 2: "en"}
