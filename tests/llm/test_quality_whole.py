"""The quality classifier learns from whole texts."""

from daybook.llm import quality_crf


def test_learns_from_late_lines(spark, monkeypatch):
    seen = []
    learn = quality_crf._learn
    monkeypatch.setattr(quality_crf, "_learn", lambda feats, lengths, spans, labels: seen.append(lengths.sum()) or learn(feats, lengths, spans, labels))
    good, bad = ["the cat sat on the mat"] * 1500, ["the cat sat on the mat"] * 1000 + ["BUY NOW!! $$$ | | |"] * 500
    docs = spark.createDataFrame([(1, "\n".join(good), 1), (2, "\n".join(bad), 0)], "doc_id long, text string, quality int")
    quality_crf.fit(docs)
    # lengths count a line's end, which the last line has not
    assert seen == [sum(len(x) + 1 for x in good + bad) - 2]
