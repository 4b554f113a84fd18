"""The pipeline's stages one after the other on a small table."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import jaccard_join, mixing, piece_codec


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == names
        counts.append(docs.count())
        if name == "near_duplicates":
            found = jaccard_join.similar_components(before, k=5, percent=80)
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in found.collect()}
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] < counts[2]
    out = corpus_pipeline.run(spark, d).collect()
    want = piece_codec.round_trip(docs, piece_codec.default_model()).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, want))


def test_near_duplicates_of_four_edits(spark):
    """4 edits in 200 words: 0.886 on 3-word shingles, 0.815 on 5-word shingles."""
    words = [f"w{i}" for i in range(200)]
    edited = [f"x{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(words)]
    more = [f"y{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]  # 5 edits: 0.774
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, edited, more))], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs, k=5, percent=80).collect()) == [0, 2]
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs).collect()) == [0, 1, 2]


def jaccard_groups(texts, k, percent):
    """Smallest position of each text's group, by all pairs."""
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names the stages use themselves."""
    rng = random.Random(4)
    words = "the cat sat on the mat and it was happy with the house of them this is good for all people here".split()
    text = lambda n: " ".join(rng.choices(words, k=n)) + "."
    rows = [(i, text(40), "en", f"s{i % 3}") for i in range(40)]
    near = rows[5][1].split()
    near[38] = "changed"
    rows += [(50, " ".join(near), None, None), (51, rows[7][1], "en", "s9"), (None, rows[8][1], "en", "s0"), (None, None, None, None), (52, None, "en", "s1"), (53, "", None, "s1"), (54, " \n\t", "fr", None), (55, "12 34 !!", "en", "s0"), rows[9], rows[9], (56, text(60_000), "en", "s2")]
    names = ["gone_id", "gone_key", "row", "_row", "_mix_source", "h", "id", "key", "target", "copies", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` int" for x in names)
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *range(len(names))) for r in rows], schema)
    d = str(tmp_path / "sf")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(31, None, None), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, old = docs, [r.text for r in docs.orderBy(F.col("doc_id").asc_nulls_last()).collect()]
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        kept = Counter((r.doc_id, r.text) for r in docs.collect())
        was = Counter((r.doc_id, r.text) for r in before.collect())
        assert kept.keys() <= was.keys()
        if name == "language":
            assert all(t and any(c.isalpha() for c in t) for _, t in kept) and kept.total() == 46
        if name == "quality":
            assert kept == was  # labels of one class only: all score alike
        if name == "near_duplicates":
            groups = jaccard_groups(old, 5, 80)
            assert {t for _, t in kept} == {old[g] for g in groups} and kept[9, rows[9][1]] == 1 and set(kept.values()) == {1}
            assert (50, rows[40][1]) not in kept and (51, rows[7][1]) not in kept and (None, rows[8][1]) not in kept
        if name == "mixture":
            got = Counter()
            for r in mixing.assign(before).collect():
                got[r.doc_id] += r.copies
            assert got == Counter(r.doc_id for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, before.where("false"), d).count() == 0
