"""Fitted operators on the rows that they do not learn from, and language scores by plain sums."""

import math
from collections import Counter, defaultdict

import pytest

from daybook.llm import lang_id, quality_crf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_held_out(spark, docs):
    told = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [r for r in lang_id.identify(docs).collect() if r.held_out and told[r.doc_id] and r.lang_pred != "und"]
    right = sum(r.lang_pred == told[r.doc_id] for r in out)
    assert len(out) > 30 and right >= 0.97 * len(out)


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    out = [(marks[r.doc_id], r.score) for r in quality_crf.score_quality(docs, labels).collect() if r.held_out and r.doc_id in marks]
    good, bad = ([s for q, s in out if q == k] for k in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert len(out) >= 10 and auc >= 0.95


def test_language_scores_by_plain_sums(spark):
    """Words of the sample by their log frequency; others by the longest n-grams the sample knows, on average."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aba cab abba", "x"), ("bab ba b", "x"), ("zyz abz zz", "y"), ("yz zab", "y"), ("aba zz", "z")])]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = defaultdict(lambda: defaultdict(Counter))
    for _, text, lang in rows:
        for w in text.split():
            counts[0][lang][w] += 1
            for n in range(1, 6):
                padded = f"^{w}$"
                for i in range(len(padded) - n + 1):
                    counts[n][lang][padded[i : i + n]] += 1
    langs = ["x", "y", "z"]
    vocabulary = {n: set().union(*(counts[n][lang] for lang in langs)) for n in counts}

    def logp(n, piece, lang):
        return math.log((counts[n][lang][piece] + 0.5) / (counts[n][lang].total() + 0.5 * len(vocabulary[n])))

    def score(text, lang):
        total = 0.0
        for w in text.split():
            if w in vocabulary[0]:
                total += logp(0, w, lang)
                continue
            padded = f"^{w}$"
            for n in range(min(5, len(padded)), 0, -1):
                known = [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] in vocabulary[n]]
                if known:
                    total += sum(logp(n, g, lang) for g in known) / len(known)
                    break
        return total

    texts = ["aba", "zzz abc", "cabba zy", "q", "bab zz qqq", "abab yzyz aba"]
    out = {r.doc_id: r for r in lang_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lang_id.fit(train)).collect()}
    for i, text in enumerate(texts):
        s = {lang: score(text, lang) for lang in langs}
        best = max(langs, key=lambda x: (s[x], -langs.index(x)))
        assert out[i].lang_pred == best
        assert math.isclose(out[i].score, 1 / sum(math.exp(v - s[best]) for v in s.values()), rel_tol=1e-9)


def test_an_id_repeated_often(spark):
    """One labelled id on 20,000 rows of one text counts once."""
    rows = [(1, "aa bb", "x")] * 20_000 + [(2, "cc dd", "y")]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["x", "y"] and set(model.words) == {"aa", "bb", "cc", "dd"}
    assert abs(model.word_logp[model.words["aa"]][0] - model.word_logp[model.words["cc"]][1]) < 1e-9
