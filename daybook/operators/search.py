"""Keyword, vector and hybrid retrieval.

Keyword scores are BM25 with k1 1.2 and b 0.75; an idf that would not be
positive is 1e-6. A score's sign is that of a rank: more negative is better.
Corpus statistics cover all indexed rows; filters come after the match.

Scores come from a stored index (``textindex``), which reads only the buckets
of the terms asked for, or, for rows without one, from one scan of their texts.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.text import bound, snippet
from daybook.operators.stats import in_range, ok
from daybook.operators.textindex import MARKED, PLAIN, TextIndex, tokens
from daybook.operators.timeline import contains, newest_first

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(MARKED, PLAIN))


def query_tokens(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", fold(text))


def _hits(words: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs, word by word, in an array of tokens."""

    def starts(w: Column, i: Column) -> Column:
        found = w == phrase[0]
        for n, word in enumerate(phrase[1:], 1):
            found = found & F.coalesce(F.get(words, i + n) == word, F.lit(False))
        return found

    return F.size(F.filter(words, starts))


def _counts(rows: DataFrame, columns: list[str], phrases: list[list[str]], id_col: str) -> DataFrame:
    """``(id, len, f0, f1 ...)`` of every row, by one scan of its texts."""
    def counted(words: Column) -> Column:
        every = [words[f"_{i}"] for i in range(len(columns))]
        return F.struct(sum((F.size(w) for w in every), F.lit(0)).alias("len"), *[sum((_hits(w, p) for w in every), F.lit(0)).alias(f"f{j}") for j, p in enumerate(phrases)])

    # bound, as the optimiser puts the splitting of a text into the function that looks at each of its words
    words = F.struct(*[tokens(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    return rows.select(F.col(id_col).alias("id"), bound(words, counted).alias("c")).select("id", "c.*")


def _indexed_counts(index: TextIndex, phrases: list[list[str]]) -> DataFrame:
    """``(id, len, f0, f1 ...)`` of the rows that match, out of the index."""
    found = None
    for j, phrase in enumerate(phrases):
        part = index.hits(phrase).select("key", *[(F.col("f") if i == j else F.lit(0)).alias(f"f{i}") for i in range(len(phrases))])
        found = part if found is None else found.unionByName(part)
    sums = [F.sum(f"f{j}").alias(f"f{j}") for j in range(len(phrases))]
    return index.matches(found.groupBy("key").agg(*sums)).groupBy("id").agg(F.first("len").alias("len"), *sums)


def bm25(rows: DataFrame | None, columns: list[str], phrases: list[list[str]], id_col: str = "id", *, index: TextIndex | None = None) -> DataFrame:
    """``(id, score)`` of the rows that match any of the phrases (lists of words):
    out of ``index`` if there is one, else of ``rows``."""
    phrases = [p for p in phrases if p]
    if not phrases:
        none = rows if rows is not None else index.table("rows")
        return none.where("false").select(F.col(id_col if rows is not None else "id").alias("id"), F.lit(0.0).alias("score"))
    if index is not None:
        sized = _indexed_counts(index, phrases)
        totals = [F.lit(index.rows).alias("N"), F.lit(index.words).alias("total")]
    else:
        # one narrow exchange that both the statistics and the scores read, so texts are split into words once
        sized = _counts(rows, columns, phrases, id_col).repartition("id")
        totals = [F.count(F.lit(1)).alias("N"), F.sum("len").alias("total")]
    stats = sized.agg(*totals, *[F.count_if(F.col(f"f{j}") > 0).alias(f"n{j}") for j in range(len(phrases))])
    hit = sum((F.col(f"f{j}") for j in range(len(phrases))), F.lit(0)) > 0
    both = sized.crossJoin(F.broadcast(stats)).where(hit)  # one row of statistics
    score = F.lit(0.0)
    for j in range(len(phrases)):
        f, n = F.col(f"f{j}"), F.col(f"n{j}")
        idf = F.log((F.col("N") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("N"))))
    return both.select("id", score.alias("score"))


def best_of_term(index: TextIndex, term: str, allowed: DataFrame, limit: int) -> DataFrame | None:
    """``(id, score)`` of the best rows of one term, out of the first blocks of a
    frequent one; None for a term without blocks. Scores are those of ``bm25``."""
    best = index.best(term, limit, allowed)
    if best is None:
        return None
    found, n, _ = best
    idf = log((index.rows - n + 0.5) / (n + 0.5))
    return found.select("id", (-(idf if idf > 0 else LEAST_IDF) * F.col("weight")).alias("score"))


def cosine(vector: str, query: list[float]) -> Column:
    """Inner product with a unit query vector, in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, query: list[float], top: int, *, cap: int | None = None, above: float = 0.1) -> DataFrame:
    """The rows nearest to a unit vector among all embedded ones (or the newest
    ``cap`` of them), above a least similarity; ties to the larger id."""
    some = rows.where(F.col("embedding").isNotNull())
    if cap is not None:
        some = some.orderBy(*newest_first()).limit(cap)
    scored = some.withColumn("similarity", cosine("embedding", query)).where(F.col("similarity") > above)
    return scored.orderBy(F.col("similarity").desc(), F.col("id").desc()).limit(top)


def keyword_hits(activities: DataFrame, columns: list[str], phrases: list[list[str]], limit: int, *, only_ok: bool = True, first: str | None = None, last: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """``(id, score, place)`` of the best matches, places from 0."""
    kept = in_range(ok(activities) if only_ok else activities, first, last).select("id")
    found = best_of_term(index, phrases[0][0], kept, limit) if index is not None and len(phrases) == 1 and len(phrases[0]) == 1 else None
    if found is None:
        found = bm25(activities, columns, phrases, index=index).join(kept, "id", "left_semi").orderBy("score", "id").limit(limit)
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "id")) - 1)  # over ``limit`` rows


def meeting_hits(meetings: DataFrame, query: str, limit: int, *, around: int = 80, otherwise: int = 200, first: str | None = None, last: str | None = None) -> DataFrame:
    """Meetings whose transcript or summary contains the query, newest first, with a snippet."""
    m = in_range(meetings.withColumn("date", F.col("start_time").cast("date")), first, last)
    m = m.where(F.coalesce(contains(F.col("transcript"), query), F.lit(False)) | F.coalesce(contains(F.col("summary"), query), F.lit(False)))
    m = m.orderBy(F.col("start_time").desc(), F.col("id").desc()).limit(limit)
    return m.select("id", "start_time", "app_name", "duration_minutes", "summary", snippet(F.col("transcript"), query, around, otherwise).alias("snippet"))


def hybrid(activities: DataFrame, meetings: DataFrame, columns: list[str], query: str, vector: list[float], limit: int = 20, *, category: str | None = None, first: str | None = None, last: str | None = None, index: TextIndex | None = None, known: DataFrame | None = None) -> DataFrame:
    """Vector, keyword and meeting results fused: of each kind the best ``limit``
    of all rows, as a keyword's relevance is its place among those shown. The
    category limits the vector results only; the dates limit all three. With an
    index, ``known`` may be the activities without what is joined on."""
    rows = in_range(ok(activities), first, last)
    sem = nearest(rows.where(F.col("category") == category) if category else rows, vector, limit).select("id", F.round("similarity", 3).alias("sem"))
    hits = keyword_hits(activities if known is None else known, columns, [query_tokens(query)], limit, first=first, last=last, index=index)
    n = hits.agg(F.count(F.lit(1)).alias("n"))
    kw = hits.crossJoin(F.broadcast(n)).select("id", F.round(0.7 - F.col("place") * 0.4 / F.greatest(F.col("n") - 1, F.lit(1)), 3).alias("kw"))
    both = sem.join(kw, "id", "full_outer")
    score = F.when(F.col("sem").isNotNull() & F.col("kw").isNotNull(), F.least(F.col("sem") + 0.1, F.lit(1.0))).otherwise(F.coalesce("sem", "kw"))
    match = F.when(F.col("sem").isNotNull() & F.col("kw").isNotNull(), "hybrid").when(F.col("sem").isNotNull(), "semantic").otherwise("keyword")
    out = both.select(F.col("id").cast("string").alias("id"), score.alias("relevance"), match.alias("match_type"))
    met = meeting_hits(meetings, query, limit, first=first, last=last).select(F.concat(F.lit("meeting-"), F.col("id").cast("string")).alias("id"), F.lit(0.6).alias("relevance"), F.lit("meeting").alias("match_type"))
    return out.unionByName(met).orderBy(F.col("relevance").desc(), "match_type", "id").limit(limit)


def tool_search(activities: DataFrame, columns: list[str], query: str, vector: list[float], limit: int = 10, *, index: TextIndex | None = None, known: DataFrame | None = None) -> DataFrame:
    """Vector results, then keyword results at a constant relevance; nothing is boosted.
    The best ``limit`` of all rows by either measure are enough for the best ``limit`` of both.
    With an index, ``known`` may be the activities without what is joined on."""
    sem = nearest(ok(activities), vector, limit).select("id", F.round("similarity", 3).alias("relevance"), F.lit("semantic").alias("match"))
    kw = keyword_hits(activities if known is None else known, columns, [query_tokens(query)], limit, index=index).join(sem.select("id"), "id", "left_anti").select("id", F.lit(0.5).alias("relevance"), F.lit("keyword").alias("match"))
    return sem.unionByName(kw).orderBy(F.col("relevance").desc(), F.col("match").desc(), "id").limit(limit)


def chat_candidates(activities: DataFrame, columns: list[str], words: list[str], *, probe: int = 25, fill: int = 10, enough: int = 3, index: TextIndex | None = None) -> DataFrame:
    """Rows for an answer: the best ``probe`` matches of any word, whatever
    their status, of which analysed ones are kept; if fewer than ``enough``
    are, the newest embedded rows fill up to ``fill``. Column place: that of
    the match, null for filled ones."""
    hits = keyword_hits(activities, columns, [query_tokens(w) for w in words], probe, only_ok=False, index=index).select("id", "place")
    good = ok(activities)
    found = good.join(F.broadcast(hits), "id")
    newest = good.where(F.col("embedding").isNotNull()).orderBy(*newest_first()).limit(fill)
    more = newest.join(found.select("id"), "id", "left_anti").withColumn("place", F.lit(None).cast("int"))
    count = found.agg(F.count(F.lit(1)).alias("have"))
    ranked = more.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*newest_first())))  # over ``fill`` rows
    more = ranked.crossJoin(F.broadcast(count)).where((F.col("have") < enough) & (F.col("have") + F.col("r") <= fill)).drop("r", "have")
    return found.unionByName(more.select(found.columns))


def rerank(candidates: DataFrame, vector: list[float], now: str, hits: int, top: int = 5) -> DataFrame:
    """Of ``candidates`` the best by similarity, recency and keyword place. If none
    of them has a vector, all count 0.5 and keep their order (place, then newest)."""
    scored = candidates.withColumn("similarity", cosine("embedding", vector))
    all_ = Window.partitionBy(F.lit(0))  # candidates are few
    near = F.row_number().over(all_.orderBy(F.col("similarity").desc(), F.col("id").desc()))
    scored = scored.withColumn("near", near).withColumn("embedded", F.count("embedding").over(all_) > 0)
    age = F.greatest((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / F.lit(3.6e9), F.lit(0.0))
    recency = 1.0 / (1.0 + F.coalesce(age, F.lit(24.0)) * 0.05)
    keyword = 0.1 * (1.0 - F.coalesce("place", F.lit(hits)) / F.lit(float(max(hits, 1))))
    final = F.round(F.col("similarity") * 0.7 + recency * 0.2 + keyword * 0.1, 3)
    relevance = F.when(~F.col("embedded"), 0.5).when(F.col("embedding").isNotNull() & (F.col("near") <= 5) & (F.col("similarity") > 0.1), final).otherwise(0.05)
    order = F.when(~F.col("embedded"), F.col("place")).asc_nulls_last()
    return scored.withColumn("relevance", relevance).orderBy(F.col("relevance").desc(), order, *newest_first()).limit(top).select("id", "timestamp", "relevance")


def fallback(activities: DataFrame, vector: list[float], gate: float = 0.35, top: int = 5, cap: int | None = 500) -> DataFrame:
    """The nearest of the newest ``cap`` rows (None: of all), if the best of them is near enough; else none."""
    found = nearest(ok(activities), vector, top, cap=cap).select("id", F.round("similarity", 3).alias("relevance"))
    best = found.agg(F.max("relevance").alias("best"))
    return found.crossJoin(F.broadcast(best)).where(F.col("best") >= gate).drop("best")
