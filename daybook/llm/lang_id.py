"""Language identification by word-first backoff.

A word that the model knows adds its log frequency in each language. For an
unseen word the model backs off to the longest character n-grams of the padded
word that it knows: order ``max_n`` first, then shorter ones down to 1. The model
holds every word and n-gram of the rows it is fitted on; only those rows are bounded.

Defined results: a null text, or one without any letter, is ``und`` with score
0; so is every text if the model was fitted on no labelled row. Repeated rows
are scored alike. Ties go to the language that sorts first. Texts are read
whole; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import held_out, stash, tidy

UNKNOWN = "und"
FEW_LANGS = 10_000  # languages whose counts are broadcast


_LETTERS = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter at all."""
    found = _LETTERS.findall(text.lower())
    return found if any(w.isalpha() for w in found) else []


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class LangModel:
    """Log frequencies per language of words, and of n-grams of each order."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_logp: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_logp: np.ndarray | None = None
    max_n: int = 5


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 1500, max_n: int = 5, smoothing: float = 0.5) -> LangModel:
    """Learn from the whole texts of at most ``max_rows`` labelled rows of each
    language (spread by a hash of the id, then of the text)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # a hash of the id places every row between 0 and 1; only places low enough for some more than the sample are ranked
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    rows = rows.where("id is not null").withColumns({"mark": F.xxhash64("text"), "place": place})
    sizes = stash(rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("size")), "lang-sizes")
    if sizes.limit(FEW_LANGS + 1).count() <= FEW_LANGS:
        sizes = F.broadcast(sizes)
    low = rows.select("lang", "id", "mark", "place").join(sizes, "lang").where(F.col("place") * F.col("size") < 2 * max_rows + 1000)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "mark"))
    some = low.select("lang", "id", "mark", "place").distinct().withColumn("at", first).where(F.col("at") <= max_rows).select("lang", "id", "mark")
    rows = rows.join(F.broadcast(some), ["lang", "id", "mark"], "left_semi").dropDuplicates(["lang", "id", "mark"]).select("text", "lang")

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple[str, int, str], int] = defaultdict(int)
            for lang, part in pdf.groupby("lang"):
                words: Counter[str] = Counter()
                for text in part["text"]:
                    words.update(_words(text))
                for w, c in words.items():
                    seen[lang, 0, w] += c
                    for n in range(1, max_n + 1):
                        for g in _grams(w, n):
                            seen[lang, n, g] += c
            yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["lang", "n", "piece", "c"])

    counts = rows.mapInPandas(count, "lang string, n int, piece string, c long").groupBy("n", "piece", "lang").agg(F.sum("c").alias("c"))
    counts = stash(counts, "lang-counts")  # read twice below

    def gathered(which: DataFrame) -> pa.Table:
        """The counts of the sample as columns, in one order."""
        return which.select("piece", "n", "lang", "c").toArrow().sort_by([("n", "ascending"), ("piece", "ascending"), ("lang", "ascending")])

    known, pieces = gathered(counts.where("n = 0")), gathered(counts.where("n > 0"))
    langs = sorted(set(pc.unique(known.column("lang")).to_pylist()) | set(pc.unique(pieces.column("lang")).to_pylist()))
    model = LangModel(langs, max_n=max_n)
    if not langs:
        return model

    def table(found: pa.Table, orders: list[int]) -> tuple[dict[str, int], np.ndarray]:
        piece = found.column("piece").combine_chunks().dictionary_encode()
        names, row = piece.dictionary, piece.indices.to_numpy()
        col = pc.index_in(found.column("lang"), pa.array(langs)).to_numpy()
        c = np.zeros((len(names), len(langs)))
        c[row, col] = found.column("c").to_numpy()
        which = np.zeros(len(names), np.int64)
        which[row] = found.column("n").to_numpy()
        out = np.zeros_like(c)
        for n in orders:
            part = c[which == n]
            if len(part):
                out[which == n] = np.log((part + smoothing) / (part.sum(0) + smoothing * len(part)))
        return {p: i for i, p in enumerate(names.to_pylist())}, out

    model.words, model.word_logp = table(known, [0])
    model.grams, model.gram_logp = table(pieces, list(range(1, max_n + 1)))
    return model


def _unseen(model: LangModel, word: str) -> list[int]:
    """The known n-grams of the longest order that has any."""
    get, padded = model.grams.get, f"^{word}$"
    for n in range(min(model.max_n, len(padded)), 0, -1):
        known = [i for j in range(len(padded) - n + 1) if (i := get(padded[j : j + n])) is not None]
        if known:
            return known
    return []


def scorer(spark: SparkSession, model: LangModel):
    """A column function ``text -> struct<lang_pred, score>``. The score is the
    posterior of the chosen language under equal priors."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        seen = m.words.get if m.langs else None
        cache: dict[str, list[int]] = {}
        for texts in batches:
            langs, scores = [], []
            for text in texts:
                words = Counter(_words(text)) if text else None
                if not words or not m.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                rows, times, parts, shares = [], [], [], []
                for w, c in words.items():
                    i = seen(w)
                    if i is not None:
                        rows.append(i)
                        times.append(c)
                        continue
                    known = cache.get(w)
                    if known is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        known = cache[w] = _unseen(m, w)
                    parts += known
                    shares += [c / len(known)] * len(known) if known else []
                total = np.array(times, dtype=float) @ m.word_logp[rows] if rows else np.zeros(len(m.langs))
                if parts:
                    total += np.array(shares) @ m.gram_logp[parts]
                best = int(total.argmax())
                langs.append(m.langs[best])
                scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -745.0)).sum()))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return run


def predict(docs: DataFrame, model: LangModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row; only the text is looked at."""
    run = scorer(docs.sparkSession, model)
    return docs.select(id_col, run(text_col).alias("p")).select(id_col, "p.lang_pred", "p.score")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents whose crc32(doc_id) mod 4 is not 2, predict all."""
    test = held_out("doc_id", 4, 2)
    model = fit(docs.where(~test))
    return predict(docs, model).select("doc_id", test.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, least: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least``
    posterior; rows without a letter, or undecided ones, go. Columns stay."""
    run = scorer(docs.sparkSession, fit(docs.where(~held_out("doc_id", 4, 2))))
    told = run("text")
    return docs.where((told["lang_pred"] != UNKNOWN) & (told["score"] >= least))
