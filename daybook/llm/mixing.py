"""Mixing sources to target weights by temperature.

The token shares p of the sources are raised to an exponent in [0, 1] and
normalised: 1 keeps the shares, 0 makes sources equal. The exponent is the
largest whose weights reach the target entropy, raised as far as needed to
keep every source within the repetition limit. It is found by bisection (each
round halves the interval six times over, in one aggregation over the sources).

Weights times the budget are realised per source as block permutations: whole
passes over a permutation of the source's rows, then the longest prefix of the
permutation that the rest of the budget pays for. The permutation orders rows
by a seeded hash. The prefix is cut by bucket sums first and inside one bucket
after that, so no task holds a whole source.

Defined results: a null source is a source of its own; a null or blank text
has no tokens and costs nothing; a source without tokens gets weight 0, one
copy of each row and no part of the budget. Rows of one id rank equally and
are taken or left together. Without any tokens each row gets one copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import stash

BUCKETS = 4096
BROADCAST_SOURCES = 10_000
_FAN = 64


def word_count(text: Column | str) -> Column:
    """Runs of signs other than U+0009-U+000D and U+0020; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_hash(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col))


def solve_exponent(totals: DataFrame, budget: int, *, entropy_share: float | None, max_repeats: float | None) -> float:
    """The exponent for ``totals`` (one row per source, column ``tokens`` > 0).

    ``entropy_share``: target entropy as a share of that of equal weights.
    ``max_repeats``: the most passes over any source."""
    n, tokens, logs = totals.agg(F.count(F.lit(1)), F.sum("tokens"), F.sum(F.log("tokens"))).first()
    if not n:
        return 1.0

    def told(exponents: list[float]) -> list[tuple[float, float]]:
        """Of each exponent the entropy and the most passes."""
        ps = [F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(tokens)))) for a in exponents]
        aggs = []
        for a, p in zip(exponents, ps, strict=True):
            lg = F.lit(a) * F.log(F.col("tokens") / F.lit(float(tokens)))
            aggs += [F.sum(p), F.sum(p * lg), F.max(p / F.col("tokens"))]
        row = totals.agg(*aggs).first()
        return [(math.log(row[3 * i]) - row[3 * i + 1] / row[3 * i], budget * row[3 * i + 2] / row[3 * i]) for i in range(len(exponents))]

    def edge(good) -> float:
        """The least exponent that is good, where all above it are; 1 if none is."""
        lo, hi = 0.0, 1.0
        if good(*told([0.0])[0]):
            return 0.0
        for _ in range(4):
            grid = [lo + (hi - lo) * i / _FAN for i in range(1, _FAN)]
            ok = [good(*x) for x in told(grid)]
            at = ok.index(True) if True in ok else _FAN - 1
            lo, hi = (grid[at - 1] if at else lo), (grid[at] if at < len(grid) else hi)
        return hi

    exponent = 1.0
    if entropy_share is not None:
        target = entropy_share * math.log(n)
        exponent = edge(lambda h, _: h < target)  # entropy falls as the exponent grows
    if max_repeats is not None:
        least = edge(lambda _, most: most <= max_repeats)
        exponent = max(exponent, least) if entropy_share is not None else least
    return round(exponent, 6)


def mixing_plan(rows: DataFrame, *, budget: int | None = None, entropy_share: float | None = 0.98, max_repeats: float | None = 4.0) -> DataFrame:
    """One row per source of ``rows`` (id, source, tokens, h): ``source,
    tokens, weight, budget, passes, cut_h, cut_id``. Rows at or before the cut
    get one copy more than ``passes``."""
    totals = stash(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = whole if budget is None else budget
    some = totals.where("tokens > 0")
    exponent = solve_exponent(some, budget, entropy_share=entropy_share, max_repeats=max_repeats)
    raised = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(max(whole, 1)))))).otherwise(0.0)
    norm = totals.agg(F.sum(raised)).first()[0] or 1.0
    plan = totals.withColumn("weight", raised / F.lit(norm)).withColumn("budget", F.floor(F.col("weight") * budget).cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(-1))
    plan = stash(plan, "mix-plan")

    bits = BUCKETS.bit_length() - 1
    at = F.shiftrightunsigned("h", 64 - bits)
    sums = rows.groupBy("source", at.alias("bucket")).agg(F.sum("tokens").alias("t"))
    running = F.sum("t").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("upto", running).withColumnRenamed("source", "s")
    over = sums.join(_small(plan.select("source", "rest")), F.col("s").eqNullSafe(F.col("source"))).where("rest >= 0 and upto > rest")
    cut = over.groupBy("s").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("base"), "rest")).alias("c")).select("s", "c.*")
    cut = stash(cut, "mix-cut")

    # inside the bucket where the budget ends
    inside = rows.withColumn("b", at).join(_small(cut), F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("bucket")))
    inside = inside.groupBy("source", "h", "id", "base", "rest").agg(F.sum("tokens").alias("tokens"))  # rows of one id are one, however many
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", F.col("base") + upto).where("upto <= rest").groupBy("source").agg(F.max(F.struct("h", "id")).alias("last")).withColumnRenamed("source", "s2")
    # a bucket holds hashes of one leading bit pattern, so the order of signed hashes inside it is that of unsigned ones
    plan = plan.join(cut.select("s", "bucket"), F.col("source").eqNullSafe(F.col("s")), "left").join(last, F.col("source").eqNullSafe(F.col("s2")), "left")
    return stash(plan.select("source", "tokens", "weight", "budget", "passes", (F.col("rest") >= 0).alias("partial"), "bucket", F.col("last.h").alias("cut_h"), F.col("last.id").alias("cut_id")), "mix-result")


def _small(side: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source if they are few; else let it shuffle."""
    return F.broadcast(side) if side.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else side


def copies(plan_source: str = "") -> Column:
    """Copies of a row (columns h, id) by the plan's row joined to it."""
    bits = BUCKETS.bit_length() - 1
    b = F.shiftrightunsigned("h", 64 - bits)
    before = F.col("bucket").isNull() | (b < F.col("bucket"))
    inside = (b == F.col("bucket")) & F.coalesce((F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("id").isNull() | (F.col("id") <= F.col("cut_id")))), F.lit(False))
    return (F.col("passes") + F.when(F.col("partial") & (before | inside), 1).otherwise(0)).cast("int")


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **target) -> DataFrame:
    """``(id, source, n_tokens, weight, copies, order_key)`` per row."""
    rows = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("tokens"), order_hash(id_col, seed).alias("h")), "mix-rows")
    plan = mixing_plan(rows, **target)
    p = _small(plan.withColumnRenamed("source", "ps").withColumnRenamed("tokens", "pt"))
    out = rows.join(p, F.col("source").eqNullSafe(F.col("ps")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("tokens").alias("n_tokens"), "weight", copies().alias("copies"), F.col("h").alias("order_key"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **target) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it. Columns stay."""
    rows = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("tokens"), order_hash(id_col, seed).alias("h")), "mix-rows")
    plan = mixing_plan(rows, **target).select(F.col("source").alias("_mix_source"), "passes", "partial", "bucket", "cut_h", "cut_id")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("id"), F.col(source_col).alias("_source"), order_hash(id_col, seed).alias("h"))
    out = whole.join(_small(plan), F.col("_source").eqNullSafe(F.col("_mix_source")))
    out = out.select("_row", F.explode(F.sequence(F.lit(0), copies())).alias("_n")).where("_n > 0")
    return out.select("_row.*")
