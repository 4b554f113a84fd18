"""Exact top-k inner products with a pivot-distance index.

Codes are ``floor(256 * x)`` per component. One more coordinate,
``sqrt(M**2 - |z|**2)`` with M the largest norm, makes all codes equally long,
so the largest inner products are the nearest points and the triangle
inequality holds. Every code is keyed by its nearest pivot and its distance
from it; per pivot the distances are cut into annuli, and annuli into tiles of
about ``TILE`` rows. A block of queries first looks into the annuli around its
own key; the k-th score found bounds how far from a pivot a better code can
lie, and a block of queries of one pivot then meets the tiles of the annuli
within that bound, each query stopping at its own. A block goes once to each
of a bounded number of shards of annuli, not to each annulus for each query.

Pivots are fitted on a bounded sample (``sample_rows``); every row is indexed.
What is broadcast is bounded by the numbers of pivots and annuli.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, and neither do rows without an id. Shorter vectors count as
filled up with zeros. Ties go to the smaller id; a row never is its own
candidate. Rows that repeat an id are candidates of other ids each; as queries
equal ones are one, and different vectors of one id compete for its k places.
Scores are exact while sums of products stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import stash, tidy
from daybook.llm.vectors import distances, matrix, nearest, pivots, sample, usable

TILE = 1024
QUERY_BLOCK = 256
SHARD_ROWS, MIN_SHARDS, MAX_SHARDS = 16_384, 8, 128  # rows for one task of the second look, and bounds of their number
_SLACK = 1e-6


def _codes(column: pa.Array, dim: int) -> np.ndarray:
    return np.floor(256.0 * matrix(column, dim))


def _lifted(z: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([z, np.sqrt(np.maximum(top - (z**2).sum(1), 0))[:, None]], 1)


def _packed(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of one row, ties to the smaller id."""
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_modulus: int = 50, k: int = 5, max_pivots: int = 64, max_annuli: int = 16, sample_rows: int = 4096) -> DataFrame:
    """``(query_id, rank, id, score)``: of each row whose id is divisible by
    ``query_modulus`` the k rows of largest inner product."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    code = F.transform("v", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    n, dim, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate(code, F.lit(0.0), lambda s, x: s + x * x))).first()
    dim, top = max(dim or 1, 1), float(top or 0.0)
    kind = "<i2" if top < 2.0**30 else "<f8"  # no component is longer than its vector
    exact = np.float32 if top < 2.0**24 else np.float64  # nor is a sum of products larger than the longest square
    chosen = np.floor(256.0 * sample(rows, "id", "v", dim, sample_rows))
    centres = pivots(_lifted(chosen, top), min(max_pivots, max(1, n // 256)))
    shared = spark.sparkContext.broadcast(centres)
    n_annuli = int(min(max_annuli, max(1, n // (len(centres) * TILE))))

    @tidy
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _codes(batch.column(1), dim)
            near, r = nearest(_lifted(z, top), shared.value) if len(z) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in z.astype(kind)], pa.binary()), pa.array(near.astype(np.int32)), pa.array(r)], ["id", "code", "pivot", "r"])

    keyed = stash(rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(key, "id long, code binary, pivot int, r double").withColumn("row", F.monotonically_increasing_id()), "topk-keyed")

    # annuli: bounds and sizes, pivots x annuli rows at most
    shares = [i / n_annuli for i in range(1, n_annuli)]
    cuts = keyed.groupBy("pivot").agg((F.percentile_approx("r", shares) if shares else F.array().cast("array<double>")).alias("cuts"))
    placed = keyed.join(F.broadcast(cuts), "pivot").withColumn("annulus", F.size(F.filter("cuts", lambda c: c < F.col("r")))).drop("cuts")
    extent = placed.groupBy("pivot", "annulus").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    extent = stash(extent, "topk-extent")
    tiled = placed.join(F.broadcast(extent.select("pivot", "annulus", "parts")), ["pivot", "annulus"])
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("row"), F.col("parts")))
    tiles = tiled.groupBy("pivot", "annulus", "tile").agg(F.collect_list(F.struct("id", "code")).alias("rows"))
    ring = F.col("pivot") * n_annuli + F.col("annulus")
    tiles = stash(tiles.select("pivot", "annulus", ring.alias("ring"), F.col("rows.id").alias("ids"), F.col("rows.code").alias("codes")), "topk-tiles")

    # queries in blocks of one annulus
    asked = tiled.where(F.pmod("id", F.lit(query_modulus)) == 0).dropDuplicates(["id", "code"])
    sizes = asked.groupBy("pivot", "annulus").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    asked = asked.join(F.broadcast(sizes), ["pivot", "annulus"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")))

    def packed(frame: DataFrame, *keys: str) -> DataFrame:
        q = F.struct("id", "code", "least")
        return frame.groupBy(*keys).agg(F.collect_list(q).alias("q")).select(*keys, F.col("q.id").alias("qids"), F.col("q.code").alias("qcodes"), F.col("q.least").alias("least"))

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for row in range(batch.num_rows):
                qids, qcodes, least, ids, codes = (batch.column(i)[row].values for i in range(5))
                qids, ids, least = qids.to_numpy(), ids.to_numpy(), least.to_numpy(zero_copy_only=False)
                scores = _packed(qcodes, dim, kind).astype(exact) @ _packed(codes, dim, kind).astype(exact).T
                good = scores >= least[:, None]
                for i in np.flatnonzero(good.any(1)):
                    use = np.flatnonzero(good[i] & (ids != qids[i]))
                    at = use[_best(scores[i][use], ids[use], k)]
                    if len(at):
                        out.append((np.full(len(at), qids[i]), ids[at], scores[i][at].astype(np.int64)))
            q, v, s = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec", "score"])

    def found(joined: DataFrame) -> DataFrame:
        hits = joined.select("qids", "qcodes", "least", "ids", "codes").mapInArrow(search, "query_id long, vec long, score long")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec"))
        return hits.withColumn("rank", best).where(F.col("rank") <= k)

    # first look: the annulus a query lies in and those next to it
    near = asked.withColumn("least", F.lit(float("-inf"))).withColumn("annulus", F.explode(F.array(F.col("annulus") - 1, "annulus", F.col("annulus") + 1)))
    first = stash(found(packed(near, "pivot", "annulus", "block").join(tiles, ["pivot", "annulus"])), "topk-first")
    bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))

    # second look: blocks of queries of one pivot meet the tiles of all annuli a code at least as good can lie in
    rings = spark.sparkContext.broadcast([tuple(x) for x in extent.select("pivot", "annulus", "lo", "hi").orderBy("pivot", "annulus").collect()])
    shards = max(1, min(len(rings.value), MAX_SHARDS, max(MIN_SHARDS, n // SHARD_ROWS)))

    @tidy
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, annulus, lo, hi = np.array(rings.value).reshape(-1, 4).T
        pivot, number = pivot.astype(np.int64), (pivot * n_annuli + annulus).astype(np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                z = _packed(batch.column(1)[row].values, dim, kind).astype(np.float64)
                least = batch.column(2)[row].values.to_numpy(zero_copy_only=False)
                q = np.concatenate([z, np.zeros((len(z), 1))], 1)
                d = distances(q, shared.value)[:, pivot]
                reach = np.sqrt(np.maximum((z**2).sum(1) + top - 2 * least, 0))[:, None] * (1 + _SLACK) + _SLACK * (1 + top**0.5)
                open_ = number[((d >= lo - reach) & (d <= hi + reach)).any(0)]
                to = [open_[open_ % shards == shard] for shard in range(shards)]
                for shard in (i for i in range(shards) if len(to[i])):  # a block's copy at a time
                    one = batch.slice(row, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([to[shard].tolist()], pa.list_(pa.int32())), *one.columns], ["shard", "open", "qids", "qcodes", "least"])

    asked = asked.select("id", "code", "pivot").join(bound.withColumnRenamed("query_id", "id"), "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    sizes = asked.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    blocks = asked.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")))
    wide = packed(blocks, "pivot", "block").select("qids", "qcodes", "least").mapInArrow(expand, "shard int, open array<int>, qids array<long>, qcodes array<binary>, least array<double>")
    dealt = tiles.withColumn("shard", F.pmod("ring", F.lit(shards))).repartition(shards, "shard")  # by number: tasks of bytes' size would be few and long
    met = dealt.join(wide.repartition(shards, "shard"), "shard").where(F.array_contains("open", F.col("ring")))
    return found(met).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")
