"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors become one class first. Unit vectors are quantised to int8 with
one scale each; the norms of a code and of its rounding error bound how far a
product of codes can be from the cosine. Classes are dealt to tiles of at most
about ``TILE`` rows around pivots; pairs of tiles too far apart, by the angles
to their pivots, are left out.

1. Pairs of tiles carry codes, scales and norms only. Of each all code products
   are made; rows with a product whose bound reaches the threshold are named.
2. Those rows' vectors come along, per pair of tiles, and the pairs that may
   reach the threshold are recomputed in double precision.

A task returns, per pair of tiles, the link counts of its rows and a spanning
forest of its links, never the links themselves.

A cosine is the sum of the products of components divided by the norms. Where
it is within ``_EDGE`` of the threshold, it is summed from left to right, so it
does not depend on how rows were tiled.

Pivots are fitted on a bounded sample; every row is dealt to a tile. What is
broadcast is bounded by the number of pivots.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing: they come out with 0 links, in a component of
their own. Vectors of different lengths do not link. Repeated rows link with
each other. A null id counts as larger than every id, and is not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import connected_components, grouped, stash, tidy
from daybook.llm.vectors import nearest, pivots, sample, usable

TILE = 16_384
STRIP = 512
_SLACK = 1e-9
_EDGE = 1e-11


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, their scales, the norms of scaled codes, and those of the rounding errors, of unit rows."""
    scale = np.maximum(np.abs(x).max(1, initial=0), 1e-300) / 127
    codes = np.rint(x / scale[:, None])
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
    return codes.astype(np.int8), scale, np.sqrt((codes**2).sum(1)) * scale, error * (1 + _SLACK) + 1e-12


class Codes:
    """Quantised rows of one side, with what their bounds need."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, size: np.ndarray, error: np.ndarray):
        self.scaled = codes.astype(np.float32) * scale[:, None].astype(np.float32)
        self.size, self.error = size, error

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        return cls(*quantise(unit))


def possible(a: Codes, b: Codes, threshold: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Strips of rows of ``a`` with, per row of ``b``, whether the cosine can reach the threshold."""
    dim = a.scaled.shape[1]
    rounding = (dim + 8) * 2.0**-23 * (a.size.max(initial=0) * b.size.max(initial=0) + 1e-3)  # of single-precision products
    most_size, most_error = b.size.max(initial=0), b.error.max(initial=0)
    for lo in range(0, len(a.scaled), STRIP):
        rows = slice(lo, min(lo + STRIP, len(a.scaled)))
        about = a.scaled[rows] @ b.scaled.T
        size, error = a.size[rows], a.error[rows]
        least = threshold - _SLACK - rounding - size * most_error - error * (most_size + most_error)
        maybe = about >= least.astype(np.float32)[:, None] - np.float32(1e-6)
        i, j = np.nonzero(maybe) if maybe.any() else ((), ())
        if len(i):  # each pair by its own bound
            bound = about[i, j].astype(np.float64) + rounding + size[i] * b.error[j] + error[i] * (b.size[j] + b.error[j])
            weak = bound < threshold - _SLACK
            maybe[i[weak], j[weak]] = False
        yield rows, maybe


class Vectors:
    """Whole rows of one side."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norm = np.sqrt((x**2).sum(1))
        self.codes = Codes.of(x / self.norm[:, None])


def _plain_cosines(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of row pairs, summed from left to right."""
    dot, na, nb = (np.zeros(len(i)) for _ in range(3))
    for d in range(a.x.shape[1]):
        p, q = a.x[i, d], b.x[j, d]
        dot += p * q
        na += p * p
        nb += q * q
    return dot / np.sqrt(na * nb)


def linked(a: Vectors, b: Vectors, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least the threshold."""
    out = np.zeros((len(a.x), len(b.x)), dtype=bool)
    for rows, maybe in possible(a.codes, b.codes, threshold):
        if not maybe.any():
            continue
        if maybe.mean() > 0.02:
            exact = (a.x[rows] @ b.x.T) / (a.norm[rows, None] * b.norm)
            out[rows] = maybe & (exact >= threshold)
            i, j = np.nonzero(maybe & (np.abs(exact - threshold) < _EDGE))
        else:
            i, j = np.nonzero(maybe)
            exact = np.einsum("ij,ij->i", a.x[i + rows.start], b.x[j]) / (a.norm[i + rows.start] * b.norm[j])
            ok = exact >= threshold
            out[i[ok] + rows.start, j[ok]] = True
            edge = np.abs(exact - threshold) < _EDGE
            i, j = i[edge], j[edge]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)] + rows.start, j[at : at + (1 << 16)]
            out[p, q] = _plain_cosines(a, b, p, q) >= threshold
    return out


def spanning_forest(links: np.ndarray) -> list[tuple[int, int]]:
    """``(row, column)`` links that join what all links of a two-sided graph join."""
    rows_left = links.any(1)
    cols_left = links.any(0)
    out: list[tuple[int, int]] = []
    while rows_left.any():
        start = int(rows_left.argmax())
        rows_left[start] = False
        queue = [(True, start)]
        while queue:
            is_row, at = queue.pop()
            if is_row:
                new = np.flatnonzero(links[at] & cols_left)
                cols_left[new] = False
                out += [(at, int(c)) for c in new]
                queue += [(False, int(c)) for c in new]
            else:
                new = np.flatnonzero(links[:, at] & rows_left)
                rows_left[new] = False
                out += [(int(r), at) for r in new]
                queue += [(True, int(r)) for r in new]
    return out


def _weighted(links: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row the sum of the counts of its links."""
    out = np.zeros(len(links), np.int64)
    for lo in range(0, len(links), STRIP):
        some = links[lo : lo + STRIP]
        if some.any():
            out[lo : lo + STRIP] = np.rint(some.astype(np.float64) @ counts).astype(np.int64)
    return out


def _floats(column: pa.Array, kind: type, dim: int) -> np.ndarray:
    """Rows of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


def similar_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, max_pivots: int = 128, sample_rows: int = 4096, tile_rows: int = TILE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    width = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    @tidy
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, cids, dims = [], [], []
            for v in batch.column(1):
                x = np.asarray(v.values, dtype=np.float64) if v.is_valid else np.zeros(0)
                with np.errstate(over="ignore", invalid="ignore"):
                    fine = len(x) > 0 and np.isfinite(x).all() and np.isfinite((x**2).sum()) and (x**2).sum() > 0
                raw.append(x.astype(width).tobytes() if fine else None)
                cids.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if fine else None)
                dims.append(len(x) if fine else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cids, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "cid", "dim", "raw"])

    fine = F.when(usable("v"), F.col("v"))
    each = stash(rows.select("id", fine.alias("v")).mapInArrow(name, f"id {kind}, cid binary, dim int, raw binary"), "embed-rows")
    classes = stash(each.where("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("dim").alias("dim"), F.first("raw").alias("raw")), "embed-classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    dim = max(dim or 1, 1)

    few = sample(rows.where(F.col("id").isNotNull() & usable("v")), "id", "v", dim, sample_rows)
    size = np.sqrt((few**2).sum(1))
    few = few[(size > 0) & np.isfinite(size)] / size[(size > 0) & np.isfinite(size)][:, None]
    centres = pivots(few, min(max_pivots, max(1, n // tile_rows)))
    centres = centres / np.maximum(np.sqrt((centres**2).sum(1)), 1e-12)[:, None]
    shared = spark.sparkContext.broadcast(centres)

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, dim))
            for i, raw in enumerate(batch.column(2).to_pylist()):
                v = np.frombuffer(raw, dtype=width).astype(np.float64)
                x[i, : len(v)] = v / np.sqrt((v**2).sum())
            near, _ = nearest(x, shared.value)
            angle = np.arccos(np.clip((x * shared.value[near]).sum(1), -1, 1))
            codes, *rest = quantise(x)
            dims = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c[:d].tobytes() for c, d in zip(codes, dims)], pa.binary()), *map(pa.array, rest), pa.array(near.astype(np.int32)), pa.array(angle)], ["cid", "dim", "code", "scale", "size", "error", "pivot", "angle"])

    placed = stash(classes.select("cid", "dim", "raw").mapInArrow(place, "cid binary, dim int, code binary, scale double, size double, error double, pivot int, angle double"), "embed-placed")
    # by angle from the pivot, so that a split pivot's tiles are rings: pivots x 64 rows at most
    rings = 64
    ring = F.least(F.floor(F.col("angle") / F.lit(np.pi / 2 / rings)), F.lit(2 * rings)).cast("int")
    placed = placed.withColumn("ring", ring)
    extent = placed.groupBy("dim", "pivot", "ring").agg(F.count(F.lit(1)).alias("c"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    # neighbouring rings share a tile until it is full
    upto = F.sum("c").over(Window.partitionBy("dim", "pivot").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1))
    extent = extent.withColumn("group", F.floor(F.coalesce(upto, F.lit(0)) / tile_rows)).withColumn("gc", F.sum("c").over(Window.partitionBy("dim", "pivot", "group")))
    extent = stash(extent.withColumn("parts", F.greatest(F.ceil(F.col("gc") / tile_rows), F.lit(1))), "embed-extent")
    spots = extent.select("dim", "pivot", "ring", "group", "parts")
    placed = placed.join(F.broadcast(spots) if _few(spots) else spots, ["dim", "pivot", "ring"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
    tile = F.concat_ws("/", "dim", "pivot", "group", "part")
    tiles = placed.groupBy(tile.alias("tile"), "dim", "pivot").agg(F.collect_list(F.struct("cid", "code", "scale", "size", "error")).alias("rows"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    tiles = stash(tiles.select("tile", "dim", "pivot", "lo", "hi", *(F.col(f"rows.{x}").alias(x) for x in ("cid", "code", "scale", "size", "error"))), "embed-tiles")

    # pairs of pivots, and of their tiles, that can hold a link: angles to either pivot differ by the threshold's angle at most
    limit = float(np.arccos(threshold)) + 1e-6
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    known = spark.createDataFrame([(p, q, float(between[p, q])) for p in range(len(centres)) for q in range(len(centres))], "pivot int, pivot2 int, d double")
    ends = lambda x, mark="": x.select(*(F.col(c).alias(f"{c}{mark}") for c in x.columns))
    # seen from the left pivot a right row lies at d - hi2 .. d + hi2, and at least lo2 - d; and the other way round
    near = (F.col("hi") + limit >= F.greatest(F.col("d") - F.col("hi2"), F.col("lo2") - F.col("d"))) & (F.col("lo") - limit <= F.col("d") + F.col("hi2"))
    near = near & (F.col("hi2") + limit >= F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"))) & (F.col("lo2") - limit <= F.col("d") + F.col("hi"))
    whole = extent.groupBy("dim", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    reach = known.join(whole, "pivot").join(ends(whole, "2"), "pivot2").where((F.col("dim") == F.col("dim2")) & near).select("dim", "pivot", "pivot2", "d")
    meta = tiles.select("tile", "dim", "pivot", "lo", "hi")
    pairs = meta.join(F.broadcast(reach), ["dim", "pivot"]).join(ends(meta, "2"), "pivot2")
    pairs = pairs.where((F.col("dim") == F.col("dim2")) & (F.col("tile") <= F.col("tile2")) & near).select("tile", "tile2").distinct()
    body = tiles.select("tile", "dim", "cid", "code", "scale", "size", "error")
    both = pairs.join(body, "tile").join(ends(body.drop("dim"), "2"), "tile2")
    both = both.select("tile", "tile2", "dim", "cid", "code", "scale", "size", "error", "cid2", "code2", "scale2", "size2", "error2")

    @tidy
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a pair of tiles that may have a link in it."""
        for batch in batches:
            for row in range(batch.num_rows):
                tile, tile2, size = (batch.column(x)[row].as_py() for x in range(3))
                sides = [[batch.column(x)[row].values for x in range(first, first + 5)] for first in (3, 8)]
                a, b = (Codes(_floats(code, np.int8, size), *(np.asarray(x) for x in rest)) for _, code, *rest in (sides if tile != tile2 else sides[:1] * 2))
                left, right = np.zeros(len(a.size), bool), np.zeros(len(b.size), bool)
                for strip, maybe in possible(a, b, threshold):
                    if tile == tile2:
                        at = np.arange(strip.start, strip.stop)
                        maybe[at - strip.start, at] = False
                    left[strip] |= maybe.any(1)
                    right |= maybe.any(0)
                for side, some in enumerate((left, right)[: 1 + (tile != tile2)]):
                    found = sides[side][0].take(pa.array(np.flatnonzero(some | right if tile == tile2 else some)))
                    c = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([tile] * c, pa.string()), pa.array([tile2] * c, pa.string()), pa.array(np.full(c, side, np.int32)), found], ["tile", "tile2", "side", "cid"])

    asked = stash(both.mapInArrow(screen, "tile string, tile2 string, side int, cid binary"), "embed-asked")
    bodies = classes.select("cid", F.struct(F.col("rep").isNull().alias("none"), "rep", "cid").alias("at"), "m", "dim", "raw")
    work = asked.join(bodies, "cid").select("tile", "tile2", "side", "dim", "m", "raw", "at").repartition("tile", "tile2").sortWithinPartitions("tile", "tile2", "side")
    named = f"struct<none:boolean,rep:{kind},cid:binary>"

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            own = table.column(0)[0] == table.column(1)[0]
            cut = int((np.asarray(table.column(2)) == 0).sum())
            size = table.column(3)[0].as_py()
            sides = [table] if own else [table.slice(0, cut), table.slice(cut)]
            vectors_ = [Vectors(_floats(t.column(5), width, size).astype(np.float64)) for t in sides]
            counts = [np.asarray(t.column(4)).astype(np.float64) for t in sides]
            links = linked(vectors_[0], vectors_[-1], threshold)
            if own:
                np.fill_diagonal(links, False)
            names = [t.column(6).combine_chunks() for t in sides]
            for k in range(len(sides)):
                c = _weighted(links if k == 0 else links.T, counts[-1 - k])
                some = pa.array(np.flatnonzero(c))
                yield pa.RecordBatch.from_arrays([names[k].take(some), pa.array(c[c > 0]), pa.nulls(len(some), names[k].type)], ["a", "c", "b"])
            forest = np.array(spanning_forest(links), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([names[0].take(pa.array(forest[:, 0])), pa.array(np.zeros(len(forest), np.int64)), names[-1].take(pa.array(forest[:, 1]))], ["a", "c", "b"])

    found = stash(work.mapInArrow(compare, f"a {named}, c long, b {named}"), "embed-found")
    counts = found.where("b is null").groupBy(F.col("a.cid").alias("cid")).agg(F.sum("c").alias("c"))
    # a component is named by its smallest label, so by its smallest id: no join on components
    roots = connected_components(found.where("b is not null").select("a", "b"), "embed")
    result = classes.select("cid", "rep", "m").join(roots.select(F.col("node.cid").alias("cid"), F.col("root.rep").alias("root"), F.lit(True).alias("joined")), "cid", "left").join(counts, "cid", "left")
    result = result.select("cid", F.when(F.col("joined"), F.col("root")).otherwise(F.col("rep")).alias("component_id"), (F.col("m") - 1 + F.coalesce("c", F.lit(0))).alias("n_links"))
    result = stash(result, "embed-result")  # written, so that adaptive execution can split the rows of a class of many copies
    out = each.select("id", "cid").join(result, "cid", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _few(extent: DataFrame, most: int = 20_000) -> bool:
    return extent.limit(most + 1).count() <= most
