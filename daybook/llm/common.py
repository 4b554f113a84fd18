"""What the training-data operators share: shared-folder tables, bounded
samples, batch functions that give their memory back, vectorised word hashing
over Arrow buffers, and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary
    folder is used only where that setting is absent (single-machine tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="daybook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if by:
        out = out.partitionBy(by)
    out.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


def batch_rows(spark: SparkSession, rows: int) -> None:
    """How many rows pass to Python at a time from here on. A batch of whole texts
    is held by the JVM outside its heap, with room to grow, and by the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back(spark: SparkSession, rounds: int = 4) -> None:
    """Let the executors return memory that earlier stages have left unused: a
    collection makes a JVM's heap shrink to what it holds. A few tiny tasks per
    core reach every executor; one that they miss only keeps its memory."""
    n = max(1, rounds * spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') as done").where("done is not null").count()


def held_out(column: str, modulus: int, remainder: int):
    """True where crc32(decimal text of the id) mod ``modulus`` is ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_rows(df: DataFrame, key: str, limit: int, *, per_key: int = 4) -> DataFrame:
    """Rows of at most ``limit`` keys of ``df``, spread by a hash of ``key``, and
    of a key that repeats at most ``per_key`` rows; the same rows at every run.
    Only keys reach the driver-side limit, the broadcast side has at most
    ``limit`` rows, and of each key no task passes on more than ``per_key`` rows."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(limit)
    chosen = df.join(F.broadcast(ids), key, "left_semi")
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))))
    return chosen.withColumn("_at", at).where(F.col("_at") <= per_key).drop("_at")


# ------------------------------------------------------------ batch functions


def tidy(run: Callable) -> Callable:
    """Of a batch function for Spark: when a task ends, its memory goes back to
    the system. Spark reuses Python workers, so a stage would otherwise start
    beside all that earlier stages held."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes of one column, or of one longer row."""
    for batch in batches:
        if batch.num_rows:
            for i, j in chunks(text_bytes(batch.column(column))[1], size):
                yield batch.slice(i, j - i)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Of rows sorted by the first ``keys`` columns, the rows of each key. One group is held at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first = rest.num_rows if rest is not None else 1  # before it, the rest has one key
        table = pa.concat_tables([rest, table]) if rest is not None else table
        changes = np.zeros(table.num_rows - first, bool)
        for k in range(keys):
            column = table.column(k)
            changes |= pc.fill_null(pc.not_equal(column.slice(first), column.slice(first - 1, table.num_rows - first)), True).to_numpy()
        lo = 0
        for hi in (np.flatnonzero(changes) + first).tolist():
            yield table.slice(lo, hi - lo)
            lo = hi
        rest = table.slice(lo)
    if rest is not None:
        yield rest


# --------------------------------------------------------- vectorised hashing

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
CHUNK = 1 << 20  # bytes hashed at once


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _byte_values(fold_case: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if fold_case:
        values[65:91] = values[97:123]
    return values


class WordHasher:
    """64-bit hashes of the words (runs without U+0009-U+000D and U+0020) of
    concatenated UTF-8 texts. Position-weighted sums of random byte values
    modulo 2**64 make every word's hash a difference of two prefix sums."""

    def __init__(self, fold_case: bool = True):
        self.values = _byte_values(fold_case)
        self.size = 0
        self._grow(CHUNK + 1)

    def _grow(self, n: int) -> None:
        if n <= self.size:
            return
        power = np.empty(n, dtype=_U)
        inverse = np.empty(n, dtype=_U)
        for out, base in ((power, _P), (inverse, _PINV)):
            out[0] = 1
            done = 1
            while done < n:  # doubling
                step = min(done, n - done)
                np.multiply(out[:step], _U(pow(base, done, 1 << 64)), out=out[done : done + step])
                done += step
        self.power, self.inverse, self.size = power, inverse, n

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of ``data`` and, for each text given by ``bounds``
        (offsets, one more than texts), the range of its words."""
        n = len(data)
        if n == 0:
            return np.empty(0, _U), np.zeros(len(bounds), np.int64)
        self._grow(n + 1)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        edge[0] = edge[n] = True
        before = np.empty(n, dtype=bool)
        before[0] = True
        before[1:] = space[:-1]
        starts = np.flatnonzero(~space & (before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1] = True
        after[:-1] = space[1:]
        ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        sums = np.empty(n + 1, dtype=_U)
        sums[0] = 0
        np.cumsum(self.values[data] * self.power[:n], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(_U))
        return hashes, np.searchsorted(starts, bounds)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return data[lo:hi], offsets - lo


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ------------------------------------------------------- connected components


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a, b of one
    orderable type, structs included; loops allowed): root is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set is a forest
    of stars. Per node only a minimum is aggregated (partial on the map side).
    Minima and edges are written before they are joined, so both sides of a
    join come straight from a shuffle (or the minima are small enough to be
    broadcast), and adaptive execution splits the edges of a hub."""
    cur = stash(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-cc")
    seen = None
    while True:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        large = stash(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-large")
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        cur = stash(small, f"{name}-cc")
        state = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
