"""Audit of text filters: what each removes, alone and after the others.

Texts are scanned in Arrow buffers. NumPy byte classes find blanks, capitals
and symbols; prefix sums over word starts, word ends and class members give
each document's counts as differences. Distinct words come from 64-bit word
hashes sorted within each document, and neighbours of equal hash are compared
byte by byte, so a collision is seen and that document counted by its words
themselves. A document leaves the scan as one small row: its id, part, the
digest of its text, and the failed filters as bits of a mask.

Documents with the same text are told by that digest (SHA-256). A digest's
least id is a partial aggregate, and the documents that hold it are found by a
join on (digest, id), whose keys are spread however often a text repeats.
Everything after that works on counts by (part, mask, labels), at most 128
rows a part, from which every order and step of the filters follows by masks.

Defined results: a null text is the empty text. A null source is the empty
part, like an empty one. A document of null id repeats no other (no id is
smaller than it) and has no labels; of rows that repeat an id none has a
smaller id than another. A document's labels are the largest of its label
rows, null labels count as 0. Texts are read whole; a very long one is scanned
in pieces. Other columns are ignored. An empty table has no part and gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.common import CHUNK, WordHasher, chunks, sliced, stash, text_bytes, tidy

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: The filters' limits and symbols.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = "#$%&*|"


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set within each range of ``bounds``."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _classes() -> dict[str, np.ndarray]:
    table = {name: np.zeros(256, bool) for name in ("blank", "capital", "symbol", "first")}
    table["blank"][[32, *range(9, 14)]] = True
    table["capital"][ord("A") : ord("Z") + 1] = True
    table["symbol"][[ord(c) for c in SYMBOLS]] = True
    table["first"][:] = True  # bytes that begin a character
    table["first"][0x80:0xC0] = False
    return table


class Scanner:
    """Counts of whole texts."""

    def __init__(self) -> None:
        self.table = _classes()
        self.hasher = WordHasher(fold_case=False)

    def distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """Distinct words of each of ``n`` texts; ``text`` names the text of each word."""
        order = np.lexsort((hashes, text))
        text, hashes, starts, ends = text[order], hashes[order], starts[order], ends[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        out = np.bincount(text[new], minlength=n)
        again = np.flatnonzero(~new)  # each must be the word before it in this order
        sizes = ends[again] - starts[again]
        unequal = sizes != ends[again - 1] - starts[again - 1]
        wrong = set(text[again[unequal]].tolist())
        again, sizes = again[~unequal], sizes[~unequal]
        step = 0
        while len(again):  # the byte at ``step`` of all words that have one
            alive = sizes > step
            again, sizes = again[alive], sizes[alive]
            differs = data[starts[again] + step] != data[starts[again - 1] + step]
            wrong.update(text[again[differs]].tolist())
            step += 1
            if step == 64 and len(again):  # long words are compared whole
                for i in again.tolist():
                    if data[starts[i] : ends[i]].tobytes() != data[starts[i - 1] : ends[i - 1]].tobytes():
                        wrong.add(int(text[i]))
                break
        for d in wrong:
            own = np.flatnonzero(text == d).tolist()
            out[d] = len({data[starts[i] : ends[i]].tobytes() for i in own})
        return out

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """words, distinct, capitals, symbols and characters of each text of concatenated bytes."""
        n = len(bounds) - 1
        table = self.table
        word = ~table["blank"][data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        starts, ends = word.copy(), word.copy()
        starts[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        out = {"words": _sums(starts, bounds), "capitals": _sums(table["capital"][data], bounds), "symbols": _sums(table["symbol"][data], bounds), "characters": _sums(table["first"][data], bounds)}
        text = np.repeat(np.arange(n), out["words"])
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        out["distinct"] = self.distinct(data, starts, ends, text, self._hashes(data, bounds), n)
        return out

    def _hashes(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Hashes of all words, by pieces that end at blanks or between texts."""
        out, at = [], 0
        while at < len(data):
            stop = min(at + CHUNK, len(data))
            if stop < len(data):
                blanks = np.flatnonzero(self.table["blank"][data[at:stop]])
                inside = bounds[(bounds > at) & (bounds <= stop)]
                last = max(int(blanks[-1]) + at + 1 if len(blanks) else at, int(inside[-1]) if len(inside) else at)
                while last == at:  # one word reaches beyond the piece
                    stop = min(stop + CHUNK, len(data))
                    blanks = np.flatnonzero(self.table["blank"][data[at:stop]])
                    inside = bounds[(bounds > at) & (bounds <= stop)]
                    last = int(blanks[0]) + at + 1 if len(blanks) else int(inside[0]) if len(inside) else stop if stop == len(data) else at
                stop = last
            own = bounds[(bounds >= at) & (bounds <= stop)] - at
            own = np.unique(np.concatenate([[0], own, [stop - at]]))
            out.append(self.hasher.words(data[at:stop], own)[0])
            at = stop
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def masks(self, column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Bits of the filters A to D that each text fails, and the texts' digests."""
        data, offsets = text_bytes(column)
        masks, digests = [], []
        for i, j in chunks(offsets):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            c = self.counts(part, bounds)
            failed = {
                "A": c["words"] < MIN_WORDS,
                "B": 100 * c["distinct"] < DISTINCT_PERCENT * c["words"],
                "C": 100 * c["capitals"] > CAPITAL_PERCENT * c["characters"],
                "D": c["symbols"] > 0,
            }
            masks.append(sum(flags.astype(np.int32) * BIT[f] for f, flags in failed.items()))
            digests += [hashlib.sha256(part[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return np.concatenate(masks) if masks else np.zeros(0, np.int32), digests


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, digest, mask)`` of every document; repeats are not told yet."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in sliced(batches, "text", CHUNK):
            masks, digests = scanner.masks(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "digest", "mask"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("part", T.StringType(), False), T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())])
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, schema)


def profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: how many documents of a part fail just
    the filters of ``mask``, by their labels."""
    rows = scan(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    rows = stash(rows, "audit-rows")
    known = rows.where("doc_id is not null")
    least = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    known = known.join(least, ["digest", "doc_id"], "left").join(own, "doc_id", "left")
    repeats = F.when(F.col("first").isNull(), BIT["E"]).otherwise(0)
    known = known.select("part", (F.col("mask") + repeats).alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), "n")
    unnamed = rows.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return known.unionByName(unnamed).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Of a profile, for each part, order of the filters and step: kept,
    removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    orders = ["".join(p) for p in permutations(filters)]
    cases = [(o, k + 1, BIT[o[k]], sum(BIT[f] for f in o[:k])) for o in orders for k in range(len(o))]
    case = F.explode(F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for o, k, bit, before in cases)))
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("found"))
    rows = parts.select("part", "found", case.alias("case")).select("part", "found", "case.*")

    def counted(hit, n=lambda x: x["n"]) -> Column:
        return F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + F.when(hit(x), n(x)).otherwise(F.lit(0).cast("long")))

    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    here = lambda x: fails(x) & ~gone(x)
    # a document goes by each of the filters it fails in an equal share of the orders
    share = lambda x: (x["n"] * len(orders) / F.bit_count(x["mask"])).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        counted(lambda x: ~fails(x) & ~gone(x)).alias("kept"),
        counted(here).alias("removed"),
        counted(lambda x: fails(x) & gone(x)).alias("redundant"),
        counted(lambda x: x["mask"] == F.col("bit")).alias("unique_fails"),
        counted(lambda x: here(x) & x["good"]).alias("good_lost"),
        counted(lambda x: here(x) & x["toxic"]).alias("toxic_lost"),
        counted(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the whole table's ``profile``."""
    return interactions(profile(docs, labels))
