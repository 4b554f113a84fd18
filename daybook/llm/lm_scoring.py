"""Cross-entropy difference of documents between two matched n-gram models.

Both models are interpolated bigram models of the same order, smoothing and
vocabulary; they differ in the text they count only: the target model counts
documents labelled good and not toxic, the background model all others. The
background's counts are scaled to the target's size, so smoothing acts alike
on both. Per token the losses are subtracted, and their mean is the document's
score: the lower, the nearer to the target.

The vocabulary is every word, and bigrams are counted one by one; both are known
by exact 64-bit hashes and grow with the corpus. No model is gathered or
broadcast:

1. Documents are taken in chunks of about ``CHUNK_BYTES``. Each chunk sends its
   distinct words and bigrams with their counts, packed by range of hash.
2. A range of hashes adds up its counts and answers every chunk in the order of
   the chunk's own hashes. Ranges get more as the corpus grows.
3. A chunk meets its answers and scores its documents.

Defined results: a null, empty or blank text has no tokens and scores 0 under
both models. Without any target document (or background document) that model
is uniform over the vocabulary. A label row that repeats counts once; of
contradicting labels the good one wins. Repeated rows score alike. Texts are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import WordHasher, chunks, mix64, stash, text_bytes, tidy

_U = np.uint64
CHUNK_BYTES = 16 << 20
RANGE_BYTES = 16 << 20  # of text for each range of hashes


def _pack(values: np.ndarray) -> bytes:
    """64-bit values as compressed planes of bytes."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(packed, 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64).reshape(n)


def _hashed(column: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows, how many each row has, and where a row's first word is."""
    data, offsets = text_bytes(column)
    words, counts = [np.empty(0, _U)], [np.empty(0, np.int64)]
    for i, j in chunks(offsets):
        found, spans = hasher.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        words.append(found)
        counts.append(np.diff(spans))
    w, n = np.concatenate(words), np.concatenate(counts)
    first = np.zeros(len(w), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    return w, n, first


def _bigrams(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of each word with the one before it, but for first words."""
    return mix64(words[:-1] * _U(0x9E3779B97F4A7C15) ^ mix64(words[1:] + _U(1)))[~first[1:]]


def _digest(texts: DataFrame, *, id_col: str, kind: str, bits: int) -> DataFrame:
    """Two kinds of rows. 'd', one per document: chunk, id, text. 'q': chunk,
    whether of words, range of hashes, how many, hashes, and counts per model."""
    schema = f"kind string, chunk long, id {kind}, text string, word boolean, part int, n int, keys binary, background binary, target binary"
    names = "kind chunk id text word part n keys background target".split()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        chunk = TaskContext.get().partitionId() << 32

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            none = lambda kind_: pa.nulls(table.num_rows, kind_)
            where = pa.array(np.full(table.num_rows, chunk))
            docs = [pa.array(["d"] * table.num_rows, pa.string()), where, table.column(0), table.column(1).cast(pa.string()), none(pa.bool_()), none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.binary()), none(pa.binary())]
            yield from pa.table(docs, names).to_batches(max_chunksize=1000)
            words, n, first = _hashed(table.column(1), hasher)
            if not len(words):
                return
            side = np.repeat(table.column(2).to_numpy().astype(bool), n)
            rows: list[tuple] = []
            for is_word, keys, good in ((True, words, side), (False, _bigrams(words, first), side[1:][~first[1:]])):
                keys, at = np.unique(keys, return_inverse=True)
                counts = [np.bincount(at[good == m], minlength=len(keys)).astype(np.int64) for m in (False, True)]
                parts = (keys >> _U(63 - bits) >> _U(1)).astype(np.int64)
                edges = np.flatnonzero(np.diff(parts, prepend=-1, append=1 << 62))
                for lo, hi in zip(edges[:-1], edges[1:]):
                    rows.append((is_word, int(parts[lo]), int(hi - lo), _pack(np.diff(keys[lo:hi], prepend=_U(0))), *(_pack(c[lo:hi]) for c in counts)))
            for lo in range(0, len(rows), 200):
                some = rows[lo : lo + 200]
                c = len(some)
                kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(["q"] * c), pa.array(np.full(c, chunk)), pa.nulls(c, table.column(0).type), pa.nulls(c, pa.string()), *(pa.array(x, k) for x, k in zip(zip(*some), kinds))], names)

        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.column(1).nbytes
            if size >= CHUNK_BYTES:
                yield from flush(pa.Table.from_batches(waiting))
                waiting, size = [], 0
                chunk += 1
        if waiting:
            yield from flush(pa.Table.from_batches(waiting))

    return texts.select(id_col, "text", "target").mapInArrow(run, schema)


def _answer(table: pa.Table) -> pa.Table:
    """Counts over all chunks for each chunk's hashes of one range; and a row
    without a chunk: how many hashes the range has, and their counts."""
    chunk, word, part, n, keys, background, target = (table.column(x).to_pylist() for x in ("chunk", "word", "part", "n", "keys", "background", "target"))
    every = np.concatenate([np.cumsum(_unpack(k, c).view(_U), dtype=_U) for k, c in zip(keys, n)])
    distinct, at = np.unique(every, return_inverse=True)
    total = []
    for packed in (background, target):
        own = np.concatenate([_unpack(x, c) for x, c in zip(packed, n)])
        total.append(np.bincount(at, weights=own, minlength=len(distinct)).astype(np.int64))
    ends = np.cumsum(n)
    out = [[_pack(t[at[e - c : e]]) for c, e in zip(n, ends)] + [None] for t in total]
    rest = len(n) * [None]
    return pa.table({
        "chunk": pa.array([*chunk, None], pa.int64()), "word": pa.array([*word, word[0]]), "part": pa.array([*part, part[0]], pa.int32()), "n": pa.array([*n, None], pa.int32()),
        "background": pa.array(out[0], pa.binary()), "target": pa.array(out[1], pa.binary()),
        "size": pa.array([*rest, len(distinct)], pa.int64()), "mass0": pa.array([*rest, int(total[0].sum())], pa.int64()), "mass1": pa.array([*rest, int(total[1].sum())], pa.int64()),
    })


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, *, smoothing: float = 0.5, weight: float = 2.0, max_words: int | None = None, bits: int | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ce_target, ce_background, ce_diff)`` of every row of
    ``docs``; the target is what ``labels`` call good (quality 1) and not toxic.
    ``max_words`` and ``bits`` bounded an earlier model and have no effect."""
    good = stash(labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))).select("doc_id").where("doc_id is not null").distinct(), "lm-target").withColumn("target", F.lit(True))
    if good.count() <= 1_000_000:
        good = F.broadcast(good)
    texts = docs.select("doc_id", "text").join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = stash(_digest(texts, id_col="doc_id", kind=kind, bits=max(6, (n_bytes // RANGE_BYTES).bit_length())), "lm-digest", by="kind")
    asked = rows.where("kind = 'q'").select("chunk", "word", "part", "n", "keys", "background", "target")
    answers = stash(asked.groupBy("word", "part").applyInArrow(_answer, "chunk long, word boolean, part int, n int, background binary, target binary, size long, mass0 long, mass1 long"), "lm-answers")
    size, *mass = answers.where("chunk is null and word").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "mass0", "mass1"))).first()
    size += 1  # the unknown word
    scale = (mass[1] / mass[0] if min(mass) > 0 else 1.0, 1.0)  # the background counts as much text as the target

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        words, n, first = _hashed(texts.column("text"), WordHasher())
        ce = np.zeros((3, len(n)))
        if len(words):
            _, word_at = np.unique(words, return_inverse=True)
            _, pair_at = np.unique(_bigrams(words, first), return_inverse=True)
            found = found.sort_by("part")
            is_word, sizes = np.asarray(found.column("word")), found.column("n").to_pylist()
            later = ~first
            for m, name in enumerate(("background", "target")):
                packed = found.column(name).to_pylist()
                single, pairs = (np.concatenate([np.empty(0, np.int64), *(_unpack(packed[i], sizes[i]) for i in np.flatnonzero(is_word == flag))]) * scale[m] for flag in (True, False))
                own = single[word_at]
                seen, pair = np.zeros(len(words)), np.zeros(len(words))
                seen[1:] = own[:-1]
                seen[first] = 0.0
                pair[later] = pairs[pair_at]
                base = (own + smoothing) / (scale[m] * mass[m] + smoothing * size)
                loss = -np.log((pair + weight * base) / (seen + weight))
                some = n > 0
                ce[1 - m, some] = np.add.reduceat(loss, np.flatnonzero(first)) / n[some]
            ce[2] = ce[0] - ce[1]
        return pa.table({"doc_id": texts.column("id"), "n_tokens": n, "ce_target": ce[0], "ce_background": ce[1], "ce_diff": ce[2]})

    left = rows.where("kind = 'd'").select("chunk", "id", "text").groupBy("chunk")
    right = answers.where("chunk is not null").select("chunk", "word", "part", "n", "background", "target").groupBy("chunk")
    return left.cogroup(right).applyInArrow(score, f"doc_id {kind}, n_tokens long, ce_target double, ce_background double, ce_diff double")
