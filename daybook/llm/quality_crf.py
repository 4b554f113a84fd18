"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Node potentials see the line's own features and
those of its neighbours; forward-backward marginals, weighted by the length of
their lines, give the document's share of good text, and a logistic curve
fitted on the same labelled rows turns that share into a score.

Weights are learned from document labels: while learning, a line carries the
label of its document. Learning uses a bounded sample of labelled rows.

Defined results: a null or blank text scores 0 (predicted 0). If the labelled
rows hold fewer than two classes, every text with a line scores the share of
label 1 among them (0.5 without any). Repeated rows score alike; labels that
repeat for one document are all learned from. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import CHUNK, WordHasher, bounded_rows, chunks, held_out, text_bytes, tidy

THRESHOLD = 0.3
_CLASSES = 8  # of bytes: upper, lower, digit, blank, sentence sign, bang, pipe, other sign
_NEIGHBOURS = 8  # the features that neighbouring lines share with a line: the first ones


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _CLASSES, np.uint8)
    for i, some in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", ".,;:?'\"()-", "!", "|", "#$%&*@^~=+<>/\\_[]{}`")):
        kind[[ord(c) for c in some]] = i
    return kind


class LineFeatures:
    """Feature rows of the lines of concatenated texts; a line of blanks only is no line."""

    def __init__(self) -> None:
        self.kinds = _byte_classes()
        self.hasher = WordHasher(fold_case=False)

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, lengths in code points, and each text's range of lines."""
        cut = np.unique(np.concatenate([bounds, np.flatnonzero(data == 10) + 1]))
        los, his = cut[:-1], cut[1:]
        words, at = self.hasher.words(data, cut)
        n_words = np.diff(at)
        use = n_words > 0
        counts = np.stack([np.add.reduceat((self.kinds[data] == k).astype(np.int32), los) for k in range(_CLASSES)], 1)[use] if len(los) else np.zeros((0, _CLASSES))
        length = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int32), los)[use] if len(los) else np.zeros(0)
        same = np.zeros(len(words) + 1, np.int64)
        if len(words) > 1:
            np.cumsum(words[1:] == words[:-1], out=same[2:])
        first, last = at[:-1][use], at[1:][use]
        repeats = same[last] - same[np.minimum(first + 1, last)]
        los, n = los[use], n_words[use].astype(float)
        spans = np.searchsorted(los, bounds)
        again = np.zeros(len(n))
        if len(n):
            base = np.add.reduceat(words, first)  # order-free, enough to tell repeated lines
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(spans))
            order = np.lexsort((base, doc))
            twin = (base[order][1:] == base[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            again[order[1:][twin]] = 1
            again[order[:-1][twin]] = 1
        upper, lower, digit, blank, stop, bang, pipe, sign = counts.T.astype(float) if len(n) else np.zeros((_CLASSES, 0))
        letters = np.maximum(upper + lower, 1)
        own = np.stack([upper / letters, np.minimum(sign / n, 3), np.minimum(bang / n, 2), np.minimum(pipe / n, 1), repeats / np.maximum(n - 1, 1), again, np.minimum(digit / np.maximum(length, 1), 1), (sign / n > 0.3) * 1.0, np.minimum(stop / n, 2), np.log1p(length) / 8, np.log1p(n) / 6, np.minimum(blank / np.maximum(length, 1), 1), (upper / letters > 0.6) * 1.0, (pipe / n > 0.2) * 1.0, (bang / n > 0.3) * 1.0, (repeats / np.maximum(n - 1, 1) > 0.3) * 1.0, np.minimum(length / n, 30) / 10], 1)
        before = np.zeros((len(n), _NEIGHBOURS))
        behind = np.zeros((len(n), _NEIGHBOURS))
        if len(n) > 1:
            joined = doc[1:] == doc[:-1]
            before[1:][joined] = own[:-1, :_NEIGHBOURS][joined]
            behind[:-1][joined] = own[1:, :_NEIGHBOURS][joined]
        return np.concatenate([own, before, behind, np.ones((len(n), 1))], 1).astype(np.float32), length.astype(float), spans


@dataclass
class LineCrf:
    """``unary``: features x states, ``pair``: state to state; states are bad, good."""

    unary: np.ndarray
    pair: np.ndarray
    slope: float = 0.0
    offset: float = 0.0
    constant: float | None = None


def _padded(spans: np.ndarray, cells: int = 50_000) -> Iterator[np.ndarray]:
    """Groups of texts with lines, of like line counts, of at most ``cells`` lines each when padded."""
    n = np.diff(spans)
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * n[order[j]] <= cells:
            j += 1
        yield order[i:j]
        i = j


def _forward_backward(scores: np.ndarray, n: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded chains (texts x lines x 2): log partition, node marginals, sums of edge marginals (texts x 2 x 2)."""
    docs, most, _ = scores.shape
    fwd = np.empty_like(scores)
    fwd[:, 0] = scores[:, 0]
    for t in range(1, most):
        step = np.logaddexp(fwd[:, t - 1, 0, None] + pair[0], fwd[:, t - 1, 1, None] + pair[1]) + scores[:, t]
        fwd[:, t] = np.where((t < n)[:, None], step, fwd[:, t - 1])
    log_z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    back = np.zeros((docs, 2))
    nodes = np.empty_like(scores)
    edges = np.zeros((docs, 2, 2))
    for t in range(most - 1, -1, -1):
        nodes[:, t] = np.exp(fwd[:, t] + back - log_z[:, None]) * (t < n)[:, None]
        if t:
            into = scores[:, t] + back
            edge = np.exp(fwd[:, t - 1, :, None] + pair + into[:, None, :] - log_z[:, None, None])
            on = t < n
            edges += edge * on[:, None, None]
            back = np.where(on[:, None], np.logaddexp(pair[:, 0] + into[:, 0, None], pair[:, 1] + into[:, 1, None]), back)
    return log_z, nodes, edges


def _pad(x: np.ndarray, spans: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(spans)[group]
    at = spans[group][:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
    return x[at], n


def good_shares(model: LineCrf, feats: np.ndarray, lengths: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Per text the length-weighted mean marginal of its good lines; 0 without lines."""
    out = np.zeros(len(spans) - 1)
    unary = feats @ model.unary
    for group in _padded(spans):
        scores, n = _pad(unary, spans, group)
        _, nodes, _ = _forward_backward(scores, n, model.pair)
        weight, _ = _pad(lengths, spans, group)
        weight = weight * (np.arange(weight.shape[1]) < n[:, None])
        out[group] = (nodes[:, :, 1] * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    return out


def _learn(feats: np.ndarray, lengths: np.ndarray, spans: np.ndarray, labels: np.ndarray, *, rounds: int = 60, rate: float = 0.2, ridge: float = 1e-3) -> LineCrf:
    """Maximum conditional likelihood by Adam on the whole sample, then the logistic curve by Newton steps."""
    theta = [np.zeros((feats.shape[1], 2)), np.zeros((2, 2))]
    groups = list(_padded(spans))
    total = max(1, sum(len(g) for g in groups))
    flat = np.arange(len(feats))
    placed = [_pad(flat, spans, g) for g in groups]
    weight = np.zeros(len(feats))  # each text weighs the same
    want = np.zeros((len(feats), 2))
    for group in groups:
        for d in group:
            weight[spans[d] : spans[d + 1]] = 1.0 / (total * (spans[d + 1] - spans[d]))
            want[spans[d] : spans[d + 1], labels[d]] = 1
    first = [np.zeros_like(x) for x in theta]
    second = [np.zeros_like(x) for x in theta]
    for step in range(1, rounds + 1):
        unary = feats @ theta[0]
        nodes = np.zeros_like(unary)
        grads = [ridge * theta[0], ridge * theta[1]]
        for group, (at, n) in zip(groups, placed, strict=True):
            _, marginal, edges = _forward_backward(unary[at], n, theta[1])
            real = np.arange(at.shape[1]) < n[:, None]
            nodes[at[real]] = marginal[real]
            stay = np.zeros((len(group), 2, 2))
            stay[np.arange(len(group)), labels[group], labels[group]] = n - 1
            grads[1] = grads[1] + ((edges - stay) / (n * total)[:, None, None]).sum(0)
        grads[0] = grads[0] + feats.T @ ((nodes - want) * weight[:, None])
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    model = LineCrf(theta[0].astype(np.float32), theta[1])
    use = np.diff(spans) > 0
    z = _logit(good_shares(model, feats, lengths, spans)[use])
    y = labels[use].astype(float)
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * (w - [1.0, 0.0])), -1, 1)
    model.slope, model.offset = float(w[0]), float(w[1])
    return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 2000) -> LineCrf:
    """Learn from at most ``max_rows`` labelled documents (spread by a hash of
    the id). Features are taken from whole texts in the tasks."""
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = bounded_rows(rows, id_col, max_rows).select(id_col, "text", "label")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = LineFeatures()
        for batch in batches:
            for i in range(batch.num_rows):
                feats, lengths, _ = lines.of(*text_bytes(batch.column(3).slice(i, 1)))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), pa.array([feats.tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary())], ["id", "label", "key", "feats", "lengths"])

    kind = rows.schema[id_col].dataType.simpleString()
    found = rows.select(id_col, "label", F.xxhash64("text"), "text").mapInArrow(run, f"id {kind}, label int, key long, feats binary, lengths binary")
    table = found.toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("key", "ascending")])
    lengths = [np.frombuffer(x) for x in table.column("lengths").to_pylist()]
    spans = np.concatenate([[0], np.cumsum([len(x) for x in lengths])]).astype(np.int64)
    lengths = np.concatenate([np.empty(0), *lengths])
    width = LineFeatures().of(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].shape[1]
    feats = np.frombuffer(b"".join(table.column("feats").to_pylist()), np.float32).reshape(-1, width)
    labels = np.asarray(table.column("label"), dtype=np.int64)
    if len(set(labels[np.diff(spans) > 0])) < 2:
        return LineCrf(np.zeros((feats.shape[1], 2), np.float32), np.zeros((2, 2)), constant=float(labels.mean()) if len(labels) else 0.5)
    return _learn(feats, lengths, spans, labels)


def scorer(spark: SparkSession, model: LineCrf):
    """A column function ``text -> score``."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, lines = shared.value, LineFeatures()
        for texts in batches:
            data, offsets = text_bytes(pa.array(texts, pa.large_string(), from_pandas=True))
            out = np.zeros(len(texts))
            for i, j in chunks(offsets, CHUNK):
                bounds = offsets[i : j + 1] - offsets[i]
                if not bounds[-1]:
                    continue
                feats, lengths, spans = lines.of(data[offsets[i] : offsets[j]], bounds)
                some = np.diff(spans) > 0
                if m.constant is not None:
                    score = np.full(j - i, m.constant)
                else:
                    score = 1 / (1 + np.exp(-(m.slope * _logit(good_shares(m, feats, lengths, spans)) + m.offset)))
                out[i:j] = np.where(some, score, 0.0)
            yield pd.Series(out)

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    run = scorer(docs.sparkSession, fit_labelled(docs, labels))
    out = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), run("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit_labelled(docs: DataFrame, labels: DataFrame, *, max_rows: int = 2000) -> LineCrf:
    """Choose the bounded sample among the label rows, so only its documents are read whole."""
    some = bounded_rows(labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & ~held_out("doc_id", 5, 0)), "doc_id", 2 * max_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), max_rows=max_rows)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold. Columns stay."""
    run = scorer(docs.sparkSession, fit_labelled(docs, labels))
    return docs.where(run("text") >= THRESHOLD)
