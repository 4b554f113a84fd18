"""Byte-pair encoding and decoding of words by forced-boundary splitting.

A merge always gives a token of the vocabulary. So where two neighbouring
bytes stand next to each other inside no token at all, no merge can cross: the
place is a certain cut. Words are cut there by one table lookup per byte pair
(NumPy, for all words of a batch that are not cached), the fragments are
merged independently, and their ids are concatenated. A pair whose second byte
ends a word is looked up in a table of its own, as that byte carries the
end-of-word mark.

Before that, the text is split at its special tokens, and the rest at ASCII
blanks, which no word contains. What a chunk between blanks gives is cached. Chunks
of characters below U+0300 are lower-cased and cut into words here (the model
is checked for that on loading); the library's own normaliser and splitter
read all others, so that every version of Unicode gives the library's result.

Defined results: a null text is the empty text, which has no ids. Texts are
read whole; repeated rows come out alike; other columns, whatever their names,
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.common import sliced, tidy
from daybook.llm.piece_codec import load_model

SLICE = 1 << 21  # bytes of text whose unseen words are cut together
LONG = 64  # bytes of a fragment from which it is merged by itself
NONE = 2**31 - 1
PLAIN = 0x300  # below, no character composes with its neighbour
_BLANKS = re.compile("[\t-\r ]+")


def _byte_signs() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable, else the next free sign from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = (b for b in range(256) if b not in set(kept))
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(moved)}}


class WordCodec:
    """Encoder and decoder of one model; built from the bytes of its JSON file."""

    def __init__(self, model: bytes, cache_size: int = 400_000):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        bpe, self.library = spec["model"], Tokenizer.from_str(model.decode())
        kinds = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [s["type"] for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if bpe["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"] or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("only byte-pair models of lower-cased words without a decoder are handled")
        if any(bpe[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("options of this model are not handled")
        signs = _byte_signs()
        self.bytes_of = {s: b for b, s in signs.items()}
        suffix = bpe["end_of_word_suffix"] or ""
        self.surface = {i: t for t, i in bpe["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = bpe["vocab"]
        self.inner = [vocab[signs[b]] for b in range(256)]
        self.final = [vocab[signs[b] + suffix] for b in range(256)]
        self.ranks: dict[int, tuple[int, int]] = {}  # pair of ids -> (rank, id of the merged)
        for rank, merge in enumerate(bpe["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        # byte pairs inside tokens: [0] the second byte goes on, [1] it ends a word
        self.joined = np.zeros((2, 1 << 16), bool)
        for token in vocab:
            ends = bool(suffix) and token.endswith(suffix)
            body = [self.bytes_of[s] for s in (token[: -len(suffix)] if ends else token)]
            for k, (x, y) in enumerate(zip(body, body[1:]), 2):
                self.joined[int(ends and k == len(body)), x << 8 | y] = True
        if not suffix:
            self.joined[1] = self.joined[0]
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.rank_of, self.made_of = (np.array([self.ranks[k][i] for k in self.keys.tolist()], np.int32) for i in (0, 1))
        self.marks = {t: (np.array([i], "<u4").tobytes(), t) for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        import regex

        self.words = regex.compile(pattern)
        # characters on which this module and the library agree by themselves and between letters and digits
        agreed = [c for c in map(chr, range(PLAIN)) if all(self._here(p) == self._there(p) for p in (c, f"a{c}b", f"1{c}2", f"'{c}'"))]
        self.plain = re.compile("[" + "".join(map(re.escape, agreed)) + "]*")
        self.blank_free = re.compile("[" + "".join(re.escape(c) for c in agreed if not c.isspace() or c in "\t\n\v\f\r ") + "]*")
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.cache_size = cache_size

    def _here(self, text: str) -> list[str]:
        return [text.lower()] if text.isalpha() else self.words.findall(text.lower())

    def _there(self, text: str) -> list[str]:
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, p)).decode() for p, _ in parts]

    def split(self, chunk: str) -> list[str]:
        """Words of a text without special tokens."""
        return self._here(chunk) if self.plain.fullmatch(chunk) else self._there(chunk)

    def merged(self, ids: list[int]) -> list[int]:
        """Byte-pair merging as defined: the pair of the lowest rank, the leftmost of equals, until none is left.
        A heap of pairs over a linked list: n log n, whatever the length."""
        n, ranks = len(ids), self.ranks
        heap = [(*r, i) for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1]))]
        if not heap:
            return ids
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ranks.get(ids[i] << 32 | ids[j]) != (rank, new):
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get(new << 32 | ids[k]):
                    heapq.heappush(heap, (r[0], i, r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get(ids[h] << 32 | new)):
                heapq.heappush(heap, (r[0], h, r[1]))
        return [i for i in ids if i >= 0]

    def fragments(self, words: list[bytes]) -> list[list[tuple[int, int]]]:
        """The byte ranges of every word's fragments in the joined words."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        cut = ~np.where(last[1:], self.joined[1][pairs], self.joined[0][pairs])
        cut[ends[:-1] - 1] = True  # between words
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        stops = np.concatenate([starts[1:], [len(data)]])
        first = np.searchsorted(starts, ends - [len(w) for w in words]).tolist()
        spans = list(zip(starts.tolist(), stops.tolist()))
        return [spans[a:b] for a, b in zip(first, [*first[1:], len(spans)])]

    def merged_rows(self, rows: np.ndarray) -> list[tuple[bytes, str]]:
        """``merged`` of every row of a matrix of ids at once, packed and shown: each round joins one pair in every row that has one."""
        n, width = rows.shape
        rank, made = self._pairs(rows[:, :-1], rows[:, 1:])
        out: list[tuple[bytes, str]] = [(b"", "")] * n
        name = self.surface.__getitem__
        which, size = np.arange(n), width
        places = np.arange(width)
        while True:
            if size == 1:
                done = np.ones(len(which), bool)
            else:
                at = rank.argmin(axis=1)  # the leftmost of equals
                every = np.arange(len(which))
                done = rank[every, at] == NONE
            ended = rows[done]
            flat, width = ended.astype("<u4").tobytes(), 4 * size
            for k, i, ids in zip(range(0, len(flat), width), which[done].tolist(), ended.tolist()):
                out[i] = (flat[k : k + width], " ".join(map(name, ids)))
            if done.all():
                return out
            left = ~done
            which, rows, rank, made, at = which[left], rows[left], rank[left], made[left], at[left]
            every = np.arange(len(which))
            joined = made[every, at]
            keep = places[:size] != (at + 1)[:, None]  # the right one of each pair goes
            rows[every, at] = joined
            rows = rows[keep].reshape(len(which), size - 1)
            keep = places[: size - 1] != at[:, None]
            rank, made = rank[keep].reshape(len(which), size - 2), made[keep].reshape(len(which), size - 2)
            size -= 1
            for cell, has in ((at - 1, at > 0), (at, at < size - 1)):  # the pairs that the new id is in
                r, c = every[has], cell[has]
                rank[r, c], made[r, c] = self._pairs(rows[r, c], rows[r, c + 1])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging pairs of ids; rank NONE where they don't merge."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], NONE), self.made_of[at]

    def _shown(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join(map(self.surface.__getitem__, ids))

    def encode_words(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        """Of distinct words the packed ids and what they decode to; each word
        is cut at its forced boundaries, and equal fragments are merged once."""
        if not words:
            return []
        data = b"".join(words)
        whole: dict[int, list[bytes]] = {}  # fragments that end words, by size
        inner: dict[int, list[bytes]] = {}
        plan: list[tuple[list[bytes], bytes]] = []
        for word, spans in zip(words, self.fragments(words)):
            first = [] if len(spans) == 1 else [data[a:b] for a, b in spans[:-1]]
            last = data[slice(*spans[-1])] if first else word
            plan.append((first, last))
            for x in first:
                inner.setdefault(len(x), []).append(x)
            whole.setdefault(len(last), []).append(last)
        known: tuple[dict[bytes, tuple[bytes, str]], ...] = ({}, {})
        signs, ends = np.array(self.inner, np.int32), np.array(self.final, np.int32)
        for done, sizes in zip(known, (inner, whole)):
            for size, found in sizes.items():
                found = list(dict.fromkeys(found))
                raw = np.frombuffer(b"".join(found), np.uint8).reshape(-1, size)
                rows = signs[raw]
                if done is known[1]:
                    rows[:, -1] = ends[raw[:, -1]]
                done.update(zip(found, self.merged_rows(rows) if size <= LONG else (self._shown(self.merged(r)) for r in rows.tolist())))
        out = []
        for first, last in plan:
            if first:
                ids, shown = zip(*(known[0][x] for x in first), known[1][last])
                out.append((b"".join(ids), " ".join(shown)))
            else:
                out.append(known[1][last])
        return out

    def _learn(self, chunks: set[str]) -> dict[str, tuple[bytes, str]]:
        cache = self.cache
        split, foreign = {}, set()
        for c in chunks:
            if c.isascii() or self.plain.fullmatch(c):
                split[c] = self._here(c)
            else:
                split[c] = self._there(c)
                foreign.update(split[c])
        # a plain word by itself is a chunk that gives just this word
        known, words = {}, []
        for w in {w for words in split.values() for w in words}:
            found = cache.get(w) if w not in foreign else None
            if found is None:
                words.append(w)
            else:
                known[w] = found
        known.update(zip(words, self.encode_words([w.encode() for w in words])))
        out = {}
        for c, words in split.items():
            if len(words) == 1:
                out[c] = known[words[0]]
            else:
                found = [known[w] for w in words]
                out[c] = (b"".join([x[0] for x in found]), " ".join([x[1] for x in found]))
        return out

    def _chunks(self, text: str) -> list[str]:
        if self.blank_free.fullmatch(text):  # its blanks are ASCII
            return text.split()
        return [c for c in _BLANKS.split(text) if c]

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, str]]:
        """Of every text its ids, packed as little-endian unsigned 32-bit integers, and what they decode to."""
        pieces: list[list[tuple[str | None, list[str]]]] = []
        needed: set[str] = set()
        for text in texts:
            parts = self.specials.split(text) if text and self.specials else [text or ""]
            row = [(p, []) if i % 2 else (None, self._chunks(p)) for i, p in enumerate(parts)]
            pieces.append(row)
            for _, chunks in row:
                needed.update(chunks)
        if len(self.cache) + len(needed) > self.cache_size:
            self.cache = {c: v for c, v in self.cache.items() if c in needed}
        known = self.cache
        known.update(self._learn(needed - known.keys()))
        for row in pieces:
            if len(row) == 1:
                found = map(known.__getitem__, row[0][1])
            else:
                found = [x for token, chunks in row for x in ([self.marks[token]] if token is not None else map(known.__getitem__, chunks))]
            ids, shown = zip(*found) if row[0][1] or len(row) > 1 else ((), ())
            yield b"".join(ids), " ".join(filter(None, shown) if "" in shown else shown)
        for c in needed:
            if len(c) > 64:
                del known[c]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text]))[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder the tokens stand as they are, a blank between; numbers that are no ids are left out."""
        return " ".join(self.surface[i] for i in ids if i in self.surface)


def default_model() -> str:
    """The 49k model of lower-cased words; ``DAYBOOK_WORD_TOKENIZER`` names another file."""
    if found := os.environ.get("DAYBOOK_WORD_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(spark: SparkSession, path: str):
    """A column function ``text -> array<int>`` of ids."""
    shared = load_model(spark, path)

    @F.pandas_udf("array<int>")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = WordCodec(shared.value)
        for texts in batches:
            yield pd.Series([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in codec.encode_batch(texts)], dtype=object)

    return run


def decoder(spark: SparkSession, path: str):
    """A column function ``array<int> -> text``; null for null."""
    shared = load_model(spark, path)

    @F.pandas_udf("string")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = WordCodec(shared.value)
        for rows in batches:
            yield pd.Series([None if ids is None else codec.decode(list(ids)) for ids in rows], dtype=object)

    return run


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encodes every whole
    text, decodes its ids, and returns digests of both."""
    shared = load_model(docs.sparkSession, path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a large cache without cycles; tidy collects when the task ends
        codec = WordCodec(shared.value)  # of this task: goes with its cache
        for batch in sliced(batches, text_col, SLICE):
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()) for i, shown in codec.encode_batch(x.as_py() for x in batch.column(1))]
            n, ids, shown = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        gc.enable()

    out = T.StructType([docs.schema[id_col], *(T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])
    return docs.select(id_col, text_col).mapInArrow(run, out)
