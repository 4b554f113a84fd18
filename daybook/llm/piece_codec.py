"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text the byte-pair encoding of that prefix ends in
exactly one token. The table stores it: among the vocabulary pieces that an
Aho-Corasick automaton finds ending at a position, it is the one that is
compatible with the token stored where it begins. Two tokens are compatible if
merging their joined text gives back the two. The ids follow backwards from
the end of the table.

No piece of such a vocabulary has a blank after another sign (checked on
loading), so blank-led chunks encode alone and frequent ones are cached.
Characters outside the vocabulary become byte pieces.

Defined results: a null text is the empty text, which has no ids. Texts are
read whole; repeated rows come out alike; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.common import tidy

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceCodec:
    """Encoder and decoder of one model; built from the bytes of its file."""

    def __init__(self, model: bytes, cache_size: int = 150_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only byte-pair models with identity normalisation are handled")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.texts = [p.piece for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes = [-1] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            else:
                self.surface.append({UNKNOWN: trainer.unk_surface, CONTROL: ""}.get(p.type, p.piece.replace(BLANK, " ")).encode())
        if not trainer.byte_fallback:
            self.bytes = [self.unknown] * 256
        self.decimal = [str(i) for i in range(len(self.texts))]
        self.split = split = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if split else r"(?s).+")
        self.sizes = [len(t) for t in self.texts]
        self.known = re.compile(f"[{''.join(re.escape(p) for p in self.ids if len(p) == 1)}]*") if any(len(p) == 1 for p in self.ids) else re.compile("")
        self.pairs: dict[int, bool] = {}  # by left * number of pieces + right
        self.histories: dict[int, list[tuple[float, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self._history(i):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.cache: dict[str, list[int]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.marks: dict[str, tuple[int, str, str]] = {}
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # neighbours in some piece
        self.cache_size = cache_size

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Byte-pair merging as defined: join the best-scored neighbours, the
        leftmost of equals, until none joins. Also each step's score and the
        first and last part after it. Only the texts of pieces come here."""
        parts = list(text)
        steps = []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def _history(self, token: int) -> list[tuple[float, str, str]]:
        """Merging steps of a token, after a first entry for its characters; empty if merging does not end in it."""
        known = self.histories.get(token)
        if known is None:
            text = self.texts[token]
            parts, steps = self.merged(text)
            known = self.histories[token] = [(0.0, text[0], text[-1]), *steps] if len(parts) == 1 else []
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined texts never joins across the boundary:
        both tokens' own steps are replayed in order of score, and the pair of
        parts at the boundary must never come first."""
        if len(self.pairs) > 250_000:
            self.pairs.clear()
        a, b = self._history(left), self._history(right)
        i = j = 0
        none = float("-inf")
        known = True
        while True:
            across = self.ids.get(a[i][2] + b[j][1])
            ahead = a[i + 1][0] if i + 1 < len(a) else none
            behind = b[j + 1][0] if j + 1 < len(b) else none
            if across is not None and self.scores[across] > ahead and self.scores[across] >= behind:
                known = False
                break
            if ahead == none and behind == none:
                break
            if ahead >= behind:
                i += 1
            else:
                j += 1
        self.pairs[left * len(self.texts) + right] = known
        return known

    def _known_run(self, text: str) -> list[int]:
        """Ids of a text whose every character is a piece."""
        n, pieces, sizes = len(text), len(self.texts), self.sizes
        last = [-1] * (n + 1)
        get, done = self.pairs.get, -1
        for end, (token, size) in self.automaton.iter(text):
            if end == done:  # a prefix has one last token only
                continue
            start = end + 1 - size
            if start:
                left = last[start]
                if left < 0:
                    continue
                ok = get(left * pieces + token)
                if not (self._compatible(left, token) if ok is None else ok):
                    continue
            last[end + 1] = token
            done = end
        ids, at = [], n
        while at:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def _chunk(self, text: str) -> list[int]:
        if self.known.fullmatch(text):
            return self._known_run(text)
        ids: list[int] = []
        lo = 0
        for i, c in enumerate(text):
            if c not in self.ids:
                if i > lo:
                    ids += self._known_run(text[lo:i])
                ids += [self.bytes[b] for b in c.encode("utf-8", "replace")]
                lo = i + 1
        if lo < len(text):
            ids += self._known_run(text[lo:])
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        get = self.cache.get
        for chunk in self.chunks.findall(self.prefix + text.replace(" ", BLANK)):
            found = get(chunk)
            if found is None:
                found = self._chunk(chunk)
                if len(chunk) <= 64:
                    if len(self.cache) >= self.cache_size:
                        self.cache.clear()
                    self.cache[chunk] = found
            ids += found
        return ids

    def _word(self, word: str) -> tuple[int, str, str]:
        """Of a blank and a word: how many ids, the ids in decimal, and what they decode to.
        No piece holds the last two characters of most words that end in a mark, so none crosses there."""
        if len(word) > 1 and word[-2:] not in self.inside:
            a, b = self._known(word[:-1]), self.marks.get(word[-1])
            if b is None:
                b = self.marks[word[-1]] = self._shown(self._chunk(word[-1]))
            return a[0] + b[0], f"{a[1]},{b[1]}", a[2] + b[2]
        return self._shown(self._chunk(BLANK + word))

    def _known(self, word: str) -> tuple[int, str, str]:
        """``_word`` without a look at its mark, kept for the next time."""
        found = self.words.get(word) or self.older.get(word) or self._shown(self._chunk(BLANK + word))
        if len(word) <= 64:
            self.words[word] = found
        return found

    def _shown(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), ",".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")

    def texts_of(self, text: str | None) -> tuple[int, str, str]:
        """How many ids a text has, the ids in decimal, joined by commas, and what they decode to.
        Words parted by single blanks are chunks of their own, and known ones are looked up."""
        words = text.split(" ") if text else []
        if not words or not self.prefix or not self.split or "" in words or BLANK in text:
            ids = self.encode(text)
            return len(ids), ",".join(map(self.decimal.__getitem__, ids)), self.decode(ids)
        if len(self.words) > self.cache_size:  # words not met since the last time are forgotten
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        new = [w for w in set(words) if w not in known]
        for w in new:
            known[w] = older.get(w) or self._word(w)
        n, ids, shown = zip(*map(known.__getitem__, words))
        for w in new:
            if len(w) > 64:
                del known[w]
        return sum(n), ",".join(ids), "".join(shown)[1:]  # without the blank put before the text

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and ids and self.texts[ids[0]].startswith(BLANK):
            data = data[1:]
        return data.decode("utf-8", "replace")


_kept: list[tuple[tuple[bytes, int], PieceCodec]] = []


def codec_of(model: bytes, cache_size: int) -> PieceCodec:
    """This process's codec of a model: tasks of one worker follow one another,
    and the next one finds the automaton, the tested pairs and the words of the
    last one, within the same bounds. One codec is kept."""
    key = (model, cache_size)
    if not _kept or _kept[0][0] != key:
        _kept[:] = [(key, PieceCodec(model, cache_size))]
    return _kept[0][1]


def load_model(spark: SparkSession, path: str):
    """Broadcast the bytes of a model file that the driver can read (its size is that of the file)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def default_model() -> str:
    """The 32k byte-pair model; ``DAYBOOK_TOKENIZER`` names another file."""
    if found := os.environ.get("DAYBOOK_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoder(spark: SparkSession, path: str):
    """A column function ``text -> array<int>`` of ids."""
    shared = load_model(spark, path)

    @F.pandas_udf("array<int>")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = PieceCodec(shared.value)  # of this task: goes with its caches
        for texts in batches:
            yield pd.Series([codec.encode(t) for t in texts], dtype=object)

    return run


def decoder(spark: SparkSession, path: str):
    """A column function ``array<int> -> text``."""
    shared = load_model(spark, path)

    @F.pandas_udf("string")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = PieceCodec(shared.value)  # of this task: goes with its caches
        for rows in batches:
            yield pd.Series([None if ids is None else codec.decode(list(ids)) for ids in rows], dtype=object)

    return run


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 150_000) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encodes every whole
    text, decodes its ids, and returns digests of both. A worker remembers at
    most twice ``cache_size`` words, some 300 bytes each."""
    shared = load_model(docs.sparkSession, path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # large caches without cycles; tidy collects when a task ends
        codec = codec_of(shared.value, cache_size)
        for batch in batches:
            n_tokens, ids_sha256, decoded_sha256 = [], [], []
            for text in batch.column(1):  # one text at a time, not a batch of them
                n, ids, shown = codec.texts_of(text.as_py())
                n_tokens.append(n)
                ids_sha256.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha256.append(hashlib.sha256(shown.encode()).hexdigest())
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha256, pa.string()), pa.array(decoded_sha256, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        gc.enable()

    out = T.StructType([docs.schema[id_col], *(T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])
    return docs.select(id_col, text_col).mapInArrow(run, out)
