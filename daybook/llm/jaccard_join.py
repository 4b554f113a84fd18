"""Exact n-gram Jaccard self-join by grouped prefixes.

A document's set holds the 64-bit hashes of its distinct word k-grams. Under
one global order of k-grams, two sets with Jaccard similarity of at least t
share at least min(``DEPTH``, their overlap) of the members of their prefixes,
the first ``n - ceil(t n) + DEPTH`` members.

1. Equal sets become one class; classes of equal prefix and size one group.
2. Groups that share prefix members are candidates. Per member every group is
   paired with one centre only; pairs that meet in a quarter of a prefix and
   pass the size and bitmap bounds are expanded and verified on whole sets.
   This step only saves work: it joins large groups of near copies early.
3. Links found so far give components. Where the groups of a prefix member
   still lie in different components, all class pairs across components are
   tested, in blocks, inside a task: by size, by position, in large buckets by
   bitmap, and then by the number of members in which they meet. A group whose
   own classes lie in different components is a bucket of its own, where one
   meeting is enough: its classes share the whole prefix. Survivors are
   verified. Pairs within a component cannot change the result and are not made.

The order puts frequent k-grams last, so prefixes hold rare ones. The list of
frequent k-grams is bounded (``max_hot``) and found over all documents by
per-partition heavy hitters; any order gives the same result, so its being
approximate costs time only.

Sets are compared by 64-bit hashes of k-grams and identified by 128 bits.
Classes are numbered, and known by (smallest id, number) from then on: the
smallest label of a component holds the component's smallest id.

Defined results: a null, empty or blank text has an empty set and links with
nothing. A text of fewer than k words has one shingle, its whole word
sequence. Repeated rows (also of one id) each come out. Rows with a null id
are compared like any other; they count as larger than every id, so a
component of null ids only has a null component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import WordHasher, chunks, connected_components, mix64, sliced, stash, text_bytes, tidy

_U = np.uint64
BITS, FOLD = 1024, 256
BLOCK = 512
LARGE = 32  # classes in a bucket from which on its entries carry bitmaps
DEPTH = 4
BROADCAST_ROWS = 500_000
SLICE = 4 << 20  # bytes of texts handled at once
SEEN_GROUPS = 100_000  # groups whose prefix members a task remembers having sent


class Shingler:
    def __init__(self, k: int):
        self.k = k
        self.hasher = WordHasher()
        self.factors = mix64(np.arange(1, k + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)

    def sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """``(row, sorted distinct shingle hashes)`` of every row."""
        data, offsets = text_bytes(column)
        for i, j in chunks(offsets):
            words, spans = self.hasher.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = len(words) - self.k + 1
            grams = np.zeros(max(n, 0), _U)
            for at in range(self.k if n > 0 else 0):
                grams += words[at : at + n] * self.factors[at]
            grams = mix64(grams)
            for row in range(i, j):
                lo, hi = spans[row - i], spans[row - i + 1]
                if hi - lo >= self.k:
                    yield row, np.unique(grams[lo : hi - self.k + 1])
                elif hi > lo:
                    few = words[lo:hi]
                    yield row, mix64((few * self.factors[: hi - lo]).sum(keepdims=True) + _U(hi - lo))
                else:
                    yield row, np.empty(0, _U)


def _identity(members: np.ndarray) -> bytes:
    """128 bits that tell sets apart, whatever the order of members."""
    return b"".join(int(mix64(members ^ _U(salt)).sum() & _U(0xFFFFFFFFFFFFFFFF)).to_bytes(8, "big") for salt in (0x51ED270B0A1F39C1, 0x8CB92BA72F3D8DD7))


def _bitmap(members: np.ndarray) -> bytes:
    """Parities of ``BITS`` cells: two sets differ in at least as many members as cells."""
    return np.packbits((np.bincount((members & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _table(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names.split())


def frequent_shingles(docs: DataFrame, *, text_col: str, k: int, max_hot: int, per_task: int = 50_000) -> np.ndarray:
    """At most ``max_hot`` shingles that many documents share, the rarest first."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        keys, counts = np.empty(0, _U), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merge() -> None:
            nonlocal keys, counts, waiting, size
            if not waiting:
                return
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            waiting, size = [], 0
            new, times = new[times > 1], times[times > 1]
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, times]), minlength=len(both)).astype(np.int64)
            keys = both
            if len(keys) > 4 * per_task:
                top = np.sort(np.argpartition(-counts, 2 * per_task)[: 2 * per_task])
                keys, counts = keys[top], counts[top]

        last = b""
        for batch in sliced(batches, 0, SLICE):
            for _, members in shingler.sets(batch.column(0)):
                if (now := members[:64].tobytes()) == last:
                    continue
                last = now
                waiting.append(members)
                size += len(members)
                if size > 1_000_000:
                    merge()
        merge()
        top = np.argsort(-counts, kind="stable")[:per_task]
        top = top[counts[top] > 3]
        yield _table("token c", pa.array(keys[top].view(np.int64)), pa.array(counts[top]))

    found = docs.select(text_col).mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    top = found.orderBy(F.col("c").desc(), "token").limit(max_hot).toPandas()
    return top["token"].to_numpy(dtype=np.int64)[::-1].view(_U).copy()


def _digest(docs: DataFrame, hot: np.ndarray, *, id_col: str, text_col: str, k: int, t: Fraction, kind: str) -> DataFrame:
    """Two kinds of rows. 'd', one per document: id, text hash, class, size,
    group, bitmap. 'p', one per prefix member: token, position, group, size,
    and how many rare members the prefix has. A task sends the prefix of a group
    once, as long as it remembers the group, so copies do not make members hot."""
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))
    schema = f"kind string, id {kind}, tkey long, cid binary, n int, gid long, wide binary, token long, pos int, rare int"
    names = "kind id tkey cid n gid wide token pos rare"

    def prefix(members: np.ndarray, hot_keys: np.ndarray, hot_rank: np.ndarray) -> tuple[np.ndarray, int]:
        n = len(members)
        size = min(n, n - -(-t.numerator * n // t.denominator) + DEPTH)
        if not len(hot_keys):
            return members[:size], size
        at = np.minimum(np.searchsorted(hot_keys, members), len(hot_keys) - 1)
        common = hot_keys[at] == members
        rare = members[~common][:size]
        if len(rare) == size:
            return rare, size
        late = members[common][np.argsort(hot_rank[at[common]], kind="stable")]
        return np.concatenate([rare, late[: size - len(rare)]]), len(rare)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        keys, ranks = shared.value
        sent: set[tuple[int, int, int]] = set()
        for batch in sliced(batches, 2, SLICE):
            ids, tkeys = batch.column(0), batch.column(1)
            size = len(ids)
            cid, n, gid, wide, tokens, rares = [None] * size, np.zeros(size, np.int32), np.zeros(size, np.int64), [None] * size, [], []
            for row, members in shingler.sets(batch.column(2)):
                if not len(members):
                    continue
                n[row], cid[row] = len(members), _identity(members)
                wide[row] = _bitmap(members)
                first, rare = prefix(members, keys, ranks)
                gid[row] = int(mix64(first * _U(0x9FB21C651E98DF25) + np.arange(len(first), dtype=_U)).sum(dtype=_U) >> _U(1))
                group = (int(gid[row]), len(members), rare)
                if group not in sent:
                    if len(sent) >= SEEN_GROUPS:
                        sent.clear()
                    sent.add(group)
                    tokens.append((row, first))
                    rares.append(rare)
            none = lambda count, kind_: pa.nulls(count, kind_)
            yield _table(names, pa.array(["d"] * size), ids, tkeys, pa.array(cid, pa.binary()), pa.array(n), pa.array(gid), pa.array(wide, pa.binary()), none(size, pa.int64()), none(size, pa.int32()), none(size, pa.int32()))
            for lo in range(0, len(tokens), 500):
                some = tokens[lo : lo + 500]
                rows = np.repeat([r for r, _ in some], [len(p) for _, p in some])
                flat = np.concatenate([p for _, p in some])
                pos = np.concatenate([np.arange(len(p), dtype=np.int32) for _, p in some])
                rare = np.repeat(np.array(rares[lo : lo + 500], np.int32), [len(p) for _, p in some])
                c = len(flat)
                yield _table(names, pa.array(["p"] * c), none(c, ids.type), none(c, pa.int64()), none(c, pa.binary()), pa.array(n[rows]), pa.array(gid[rows]), none(c, pa.binary()), pa.array(flat.view(np.int64)), pa.array(pos), pa.array(rare))

    return docs.select(id_col, F.xxhash64(text_col).alias("tkey"), text_col).mapInArrow(run, schema)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), width // 64)


def _folded(wide: np.ndarray) -> np.ndarray:
    """Bitmaps of ``FOLD`` cells out of those of ``BITS``."""
    return np.bitwise_xor.reduce(wide.reshape(len(wide), BITS // FOLD, FOLD // 64), axis=1)


def _most(na: np.ndarray, nb: np.ndarray, t: Fraction) -> np.ndarray:
    """The most members in which sets of these sizes may differ: I >= t (na + nb) / (1 + t)."""
    need = -(-(t.numerator * (na + nb)) // (t.numerator + t.denominator))
    return na + nb - 2 * need


def _bounded(pairs: DataFrame, t: Fraction) -> DataFrame:
    """Of ``(a, b, na, nb, wa, wb)`` the pairs that the wide bitmaps leave possible."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, wa, wb = (batch.column(x) for x in range(6))
            na, nb = na.to_numpy().astype(np.int64), nb.to_numpy().astype(np.int64)
            ok = _differ(_matrix(wa, BITS), _matrix(wb, BITS)) <= _most(na, nb, t)
            mask = pa.array(ok)
            yield _table("a b", a.filter(mask), b.filter(mask))

    return pairs.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, ", ".join(f"{x} {pairs.schema[x].dataType.simpleString()}" for x in "ab"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, *, text_col: str, k: int, t: Fraction, name: str) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` (labels of classes) whose whole sets reach the threshold."""
    pairs = stash(pairs, f"{name}-pairs")
    need = stash(pairs.select("a.key").unionByName(pairs.select("b.key")).distinct().join(classes.select("key", "cid", "tkey"), "key"), f"{name}-need")
    keys = need.select("tkey").distinct()
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = docs.select(F.xxhash64(text_col).alias("tkey"), text_col).join(keys, "tkey", "left_semi")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in sliced(batches, 0, SLICE):
            out, ids = [], []
            seen: set[bytes] = set()
            for _, members in shingler.sets(batch.column(0)):
                if len(members) and (cid := _identity(members)) not in seen:
                    seen.add(cid)
                    ids.append(cid)
                    out.append(members.view(np.int64))
            flat = np.concatenate(out) if out else np.empty(0, np.int64)
            lens = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield _table("cid members", pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(lens), pa.array(flat)))

    sets = texts.select(text_col).mapInArrow(run, "cid binary, members array<long>")
    sets = stash(sets.join(need.select("cid", "key"), "cid").groupBy("key").agg(F.first("members").alias("members")), f"{name}-sets")
    both = pairs.join(sets.select(F.col("key").alias("ka"), F.col("members").alias("ma")), F.col("a.key") == F.col("ka")).join(sets.select(F.col("key").alias("kb"), F.col("members").alias("mb")), F.col("b.key") == F.col("kb"))
    common = F.size(F.array_intersect("ma", "mb"))
    both = both.select("a", "b", common.alias("common"), (F.size("ma") + F.size("mb")).alias("total"))
    return both.where(F.col("common").cast("long") * t.denominator >= (F.col("total") - F.col("common")).cast("long") * t.numerator).select("a", "b")


def _across(entries: DataFrame, t: Fraction, *, bitmaps: bool) -> DataFrame:
    """``(a, b, least)``, once per token: class pairs of different components
    that share a token and pass the size and position bounds (and the bitmaps':
    folded ones first, whole ones for what is left, or a large family of texts
    that are nearly similar would meet in pairs); least: in how many tokens a
    similar pair meets at least.
    Buckets of more than ``BLOCK`` classes are dealt out as pairs of blocks."""
    # entries: token, key, n, pos, comp, m (classes of the token), and wide if bitmaps
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int") if bitmaps else F.lit(1)
    dealt = entries.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", F.explode(others) if bitmaps else F.lit(0))
    more = ["wide"] if bitmaps else []
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "pos", "comp", *more)
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
            token, i, j, block, key = (batch.column(x).to_numpy() for x in range(5))
            n, pos = (batch.column(x).to_numpy().astype(np.int64) for x in (5, 6))
            comp = batch.column(7).to_numpy()
            wide = _matrix(batch.column(8), BITS) if bitmaps else None
            small = _folded(wide) if bitmaps else None
            rows = len(n)
            change = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            ends = np.repeat(np.concatenate([change, [rows]]), np.diff(np.concatenate([[0], change, [rows]])))
            lefts, rights, leasts = [], [], []
            active = np.arange(rows)
            step = 1
            while True:
                active = active[active + step < ends[active]]
                if not len(active):
                    break
                x, y = active, active + step
                ok = (comp[x] != comp[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
                x, y = x[ok], y[ok]
                most = _most(n[x], n[y], t)
                need = (n[x] + n[y] - most) // 2
                at_best = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])
                ok = (np.minimum(n[x], n[y]) * t.denominator >= np.maximum(n[x], n[y]) * t.numerator) & (at_best >= need)
                if bitmaps:
                    for bits in (small, wide):
                        ok[ok] = _differ(bits[x[ok]], bits[y[ok]]) <= most[ok]
                lefts.append(x[ok])
                rights.append(y[ok])
                leasts.append(np.minimum(need[ok], DEPTH))
                step += 1
            x, y, least = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (lefts, rights, leasts))
            return _table("a b least", pa.array(np.minimum(key[x], key[y])), pa.array(np.maximum(key[x], key[y])), pa.array(least.astype(np.int32)))

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            table = table.combine_chunks()
            keys = [table.column(x).to_numpy() for x in range(3)]
            same = (keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1]) & (keys[2] == keys[2][-1])
            cut = int(np.argmax(same))  # where the last, perhaps unfinished, block pair begins
            rest = table.slice(cut)
            if cut:
                yield pairs(table.slice(0, cut).combine_chunks().to_batches()[0])
        if rest is not None and rest.num_rows:
            yield pairs(rest.combine_chunks().to_batches()[0])

    return dealt.mapInArrow(run, "a long, b long, least int")


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row of ``docs``: links join sets
    with 100 * |A and B| >= percent * |A or B|."""
    return _components(docs, id_col=id_col, text_col=text_col, **settings).drop("tkey")


def _components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, max_hot: int = 200_000, name: str = "jaccard") -> DataFrame:
    """The result of ``similar_components`` and each text's 64-bit hash."""
    t = Fraction(percent, 100)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(id_col, text_col)
    hot = frequent_shingles(docs, text_col=text_col, k=k, max_hot=max_hot)
    rows = stash(_digest(docs, hot, id_col=id_col, text_col=text_col, k=k, t=t, kind=kind), f"{name}-digest", by="kind")
    each = rows.where("kind = 'd'").select("id", "tkey", "cid", "n", "gid", "wide")
    classes = each.where("n > 0").groupBy("cid").agg(F.min("id").alias("rep"), F.min("tkey").alias("tkey"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("wide").alias("wide"))
    classes = stash(classes.withColumn("key", F.monotonically_increasing_id()), f"{name}-classes")  # numbered as written
    label = F.struct(F.col("rep").isNull().alias("none"), "rep", "key")

    # groups that share a prefix member
    members = rows.where("kind = 'p'").select("token", "gid", "n", "pos", "rare").repartition("token")
    centre = F.min(F.struct("rare", "n", "gid", "pos"))
    tokens = members.groupBy("token").agg(centre.alias("c"), F.max(F.struct("rare", "n", "gid", "pos")).alias("z")).where("c.gid <> z.gid or c.n <> z.n or c.rare <> z.rare")
    shared = stash(members.join(tokens.select("token", "c"), "token").select("token", "gid", "n", "pos", "c").distinct(), f"{name}-shared")

    # every group against the centre of each of its tokens, and every class against the head of its group
    size = lambda n: F.least(n, n - F.ceil(n * F.lit(t.numerator) / F.lit(t.denominator)) + DEPTH)
    stars = shared.where((F.col("gid") != F.col("c.gid")) | (F.col("n") != F.col("c.n")))
    stars = stars.where(F.least("n", "c.n") * t.denominator >= F.greatest("n", "c.n") * t.numerator)
    stars = stars.groupBy("gid", "n", F.col("c.gid").alias("gid2"), F.col("c.n").alias("n2")).agg(F.count(F.lit(1)).alias("met"))
    stars = stars.where(F.col("met") * 4 >= F.least(size(F.col("n")), size(F.col("n2")))).select("gid", "n", "gid2", "n2")
    heads = stash(classes.groupBy("gid", "n").agg(F.min(F.struct("cid", "wide", label.alias("at"))).alias("h")), f"{name}-heads")
    pairs = stars.join(heads.select("gid", "n", F.col("h.at").alias("a"), F.col("h.wide").alias("wa")), ["gid", "n"]).join(heads.select(F.col("gid").alias("gid2"), F.col("n").alias("n2"), F.col("h.at").alias("b"), F.col("h.wide").alias("wb")), ["gid2", "n2"]).select("a", "b", F.col("n").alias("na"), F.col("n2").alias("nb"), "wa", "wb")
    within = classes.select("gid", "n", label.alias("b"), F.col("wide").alias("wb")).join(heads, ["gid", "n"]).where("b <> h.at").select(F.col("h.at").alias("a"), "b", F.col("n").alias("na"), F.col("n").alias("nb"), F.col("h.wide").alias("wa"), "wb")
    first = _bounded(pairs.unionByName(within), t).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stash(_verified(docs, classes, first, text_col=text_col, k=k, t=t, name=f"{name}-1"), f"{name}-links")

    # what still lies in different components, class by class
    roots = connected_components(links, name)
    placed = stash(classes.join(roots.select("node.key", F.col("root.key").alias("root")), "key", "left").select("gid", "n", "key", F.coalesce("root", "key").alias("comp"), "wide"), f"{name}-placed")
    spread = stash(placed.groupBy("gid", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")), f"{name}-spread")
    lean = shared.select("token", "gid", "n", "pos").join(spread, ["gid", "n"])
    mixed = lean.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m")).where("lo <> hi").select("token", "m")
    open_ = stash(shared.select("token", "gid", "n", "pos").join(mixed, "token"), f"{name}-open")
    few = open_.where(F.col("m") <= LARGE).join(placed.select("gid", "n", "key", "comp"), ["gid", "n"]).select("token", "key", "n", "pos", "comp", "m")
    many = open_.where(F.col("m") > LARGE).join(placed.select("gid", "n", "key", "comp", "wide"), ["gid", "n"]).select("token", "key", "n", "pos", "comp", "m", "wide")
    met = _across(few, t, bitmaps=False).unionByName(_across(many, t, bitmaps=True))
    # a group that the comparisons with its head left in several components, whether or not others hold its members
    split = placed.join(spread.where("lo <> hi").select("gid", "n", "m"), ["gid", "n"]).select(F.xxhash64("gid", "n").alias("token"), "key", "n", F.lit(0).alias("pos"), "comp", "m", "wide")
    own = _across(split.where(F.col("m") <= LARGE).drop("wide"), t, bitmaps=False).unionByName(_across(split.where(F.col("m") > LARGE), t, bitmaps=True))
    met = met.unionByName(own.withColumn("least", F.lit(1)))
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min("least").alias("least")).where("times >= least").select(F.col("a").alias("ka"), F.col("b").alias("kb"))
    met = stash(met, f"{name}-met")
    wide = classes.select("key", label.alias("at"), "n", "wide")
    second = met.join(wide.select(F.col("key").alias("ka"), F.col("at").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "ka").join(wide.select(F.col("key").alias("kb"), F.col("at").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "kb")
    more = _verified(docs, classes, _bounded(second, t), text_col=text_col, k=k, t=t, name=f"{name}-2")
    links = links.unionByName(more)

    # a component's smallest label names it: no join on components
    roots = connected_components(links, name)
    result = classes.select("key", "cid", "rep").join(roots.select("node.key", F.col("root.rep").alias("root"), F.lit(True).alias("joined")), "key", "left")
    result = result.select("cid", F.when(F.col("joined"), F.col("root")).otherwise(F.col("rep")).alias("component_id"))
    result = stash(result, f"{name}-result")  # written, so that adaptive execution can split the rows of a class of many copies
    out = each.join(result, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "tkey")


def keep_one(docs: DataFrame, *, k: int = 3, percent: int = 90, name: str = "jaccard") -> DataFrame:
    """The rows of ``docs`` but for those of a component that has a smaller id
    (a null id is larger than any). Of rows that repeat an id and its text one
    stays: the least by a hash of all its columns. Columns stay."""
    found = stash(_components(docs, k=k, percent=percent, name=name), f"{name}-found")
    gone = stash(found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("gone_id"), F.col("tkey").alias("gone_key")).distinct(), f"{name}-gone")
    if gone.count() <= 2 * BROADCAST_ROWS:
        gone = F.broadcast(gone)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = whole.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_key")), "left_anti")
    again = stash(found.groupBy(F.col("doc_id").alias("again_id"), F.col("tkey").alias("again_key")).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), f"{name}-again")
    n = again.count()
    if not n:
        return kept.select("row.*")
    if n <= 2 * BROADCAST_ROWS:
        again = F.broadcast(again)
    marked = kept.join(again, F.col("row.doc_id").eqNullSafe(F.col("again_id")) & (F.xxhash64("row.text") == F.col("again_key")), "left")
    # one row of each of the repeated ones: the least hash is a partial aggregate, the row comes back by it
    hashed = marked.where("times is not null").select("row", F.xxhash64(F.to_json("row")).alias("h"))
    first = hashed.groupBy(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("tkey")).agg(F.min_by("row", "h").alias("row"))
    return marked.where("times is null").select("row.*").unionByName(first.select("row.*"))
