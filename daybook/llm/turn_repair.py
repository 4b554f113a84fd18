"""Repair of conversations whose turns have lost their order.

Every turn is kept, given the role of user or assistant, or deleted, and empty
turns are inserted, so that the roles' first letters spell ``(s?(ua)+)?`` at
the least cost (``COSTS``). A blank or repeated turn must be deleted; a turn
that is cut off costs more unless it is deleted.

The search goes by layers of increasing cost, as in approximate matching by
bit vectors: layer ``c`` holds for every turn the set, as bits, of the grammar
states from which the turns that follow can be accepted at a cost of exactly
``c``. Each layer comes from earlier ones by table lookups. The first layer
whose set before the first turn holds the start state gives the cost; walking
its bits forward and taking the first edit in ASCII order that stays inside
gives the least audit, and the grammar state fixes the role of each edit.

A conversation of more than ``BLOCK`` turns is taken in blocks from the last
to the first: the least costs of the states at the start of a block open the
layers of the block before. So work grows with the number of turns, not with
its square, and what is held of a conversation is a code of one byte per turn,
a digest per distinct turn, and its audit; its texts stream by a second time,
sorted alike, when the repaired conversation is written.

Defined results: a null role or text is one blank, and so is a null id or turn
in the damage key. Turns are ordered by (turn, role, text), null turns first;
texts compare by their first 32 characters, then by a digest. Repeated rows
are repeated turns. An empty role has no letter, so it can't be kept. A null
conversation id is a conversation of its own. Texts are read whole; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.common import grouped, tidy

#: What the edits cost, and the further cost of a truncated turn that stays.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
BLANKS = " \t\n\v\f\r"
BLOCK = 64  # turns whose layers are held at once

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
START, ACCEPTING = 0, (0, 3)
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LETTERS = "sua"


def _before(steps: dict[int, int]) -> list[int]:
    """For each set of states the set of those from which a step leads into it."""
    return [sum(1 << p for p, q in steps.items() if found >> q & 1) for found in range(16)]


_KEEP = {letter: _before(steps) for letter, steps in _NEXT.items()}
_ANY = [_KEEP["u"][x] | _KEEP["a"][x] for x in range(16)]  # a turn that gets the role it needs
# a turn's code: 0-2 its letter's place, 3 no letter of the grammar; 4 truncated; 8 must go
NONE, CUT, GONE = 3, 4, 8


@functools.lru_cache(maxsize=20_000)
def _layers(codes: bytes, ends: tuple[int, ...]) -> tuple[tuple[bytes, ...], tuple[int, ...]]:
    """Layers of a block whose final states cost ``ends`` more (-1: not final),
    and the least cost from each state before it (-1: none)."""
    n = len(codes)
    least = [-1, -1, -1, -1]
    layers: list[bytes] = []
    nothing = bytes(n + 1)
    keep, again, drop, add = COSTS["K"], COSTS["R"], COSTS["D"], COSTS["I"]
    # deleting every turn and adding two at most reaches a final state, if any does
    for cost in range(max(ends) + drop * n + 2 * add + 1):
        row = bytearray(n + 1)
        inserted = layers[cost - add] if cost >= add else nothing
        dropped = layers[cost - drop] if cost >= drop else nothing
        bits = sum(1 << q for q, end in enumerate(ends) if end == cost) | _ANY[inserted[n]]
        row[n] = bits
        for i in range(n - 1, -1, -1):
            code = codes[i]
            bits = dropped[i + 1] | _ANY[inserted[i]]
            if code < GONE:
                more = TRUNCATED if code & CUT else 0
                at = cost - again - more
                if at >= 0:
                    bits |= _ANY[layers[at][i + 1]]
                letter = code & 3
                at = cost - keep - more
                if letter != NONE and at >= 0:
                    bits |= _KEEP[LETTERS[letter]][row[i + 1] if at == cost else layers[at][i + 1]]
            row[i] = bits
        layers.append(bytes(row))
        for p in range(4):
            if least[p] < 0 and row[0] >> p & 1:
                least[p] = cost
        if min(least[0], least[2], least[3]) >= 0 and (least[1] >= 0 or cost >= max(least) + again):
            break
    return tuple(layers), tuple(least)


def _walk(codes: bytes, layers: tuple[bytes, ...], state: int, cost: int, ends: tuple[int, ...]) -> tuple[str, int]:
    """The least audit of a block from ``state`` at ``cost``, and the state it ends in."""
    out, i, n = [], 0, len(codes)

    def held(at: int, place: int, q: int | None) -> bool:
        return q is not None and 0 <= at < len(layers) and bool(layers[at][place] >> q & 1)

    def needed(p: int) -> int:
        return _NEXT["a"][p] if p == 2 else _NEXT["u"][p]

    while i < n or ends[state] != cost:
        code = codes[i] if i < n else GONE
        more = TRUNCATED if code & CUT else 0
        letter = LETTERS[code & 3] if code < GONE and code & 3 != NONE else None
        kept = _NEXT[letter].get(state) if letter else None
        if i < n and held(cost - COSTS["D"], i + 1, state):
            out.append("D")
            cost, i = cost - COSTS["D"], i + 1
        elif held(cost - COSTS["I"], i, needed(state)):
            out.append("I")
            cost, state = cost - COSTS["I"], needed(state)
        elif i < n and held(cost - COSTS["K"] - more, i + 1, kept):
            out.append("K")
            cost, state, i = cost - COSTS["K"] - more, kept, i + 1
        else:
            out.append("R")
            cost, state, i = cost - COSTS["R"] - more, needed(state), i + 1
    return "".join(out), state


def repair(codes: bytes) -> tuple[int, str]:
    """Least cost of the edits and their least audit, for the codes of a conversation's turns."""
    blocks = [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)] or [b""]
    ends = tuple(0 if q in ACCEPTING else -1 for q in range(4))
    opened, base = [], 0
    for block in reversed(blocks):
        opened.append((ends, base))
        least = _layers(block, ends)[1]
        low = min(x for x in least if x >= 0)  # costs are told from the cheapest state on, so that they stay small
        ends, base = tuple(x - low if x >= 0 else -1 for x in least), base + low
    total, state, audit = ends[START] + base, START, []
    rest = total
    for block, (ends, base) in zip(blocks, reversed(opened)):
        layers = _layers(block, ends)[0]
        edits, reached = _walk(block, layers, state, rest - base, ends)
        audit.append(edits)
        state, rest = reached, ends[reached] + base
    return total, "".join(audit)


def edited(audit: Iterable[str], roles: Iterable[str]) -> Iterator[tuple[str, str | None]]:
    """Each edit of an audit with the role it gives (None for a deleted turn); ``roles`` are those of the turns."""
    state, roles = START, iter(roles)
    for edit in audit:
        role = None if edit == "I" else next(roles)
        if edit == "D":
            yield edit, None
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = _NEXT[role[0]][state]
        yield edit, role


# ------------------------------------------------------------------- columns


def damage(conversations: DataFrame) -> DataFrame:
    """Damaged turns by the checksum of ``conv_id:turn``, modulo 20: 0 drops the
    turn (it stays as a row with ``lost``), 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(text("conv_id"), F.lit(":"), text("turn"))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), (F.col("kind") == 0).alias("lost"), F.explode(times).alias("_copy")).drop("_copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """Turns as they are, in the shape that ``damage`` gives."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.lit(False).alias("lost"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]


def _turns(turns: DataFrame) -> DataFrame:
    return turns.withColumn("head", F.substring("text", 1, 32)).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def repairs(turns: DataFrame) -> DataFrame:
    """Of turns (conv_id, turn, role, text, lost) one row per conversation:
    gaps, blank, duplicate, truncated, illegal, cost, audit. Faults are found
    by columns; no text is moved but its first 32 characters and a digest."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    skinny = _turns(turns).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "head", "digest", (last == "").alias("blank"), (~last.rlike("[.!?]")).alias("cut"), "lost")

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.ChunkedArray, tuple]]:
        for group in _conversations(batches):
            codes, turns, seen = bytearray(), set(), set()
            blank = duplicate = truncated = illegal = 0
            low = high = None
            before = None
            conv = None
            for table in group:
                conv = table.column("conv_id").slice(0, 1)
                for turn, role, digest, empty, cut, lost in zip(*(table.column(c).to_pylist() for c in ("turn", "role", "digest", "blank", "cut", "lost"))):
                    if lost:
                        continue
                    if turn is not None:
                        low, high = turn if low is None else min(low, turn), turn if high is None else max(high, turn)
                        turns.add(turn)
                    letter = role[:1]
                    if before is not None and before + letter not in ("su", "ua", "au"):
                        illegal += 1
                    before = letter
                    key = hashlib.blake2b(role.encode(), key=digest, digest_size=16).digest()
                    code = LETTERS.index(letter) if letter and letter in LETTERS else NONE
                    if empty:
                        blank, code = blank + 1, code | GONE
                    elif key in seen:
                        duplicate, code = duplicate + 1, code | GONE
                    elif cut:
                        truncated, code = truncated + 1, code | CUT
                    seen.add(key)
                    codes.append(code)
            cost, audit = repair(bytes(codes))
            gaps = high - low + 1 - len(turns) if turns else 0
            yield conv, (gaps, blank, duplicate, truncated, illegal, cost, audit)

    fields = [turns.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in REPORT[1:-1]), T.StructField("audit", T.StringType())]
    return skinny.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).mapInArrow(_packed(reports, REPORT), T.StructType(fields))


def _packed(rows: Callable, names: list[str], size: int = 512) -> Callable:
    """A batch function of one that gives a conversation's id and result at a time."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while some := list(islice(found, size)):
            ids = pa.chunked_array([c for i, _ in some for c in i.chunks], some[0][0].type).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, zip(*(values for _, values in some)))], names=names)

    return run


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.Table]]:
    """Of rows sorted by the first column, for each value the tables that hold
    its rows, one at a time. A batch is held, not a conversation."""
    pending: pa.Table | None = None
    batches = (b for b in batches if b.num_rows)

    def same(a: pa.Table, b: pa.Table) -> bool:
        return a.column(0)[0].as_py() == b.column(0)[0].as_py()

    def tables() -> Iterator[pa.Table]:
        for b in batches:
            yield from grouped(iter([b]), 1)

    source = tables()
    pending = next(source, None)
    while pending is not None:
        head = pending

        def group(first: pa.Table = head) -> Iterator[pa.Table]:
            nonlocal pending
            yield first
            for table in source:
                if not same(first, table):
                    pending = table
                    return
                yield table
            pending = None

        yield group()


def repaired_conversations(turns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The report of ``repairs`` and ``repaired_sha256``, the digest of the
    repaired turns as ``role:text``, joined by line ends. The texts pass once,
    in the order of the report, behind their conversation's audit."""
    found = repairs(turns) if found is None else found
    report = F.struct(*REPORT[1:]).alias("report")
    nothing = {c: F.lit(None).cast(kind).alias(c) for c, kind in _turns(turns).select("turn", "role", "text", "lost", "head", "digest").dtypes}
    audits = found.select("conv_id", F.lit(0).alias("part"), report, *nothing.values())
    rows = _turns(turns).select("conv_id", F.lit(1).alias("part"), F.lit(None).cast(audits.schema["report"].dataType).alias("report"), *nothing)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.ChunkedArray, tuple]]:
        for group in _conversations(batches):
            digest, first = hashlib.sha256(), True
            report = conv = edits = None

            def put(role: str, text: str) -> None:
                nonlocal first
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

            for table in group:
                texts = table.column("text")
                for i, (part, role, lost) in enumerate(zip(*(table.column(c).to_pylist() for c in ("part", "role", "lost")))):
                    if part == 0:
                        conv, report = table.column("conv_id").slice(i, 1), table.column("report")[i].as_py()
                        here: list[str] = []  # the role of the turn at hand
                        edits = edited(report["audit"], iter(here.pop, None))
                    elif not lost:
                        here.append(role)
                        for edit, given in edits:
                            if edit == "I":
                                put(given, "")
                                continue
                            if edit != "D":
                                put(given, texts[i].as_py())
                            break
            for _, given in edits:
                put(given, "")
            yield conv, (*report.values(), digest.hexdigest())

    schema = T.StructType([*(found.schema[c] for c in REPORT), T.StructField("repaired_sha256", T.StringType())])
    both = audits.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", *_order())
    return both.select("conv_id", "part", "report", "role", "text", "lost").mapInArrow(_packed(written, schema.names), schema)
