"""Folds over ordered rows of a key: one kernel serves batch and stream.

In batch, rows are dealt out by key and sorted within partitions, and a kernel
is fed batch by batch with the state of the key at hand (``per_key``): a task
holds one batch and one state, however long a key's history is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Applications that count as distraction.
ENTERTAINMENT = ("youtube", "netflix", "twitch", "reddit", "twitter", "instagram", "tiktok", "facebook", "x.com")
#: Applications whose content changes fast.
COMMUNICATION = ("discord", "slack", "teams", "whatsapp", "telegram", "gmail", "outlook", "mail")
MINUTE = 60


def frame_dedup(rows: DataFrame, key: str = "user_id", hash_col: str = "h", threshold: int = 8) -> DataFrame:
    """The rows of each key that differ from the last *kept* one by more than
    the threshold bits; the first is kept."""
    kind = rows.schema[key].dataType.simpleString()

    def kernel(state, some):
        kept, last = [], state
        for id_, h in some:
            if h is not None and (last is None or ((last ^ h) & 0xFFFFFFFFFFFFFFFF).bit_count() > threshold):
                last = h
                kept.append(id_)
        return kept, last

    return per_key(rows, kernel, key, ["id", hash_col], f"{key} {kind}, id {rows.schema['id'].dataType.simpleString()}")


# Kernels: state (a tuple of plain values, or None at the start) and rows in
# order of time give outputs and the next state.


def dedup_kernel(state, rows, threshold: int = 8):
    """Rows are (id, seconds, hash, monitor, bookmarked, paused)."""
    last, monitor = state or (None, None)
    kept = []
    for id_, _, h, where, marked, paused in rows:
        if paused:
            last = None
            continue
        if marked:
            kept.append(id_)
            continue
        if where != monitor:
            last, monitor = None, where
        if last is None or ((last ^ h) & 0xFFFFFFFFFFFFFFFF).bit_count() > threshold:
            last = h
            kept.append(id_)
    return kept, (last, monitor)


def tier_kernel(state, rows, app: str = "", *, near: int = 3, like: int = 10):
    """Cache tiers of one (app, title). Rows are (id, seconds, hash, bookmarked).
    An identical frame leaves the entry; a minor change updates its hash but
    not its time; a full analysis resets both, and so does a bookmarked frame."""
    entry = state
    limit = 240 if any(c in app.lower() for c in COMMUNICATION) else 420
    out = []
    for id_, at, h, marked in rows:
        tier = "full"
        if entry is not None and not marked:
            d = ((entry[0] ^ h) & 0xFFFFFFFFFFFFFFFF).bit_count()
            if d <= near:
                tier = "identical"
            elif d <= like and at - entry[1] < limit:
                tier = "minor"
        out.append((id_, tier))
        if tier == "minor":
            entry = (h, entry[1])
        elif tier == "full":
            entry = (h, at)
    return out, entry


def title_tiers(state, rows):
    """``tier_kernel`` of rows (id, seconds, hash, bookmarked, app): the app of a key is that of its rows."""
    return tier_kernel(state, [r[:4] for r in rows], (rows[0][4] or "") if rows else "")


def tiers_with_eviction(rows, capacity: int = 30):
    """Tiers over all keys in one order, as a cache of limited size gives them:
    beyond ``capacity`` keys the one inserted first goes. Rows are
    (id, seconds, app, title, hash, bookmarked)."""
    cache: dict[tuple[str, str], tuple[int, float]] = {}
    out = []
    for id_, at, app, title, h, marked in rows:
        key = (app or "unknown", (title or "")[:100])
        (pair,), entry = tier_kernel(cache.get(key), [(id_, at, h, marked)], app or "")
        out.append(pair)
        cache[key] = entry
        if len(cache) > capacity:
            cache.pop(next(iter(cache)))
    return out


def alert_kernel(state, rows, *, distraction: float = 45, pause: float = 90, focus: float = 120, cooldown: float = 30):
    """Usage alerts. Rows are (id, seconds, app, category)."""
    last_app, since, work, told = state or (None, {}, None, {})
    since, told, out = dict(since), dict(told), []

    def tell(kind: str, id_: int, now: float, minutes: float) -> None:
        if now - told.get(kind, float("-inf")) >= cooldown * MINUTE:
            told[kind] = now
            out.append((id_, kind, int(minutes)))

    for id_, now, app, category in rows:
        app = (app or "").lower()
        if app != last_app:
            since[app], last_app = now, app
            if work is None or now - work > pause * MINUTE:
                work = now
        on_app = (now - since[app]) / MINUTE
        if any(e in app for e in ENTERTAINMENT) and on_app >= distraction:
            tell("distraction", id_, now, on_app)
        worked = (now - work) / MINUTE
        if worked >= pause:
            tell("break", id_, now, worked)
            work = now
        if category == "coding" and on_app >= focus:
            tell("focus", id_, now, on_app)
    return out, (last_app, since, work, told)


def meeting_kernel(state, rows, *, confirm: float = 20, silent: int = 3, away: float = 300, gone: float = 30):
    """Meeting sessions from voice probes. Rows are (seconds, voice, in_front, alive).
    Two voiced probes within ``confirm`` seconds start one; it ends after
    ``silent`` silent chunks in front, ``away`` seconds away, or ``gone``
    seconds away once the process is dead. Outputs (start, end)."""
    start, probe, quiet, left = state or (None, None, 0, None)
    out = []
    for now, voice, in_front, alive in rows:
        if start is None:
            if voice and in_front:
                if probe is not None and now - probe <= confirm:
                    start, quiet, left, probe = probe, 0, None, None
                else:
                    probe = now
            continue
        if in_front:
            left = None
            quiet = 0 if voice else quiet + 1
        else:
            left = now if left is None else left
        absent = 0 if left is None else now - left
        if quiet >= silent or absent >= away or (absent > gone and not alive):
            out.append((start, now))
            start, probe, quiet, left = None, None, 0, None
    return out, (start, probe, quiet, left)


def look_kernel(state, rows, *, interval: float = 40, change: float = 10, idle_after: int = 3):
    """When a screen is looked at: rows are (seconds, changed). Since the last
    saved frame at least ``change`` seconds must have passed, and ``interval``
    seconds once ``idle_after`` looks in a row found no change. Outputs
    (seconds, saved) of each look; the first look saves."""
    saved, skips = state or (None, 0)
    out = []
    for now, changed in rows:
        since = float("inf") if saved is None else now - saved
        if since < (interval if skips >= idle_after else change):
            continue
        keep = saved is None or bool(changed)
        saved, skips = (now, 0) if keep else (saved, skips + 1)
        out.append((now, keep))
    return out, (saved, skips)


def poll_kernel(rows, **settings):
    """The looks of one whole history."""
    return look_kernel(None, rows, **settings)[0]


def per_key(rows: DataFrame, kernel: Callable, key: str | list[str], columns: list[str], schema: str, *, finish: Callable | None = None) -> DataFrame:
    """A kernel over each key's rows in order of (timestamp, id), in batch. The
    outputs follow the key's columns; ``seconds`` among ``columns`` is the time in seconds.
    ``finish`` gives the outputs of a key's last state."""
    keys = [key] if isinstance(key, str) else key
    wanted = list(dict.fromkeys([*keys, "timestamp", "id", *(c for c in columns if c != "seconds")]))
    shape = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def shown(out: list) -> pa.RecordBatch:
            made = list(zip(*out)) if out else [()] * len(shape)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, shape)], schema=shape)

        def ended() -> list:
            return [(*at, *(x if isinstance(x, tuple) else (x,))) for x in finish(state)] if finish and at is not None else []

        for batch in batches:
            values = {c: batch.column(c).to_pylist() for c in wanted if c != "timestamp"}
            micros = batch.column("timestamp").cast(pa.timestamp("us", batch.column("timestamp").type.tz)).cast(pa.int64()).to_pylist()
            values["seconds"] = [None if x is None else x / 1e6 for x in micros]
            out = []
            spots = zip(zip(*(values[k] for k in keys)), zip(*(values[c] for c in columns)))
            for own, some in groupby(spots, lambda x: x[0]):
                if own != at:
                    out += ended()
                    at, state = own, None
                made, state = kernel(state, [x for _, x in some])
                out += [(*own, *(x if isinstance(x, tuple) else (x,))) for x in made]
            yield shown(out)
        if out := ended():
            yield shown(out)

    return rows.select(*wanted).repartition(*keys).sortWithinPartitions(*keys, "timestamp", "id").mapInArrow(run, schema)
