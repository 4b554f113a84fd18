"""Journal tables on disk that take changes: versions over files of days.

A table is a folder. ``data`` holds whole rows and ``deltas`` changed or
deleted ones (``_gone``), both by the version that wrote them and by day. A
version is one JSON file in ``versions``; it lists, for each day, which writes
count. It is put in place by a rename that fails if the version is there
already, after everything it names has been written: a write that fails, or
loses the race to another, leaves the last version as it was. Readers of an
older version keep it until ``vacuum``.

Appending writes new files of the days that rows fall on. Updating and
deleting write only the changed rows, as deltas of their days, which readers
put over the day's rows by id; ``compact`` rewrites just the days that have
deltas. Dropping whole days writes no rows at all. A reader opens the files of
the days it asks for, and days without deltas are read without any join.

Defined results: an id is unique within a table (appending a known id is the
caller's error; ``upsert`` replaces). A null id is never changed. A row whose
day changes leaves its old day. Rows without a day are kept under the day
null. Columns added later are null in older rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

NO_DAY = "__HIVE_DEFAULT_PARTITION__"
SMALL = 100_000  # changed rows up to which their ids are broadcast; the versions count them


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Table:
    """One table; ``day`` gives the day of its rows."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", day: str = "cast(timestamp as date)") -> None:
        self.spark, self.folder, self.key, self.day = spark, folder.rstrip("/"), key, day
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------- versions

    def versions(self) -> list[int]:
        found = self._files.globStatus(self._path(f"{self.folder}/versions/*.json")) or []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def version(self, number: int | None = None) -> dict:
        """What a version lists; the newest, if None. An empty table has version 0."""
        number = max(self.versions(), default=0) if number is None else number
        if number == 0:
            return {"version": 0, "schema": None, "days": {}, "made": ""}
        stream = self._files.open(self._path(f"{self.folder}/versions/{number:010d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, before: dict, days: dict, schema: str | None, made: str) -> int:
        """Put a version in place; ``Conflict`` if somebody else has made it meanwhile."""
        jvm, number = self.spark._jvm, before["version"] + 1
        body = json.dumps({"version": number, "schema": schema, "days": days, "made": made}, sort_keys=True)
        aside = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = self._files.create(aside, True)
        out.write(bytearray(body.encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path(f"{self.folder}/versions/{number:010d}.json"), options)
        except Exception as e:
            self._files.delete(aside, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {number} of {self.folder} is there already") from e
            raise
        return number

    # -------------------------------------------------------------- reading

    def read(self, first: str | None = None, last: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of the days from ``first`` to ``last`` (all, and rows without a day, if both are None)."""
        found = self.version(version)
        return self._rows(found, [d for d in found["days"] if (first is None or d != NO_DAY and d >= first) and (last is None or d != NO_DAY and d <= last)]).drop("_day")

    def _stored(self, found: dict, kind: str, days: list[str]) -> DataFrame:
        shape = T.StructType.fromJson(json.loads(found["schema"]))
        extra = [T.StructField("_gone", T.BooleanType())] if kind == "deltas" else []
        shape = T.StructType([*shape, *extra, T.StructField("ver", T.StringType()), T.StructField("_day", T.StringType())])
        paths = [f"{self.folder}/{kind}/ver={ver}/_day={d}" for d in days for ver, _ in found["days"][d][kind]]
        return self.spark.read.schema(shape).option("basePath", f"{self.folder}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def _rows(self, found: dict, days: list[str]) -> DataFrame:
        """Rows with the day they are stored under."""
        if found["schema"] is None:
            raise ValueError(f"{self.folder} holds no table yet")
        clean = [d for d in days if not found["days"][d]["deltas"]]
        rows = self._stored(found, "data", clean).drop("ver")
        changed = [d for d in days if found["days"][d]["deltas"]]
        if not changed:
            return rows
        deltas = self._stored(found, "deltas", changed)
        place = F.coalesce("_day", F.lit(NO_DAY))
        latest = Window.partitionBy(self.key, place).orderBy(F.col("ver").desc())
        latest = deltas.withColumn("_at", F.row_number().over(latest)).where("_at = 1").drop("_at", "ver")
        ids = deltas.select(self.key, place.alias("_place")).distinct()
        few = sum(n for d in changed for _, n in found["days"][d]["deltas"]) <= SMALL
        base = self._stored(found, "data", changed).drop("ver").withColumn("_place", place)
        kept = base.join(F.broadcast(ids) if few else ids, [self.key, "_place"], "left_anti").drop("_place")
        return rows.unionByName(kept).unionByName(latest.where("not _gone").drop("_gone"))

    # -------------------------------------------------------------- writing

    def _put(self, rows: DataFrame, kind: str, number: int) -> dict[str, tuple[str, int]]:
        """Write rows of a kind by day; (version folder, rows) of each day."""
        ver = f"{number:010d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/{kind}/ver={ver}"
        rows.hint("rebalance", "_day").write.partitionBy("_day").parquet(path)
        shape = T.StructType([T.StructField("_day", T.StringType())])
        counts = self.spark.read.schema(shape).parquet(path).groupBy("_day").count().collect()  # a row a day, out of footers
        return {r["_day"] or NO_DAY: (ver, r["count"]) for r in counts}

    def _dated(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_day", F.expr(self.day).cast("date").cast("string"))

    def _merged_schema(self, found: dict, rows: DataFrame) -> str:
        own = T.StructType([f for f in rows.schema if f.name not in ("_day", "_gone")])
        known = T.StructType.fromJson(json.loads(found["schema"])) if found["schema"] else T.StructType([])
        fields = [*known, *(f for f in own if f.name not in known.names)]
        return json.dumps(T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]).jsonValue())

    def _listed(self, found: dict, kind: str, made: dict[str, tuple[str, int]]) -> dict:
        days = {d: {k: list(v) for k, v in x.items()} for d, x in found["days"].items()}
        for d, entry in made.items():
            days.setdefault(d, {"data": [], "deltas": []})[kind].append(list(entry))
        return days

    def append(self, rows: DataFrame) -> int:
        """Rows of new ids. Only files of their days are written."""
        found = self.version()
        made = self._put(self._dated(rows), "data", found["version"] + 1)
        return self._commit(found, self._listed(found, "data", made), self._merged_schema(found, rows), "append")

    def _change(self, found: dict, changed: DataFrame, made: str) -> int:
        """Deltas (rows, _day, _gone) as a version of their own; none, if there are none."""
        entries = self._put(changed, "deltas", found["version"] + 1)
        return self._commit(found, self._listed(found, "deltas", entries), self._merged_schema(found, changed), made) if entries else found["version"]

    def _replaced(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Deltas that put ``new`` rows in the place of ``old`` ones (with their stored day)."""
        new = self._dated(new).withColumn("_gone", F.lit(False))
        moved = old.join(new.select(self.key, F.col("_day").alias("_to")), self.key).where(~F.col("_day").eqNullSafe(F.col("_to"))).drop("_to")
        return new.unionByName(moved.withColumn("_gone", F.lit(True)), allowMissingColumns=True)

    def update(self, which: Column, values: dict[str, Column]) -> int:
        """Set columns of the rows that match; an unknown match is none."""
        found = self.version()
        old = self._rows(found, list(found["days"])).where(F.coalesce(which, F.lit(False)) & F.col(self.key).isNotNull())
        return self._change(found, self._replaced(old, old.drop("_day").withColumns(values)), "update")

    def upsert(self, rows: DataFrame, texts: list[str] = ()) -> int:
        """Insert rows, or replace those of their ids; an empty or null text in ``texts`` keeps the old one."""
        found = self.version()
        if found["schema"] is None:
            return self.append(rows)
        rows = rows.where(F.col(self.key).isNotNull())
        old = self._rows(found, list(found["days"])).join(rows.select(self.key), self.key, "left_semi")
        if texts:
            side = old.select(self.key, *(F.col(c).alias(f"_old_{c}") for c in texts))
            new = rows.join(side, self.key, "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_old_{c}")) for c in texts}).drop(*(f"_old_{c}" for c in texts))
        else:
            new = rows
        return self._change(found, self._replaced(old, new), "upsert")

    def toggle(self, ids: list, column: str = "bookmarked") -> tuple[int, list]:
        """Flip a flag of the rows of some ids (few, a caller's list); the version, and the ids that are not there."""
        found = self.version()
        here = self._rows(found, list(found["days"])).where(F.col(self.key).isin(list(ids)))
        known = {r[0] for r in here.select(self.key).collect()}  # as many as ``ids`` at most
        number = self._change(found, self._replaced(here, here.drop("_day").withColumn(column, ~F.coalesce(F.col(column), F.lit(False)))), "toggle") if known else found["version"]
        return number, [i for i in ids if i not in known]

    def delete(self, which: Column) -> int:
        """Delete the rows that match; an unknown match is none."""
        found = self.version()
        old = self._rows(found, list(found["days"])).where(F.coalesce(which, F.lit(False)) & F.col(self.key).isNotNull())
        return self._change(found, old.withColumn("_gone", F.lit(True)), "delete")

    def cascade(self, parents: DataFrame, column: str = "activity_id") -> int:
        """Delete the rows whose parent (column id of ``parents``) is not there; rows without one stay."""
        found = self.version()
        rows = self._rows(found, list(found["days"])).where(F.col(column).isNotNull() & F.col(self.key).isNotNull())
        orphans = rows.join(parents.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)
        return self._change(found, orphans.withColumn("_gone", F.lit(True)), "cascade")

    def drop_days(self, which: Callable[[str], bool]) -> int:
        """Leave out whole days, told by their date as text. No row is read or written."""
        found = self.version()
        days = {d: x for d, x in found["days"].items() if d == NO_DAY or not which(d)}
        return self._commit(found, days, found["schema"], "drop days") if len(days) < len(found["days"]) else found["version"]

    def retain(self, today: str, days: int) -> int:
        """Leave out days older than ``days`` before today; none if ``days`` is not positive."""
        if days <= 0:
            return self.version()["version"]
        import datetime

        least = (datetime.date.fromisoformat(today) - datetime.timedelta(days)).isoformat()
        return self.drop_days(lambda d: d < least)

    def compact(self) -> int:
        """Rewrite the days that have deltas as plain rows."""
        found = self.version()
        changed = [d for d, x in found["days"].items() if x["deltas"]]
        if not changed:
            return found["version"]
        made = self._put(self._rows(found, changed), "data", found["version"] + 1)
        days = {d: x for d, x in found["days"].items() if d not in changed} | {d: {"data": [list(entry)], "deltas": []} for d, entry in made.items()}
        return self._commit(found, days, found["schema"], "compact")

    def vacuum(self, keep: int = 2) -> int:
        """Remove versions before the newest ``keep``, and files that none of these names; how many folders went."""
        numbers, gone = self.versions(), 0
        kept = [self.version(n) for n in numbers[-keep:]]
        for kind in ("data", "deltas"):
            named = {ver for v in kept for x in v["days"].values() for ver, _ in x[kind]}
            for found in self._files.globStatus(self._path(f"{self.folder}/{kind}/ver=*")) or []:
                if found.getPath().getName().removeprefix("ver=") not in named:
                    gone += self._files.delete(found.getPath(), True)
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"{self.folder}/versions/{n:010d}.json"), False)
        return gone
