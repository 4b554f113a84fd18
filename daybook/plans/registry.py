"""Names for functions and queries: SQL functions for a session, and plug-ins by name.

A plug-in is a function that gives a table, or a ``TablePlugin``, which SQL calls
as a table function over a table: ``SELECT * FROM name(TABLE(t), key => 'user_id')``.
Its columns come from its own look at the table's, and it is given the rows of
one key after another, in its order, never the whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from daybook.operators.search import MARKED, PLAIN

PLUGINS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}

#: SQL bodies; they stay inside Catalyst, unlike registered Python functions.
SQL_FUNCTIONS = {
    "journal_tokens(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(translate(lower(coalesce(t, '')), '{MARKED}', '{PLAIN}'), '[\\\\p{{L}}\\\\p{{N}}]+', 0)",
    "journal_hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "journal_card_ok(t STRING) RETURNS BOOLEAN": "luhn_check(regexp_replace(t, '[^0-9]', ''))",
    "journal_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)",
}


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions of this session."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def plugin(name: str):
    """Register ``run(spark, context) -> DataFrame`` under a name."""

    def keep(f):
        PLUGINS[name] = f
        return f

    return keep


def run_plugin(spark: SparkSession, name: str, context: dict, approved: set[str]) -> DataFrame:
    """Run a registered plug-in that has been approved."""
    if name not in approved:
        raise PermissionError(f"{name} is not approved")
    return PLUGINS[name](spark, context)


class TablePlugin:
    """Rows in, rows out, per key. An object of it sees the rows of one key."""

    @staticmethod
    def shape(rows: T.StructType, settings: dict) -> T.StructType:
        """The columns it gives, for a table's columns and the call's settings."""
        raise NotImplementedError

    @staticmethod
    def dealt(settings: dict) -> tuple[list[str], list[str]]:
        """The columns of the key, and those that order its rows."""
        raise NotImplementedError

    def __init__(self, settings: dict) -> None:
        self.settings = settings

    def row(self, row: Row) -> Iterator[tuple]:
        """What a row gives."""
        return iter(())

    def finish(self) -> Iterator[tuple]:
        """What the end of a key gives."""
        return iter(())


def register_plugin(spark: SparkSession, name: str, plugin: type[TablePlugin], approved: set[str]) -> None:
    """Make an approved plug-in a table function of SQL."""
    if name not in approved:
        raise PermissionError(f"{name} is not approved")

    class Function:
        def __init__(self) -> None:
            self.own = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, **settings: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table")
            told = {k: v.value for k, v in settings.items()}
            keys, order = plugin.dealt(told)
            missing = [c for c in (*keys, *order) if c not in rows.dataType.names]
            if missing:
                raise ValueError(f"{name} needs the columns {', '.join(missing)}")
            return AnalyzeResult(schema=plugin.shape(rows.dataType, told), partitionBy=[PartitioningColumn(c) for c in keys], orderBy=[OrderingColumn(c) for c in order])

        def eval(self, rows: Row, **settings) -> Iterator[tuple]:
            if self.own is None:
                self.own = plugin(settings)
            yield from self.own.row(rows)

        def terminate(self) -> Iterator[tuple]:
            if self.own is not None:
                yield from self.own.finish()

    spark.udtf.register(name, F.udtf(Function))


class Streaks(TablePlugin):
    """Runs of rows of one application, per key (setting ``key``), in order of (timestamp, id)."""

    @staticmethod
    def shape(rows: T.StructType, settings: dict) -> T.StructType:
        key, at = rows[settings["key"]], rows["timestamp"].dataType
        return T.StructType([T.StructField(key.name, key.dataType), T.StructField("app_name", T.StringType()), T.StructField("start", at), T.StructField("end", at), T.StructField("n", T.LongType())])

    @staticmethod
    def dealt(settings: dict) -> tuple[list[str], list[str]]:
        return [settings["key"]], ["timestamp", "id"]

    def __init__(self, settings: dict) -> None:
        super().__init__(settings)
        self.run: tuple | None = None

    def row(self, row: Row) -> Iterator[tuple]:
        key, app, at = row[self.settings["key"]], row["app_name"], row["timestamp"]
        if self.run is not None and self.run[1] == app:
            self.run = (*self.run[:3], at, self.run[4] + 1)
        else:
            yield from self.finish()
            self.run = (key, app, at, at, 1)

    def finish(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self.run
