"""Named text files: one file per row, under exactly the name that the row gives.

``write_files`` is a Spark sink (a Python data source, format ``named_files``).
Every task writes its rows aside, into a folder of its own attempt, and lists
them in a manifest there; only the manifest's place travels to the driver.
When all tasks have ended, the manifests of the attempts that count are read
one after the other and their files moved to their names, so a task that ran
twice leaves one file. If the job fails, what was set aside is removed and no
named file has changed. Names stay below the folder: absolute names, ``..``
and the sink's own working folder are refused before anything is moved.

Paths are those of the file system that the executors share; pyarrow opens
them, so ``file:``, ``hdfs:``, ``s3:`` and ``gs:`` addresses work where
pyarrow can reach them.

Defined results: a null text is an empty file, a null name an error. Of rows
that share a name ``write_files`` keeps the one of the greatest ``order``
columns, or of the greatest text. Texts are UTF-8, exactly as they are; no
line end is added. ``append`` replaces files of the same name and leaves the
others; ``overwrite`` also removes files that the rows don't name.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "named_files"
ASIDE = ".aside"
MOVERS = 8  # files moved at a time when a job commits
SHARE_FILES, SHARE_BYTES = 1000, 64 << 20  # what one task reads


def confined(base: str, path: str) -> str:
    """``path`` below ``base``; an escape from it is an error."""
    full = posixpath.normpath(posixpath.join(base, path.lstrip("/")))
    if full != posixpath.normpath(base) and not full.startswith(posixpath.normpath(base) + "/"):
        raise ValueError(f"{path} leaves {base}")
    return full


def checked(name: str | None) -> str:
    """A relative file name without steps upward, in its plain form."""
    if not name or name.startswith("/") or "\0" in name or "\\" in name:
        raise ValueError(f"not the name of a file: {name!r}")
    parts = name.split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0] == ASIDE:
        raise ValueError(f"not the name of a file: {name!r}")
    return name


def _opened(folder: str):
    """The file system of a folder and the folder's path there."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), posixpath.normpath(folder)


@dataclass
class Attempt(WriterCommitMessage):
    """Where one task's files wait, and how many."""

    place: str
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, names: list[str], overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite
        self.at = [names.index(c) for c in ("name", "text")]
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator) -> Attempt:
        store, base = _opened(self.folder)
        place, n = f"{base}/{ASIDE}/{self.run}/{uuid.uuid4().hex}", 0
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/manifest") as manifest:
            for batch in batches:
                for name, text in zip(*(batch.column(i) for i in self.at)):
                    name = checked(name.as_py())
                    with store.open_output_stream(f"{place}/{n}") as out:
                        out.write((text.as_py() or "").encode())
                    manifest.write(name.encode().hex().encode() + b"\n")
                    n += 1
        return Attempt(place, n)

    def _moved(self, store, base: str, place: str) -> Iterator[str]:
        with store.open_input_stream(f"{place}/manifest") as f:
            names = [bytes.fromhex(x.decode()).decode() for x in f.read().split()]
        for folder in sorted({posixpath.dirname(n) for n in names}):
            store.create_dir(f"{base}/{folder}" if folder else base, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: store.move(f"{place}/{x[0]}", f"{base}/{x[1]}"), enumerate(names)))
        yield from names

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, base = _opened(self.folder)
        kept: set[str] = set()
        for m in messages:
            if m is not None:
                for name in self._moved(store, base, m.place):
                    if self.overwrite:
                        kept.add(name)
        if self.overwrite:
            there = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
            for info in there:
                name = info.path.removeprefix(base).lstrip("/")
                if info.type == fs.FileType.File and not name.startswith(f"{ASIDE}/") and name not in kept:
                    store.delete_file(info.path)
        self._clear(store, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.folder))

    def _clear(self, store, base: str) -> None:
        """Remove what this run set aside, attempts that don't count included."""
        from pyarrow import fs

        aside = f"{base}/{ASIDE}"
        if store.get_file_info(f"{aside}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{aside}/{self.run}")
        if not store.get_file_info(fs.FileSelector(aside, allow_not_found=True)) and store.get_file_info(aside).type != fs.FileType.NotFound:
            store.delete_dir(aside)


class Share(InputPartition):
    """The files that one task reads."""

    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, folder: str, pattern: str) -> None:
        self.folder, self.pattern = folder, pattern

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, base = _opened(self.folder)
        shares, size = [Share([])], 0
        for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            name = info.path.removeprefix(base).lstrip("/")
            if info.type != fs.FileType.File or name.startswith(f"{ASIDE}/") or not fnmatchcase(info.base_name, self.pattern):
                continue
            if len(shares[-1].names) >= SHARE_FILES or size >= SHARE_BYTES:
                shares.append(Share([]))
                size = 0
            shares[-1].names.append(name)
            size += info.size
        return shares

    def read(self, share: Share) -> Iterator[tuple]:
        store, base = _opened(self.folder)
        for name in share.names:
            with store.open_input_stream(f"{base}/{name}") as f:
                found = f.read()
            yield name, found.decode(errors="replace"), len(found)


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("append").save(folder)`` for columns
    name and text; ``spark.read`` of it gives them back, and the size in bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string, size long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("pattern", "*"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        missing = {"name", "text"} - set(schema.names)
        if missing:
            raise ValueError(f"named files need the columns name and text, not {schema.names}")
        return _Writer(self.options["path"], schema.names, overwrite)


def write_files(df: DataFrame, folder: str, *, order: list[str] | None = None, mode: str = "append") -> None:
    """One file per value of ``name``, relative to ``folder``, holding ``text``."""
    df.sparkSession.dataSource.register(NamedFiles)
    latest = F.struct(*(order or []), "text")
    one = df.groupBy("name").agg(F.max(latest).alias("_l")).select(F.col("name").cast("string").alias("name"), F.col("_l.text").cast("string").alias("text"))
    one.write.format(FORMAT).mode(mode).save(folder)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(name, text, size)`` of every file below the folder whose own name fits the pattern."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format(FORMAT).option("pattern", pattern).load(folder)
