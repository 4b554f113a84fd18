"""Where derived tables are kept, and what tells whether their sources have changed."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is
    unset, a temporary folder serves a single machine; a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="daybook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def signature(spark: SparkSession, *paths: str) -> str:
    """A text that changes when any file below the paths does. Lists files and reads none of them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    n, size, mark = found.agg(F.count(F.lit(1)), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n}-{size}-{mark}"
