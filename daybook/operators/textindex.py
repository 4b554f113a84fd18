"""A stored inverted index of texts in segments, checked against its source and mended where it differs.

Screen texts repeat: most frames look like the one before. So words are kept by
distinct text, and rows point to the texts of their columns. A change writes a
segment of its own size: the rows it brings, and a list of the older rows that
it replaces or deletes. Segments of like size are merged when there are several
of them, so a row is rewritten a few times in all, and a question meets few
segments. Below one folder stand, each partitioned by segment:

* ``texts``: key (128-bit hash of the text), said (its words, by spaces), n (of them), and of its rows m (how many), len (the least), col (their column, -1 for several)
* ``postings``: bucket (of the term), term, block, key, m and col of the text, positions; a bucket has a sorted file of each file of ``texts``
* ``rows``: part (of the key), id, column, key, len (words of all columns of the row)
* ``terms``: bucket, term, n (rows that hold it), k (texts that do), often (whether it has blocks: frequent; null if in several columns, and a further row takes off what n counts twice)
* ``tops``: of such terms bucket, term, block, w (what bounds its weights), n, k
* ``gone``: rows (of a segment, id) that no longer count, with their keys
* ``about``: one row a generation: its segments, what is gone, rows, words, sign of the source

A posting's block is a range of weights in a score (``block_of``), the largest one of the text's rows;
the end of the range bounds the score of
all its rows, also when the average length has changed since (``bound``). The best rows of a frequent term are therefore
found from its first blocks: reading stops where no block left can hold a
better one, whatever the filter, and the scores are those of a full scan.

Building moves little: a text goes through one exchange, to stand once, and its
postings through none: a task sorts those of its own texts by term (a bucket's
files are sorted each, and statistics tell which parts of them hold a term), and
keys of few texts take little room. Terms are counted in the tasks first. What
belongs to rows is narrow. Where many rows show few texts, a ``Source`` gives the
rows with keys and each text once.

A generation counts once its row of ``about`` is there, so a change that is cut
off leaves the last one as it was. Files are never changed; ``vacuum`` removes
segments that no kept generation names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.text import bound as bind

#: Letters and what they are without their marks.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
BUCKETS, PARTS = 16, 16  # folders of a segment's tables; within one, terms and keys are sorted, so their statistics tell what to read
FORMAT = "format-4"  # below a store's folder: tables of another format are not looked at
FREQUENT = 128  # rows from which a term has blocks, and rows that are read first
STEPS = 32  # blocks while the share that a weight lacks of the largest one halves
SPLIT, SHARE = 3_000_000, 200_000  # words of texts for one task that sorts postings, at most and (if cores are free) at least
FANOUT = 4  # segments of like size that are merged into one, and the step between sizes
SMALL = 100_000  # rows up to which a list of gone rows, or of a segment's keys, is broadcast
MANY = 500_000  # frequent terms up to which their list is; of more, those of some buckets after others
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without marks."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _part(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def weight(f: Column, length: Column, average: Column | float) -> Column:
    """A row's share of a term's score, before the term's rarity."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def block_of(f: Column, length: Column, average: float) -> Column:
    """The block of a weight: equal steps of the logarithm of what it lacks of the largest one, so heavy rows lie in small blocks."""
    return F.floor(F.log2(1 + f / (K1 * (1 - B + B * length / average))) * STEPS).cast("int")


def _most(block: Column) -> Column:
    """No weight of a block is above it."""
    return (K1 + 1) * (1 - F.pow(F.lit(2.0), -(block + 1) / F.lit(float(STEPS))))


def bound(most: float, before: float, average: float) -> float:
    """What a weight can be at most now that was ``most`` while the average length
    was ``before``: a longer average lightens the share of length by their ratio at most."""
    x, ratio = most / (K1 + 1), max(average / before, 1.0)
    return (K1 + 1) * x * ratio / (x * ratio + 1 - x)


SHAPES = {
    "texts": "key binary, said string, n int, m long, len long, col int, seg string",
    "postings": "term string, block int, key binary, m long, col int, positions array<int>, seg string, bucket int",
    "rows": "id {kind}, column int, key binary, len long, seg string, part int",
    "terms": "term string, n long, k long, often boolean, seg string, bucket int",
    "tops": "term string, block int, w double, n long, k long, seg string, bucket int",
    "gone": "of string, id {kind}, len long, keys array<binary>, seg string",
}


@dataclass
class TextIndex:
    """One generation. ``segments`` are (name, rows, words), ``gone`` (name, rows)."""

    spark: SparkSession
    path: str
    columns: list[str]
    rows: int
    words: int
    kind: str  # type of the ids
    generation: str = ""
    sign: str = ""
    segments: list[tuple[str, int, int]] = field(default_factory=list)
    gone: list[tuple[str, int]] = field(default_factory=list)

    def table(self, name: str, segments: list[str] | None = None) -> DataFrame:
        """A table of the generation's segments, without what is gone of its rows."""
        wanted = segments if segments is not None else [g for g, _ in self.gone] if name == "gone" else [x for x, *_ in self.segments]
        shape = SHAPES[name].format(kind=self.kind)
        if not wanted:
            return self.spark.createDataFrame([], shape)
        found = self.spark.read.schema(shape).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/seg={x}" for x in wanted])
        return self.living(found) if name == "rows" and self.gone else found

    def living(self, rows: DataFrame) -> DataFrame:
        """Rows (seg, id) that still count."""
        gone = self.table("gone").select(F.col("of").alias("seg"), "id")
        return rows.join(F.broadcast(gone) if sum(n for _, n in self.gone) <= SMALL else gone, ["seg", "id"], "left_anti")

    def postings(self, term: str) -> DataFrame:
        """``(key, positions)`` of the texts that hold a term, a text once; reads one bucket of each segment."""
        found = self.table("postings").where((F.col("bucket") == _bucket(F.lit(term))) & (F.col("term") == term))
        found = found.select("key", "positions")
        return found if len(self.segments) == 1 else found.groupBy("key").agg(F.first("positions").alias("positions"))  # the same text has the same positions

    def hits(self, phrase: list[str]) -> DataFrame:
        """``(key, f)``: how often each text holds the words one after another."""
        found = self.postings(phrase[0])
        for n, word in enumerate(phrase[1:], 1):
            after = self.postings(word).select("key", F.transform("positions", lambda p: p - F.lit(n)).alias("before"))  # noqa: B023  called at once
            found = found.join(after, "key").select("key", F.array_intersect("positions", "before").alias("positions"))
        return found.select("key", F.size("positions").alias("f")).where("f > 0")

    def matches(self, hits: DataFrame) -> DataFrame:
        """``rows`` of texts (key, ...); only the parts of their keys are read where the planner knows them."""
        return self.table("rows").join(hits.withColumn("part", _part("key")), ["part", "key"])

    def frequency(self, term: str) -> tuple[int, list[tuple[str, int, int, float]], list[str]]:
        """How many rows hold a term, its blocks as (segment, block, rows, largest weight), and segments where it has none."""
        own = lambda table: self.table(table).where((F.col("bucket") == _bucket(F.lit(term))) & (F.col("term") == term)).collect()
        found = own("terms")  # a row or two a segment
        n = sum(r["n"] for r in found)
        if n and self.gone:
            lost = self.table("gone").select("of", "id", F.explode(F.array_distinct("keys")).alias("key")).join(self.postings(term).select("key"), "key")
            n -= lost.where(F.col("of").isin([x for x, *_ in self.segments])).select("of", "id").distinct().count()
        blocks = own("tops") if any(r["often"] for r in found) else []  # a row a block, of which a term has some hundred at most
        return n, [(b["seg"], b["block"], b["n"], b["w"]) for b in blocks], sorted({r["seg"] for r in found if not r["often"]})

    def best(self, term: str, limit: int, allowed: DataFrame | None = None) -> tuple[DataFrame, int, int] | None:
        """The ``limit`` rows (id, weight) of the largest weight among those of
        ``allowed`` (ties to the smaller id), how many rows hold the term, and
        how many rows of its blocks were read; None for a term without blocks."""
        n, blocks, rare = self.frequency(term)
        if not blocks:
            return None
        average = self.words / self.rows
        own = lambda t, segments: self.table(t, segments).where((F.col("bucket") == _bucket(F.lit(term))) & (F.col("term") == term))
        few = None  # rows of segments that have no blocks of the term, all of them
        if rare:
            hits = own("postings", rare).select("seg", "key", F.size("positions").alias("f"))
            few = self.table("rows", rare).join(hits, ["seg", "key"]).groupBy("id").agg(F.sum("f").alias("f"), F.first("len").alias("len"))
        before = {seg: max(words, 1) / max(rows, 1) for seg, rows, words in self.segments}
        order = sorted(((bound(most, before[seg], average) + 1e-9, size, seg, block) for seg, block, size, most in blocks if size), reverse=True)
        taken, read, least, found = 0, 0, float("-inf"), None
        while taken < len(order) and order[taken][0] >= least:
            aim, more = max(4 * limit, FREQUENT, read), 0  # each round reads about as much as all before it
            while taken < len(order) and order[taken][0] >= least and more < aim:
                more += order[taken][1]
                taken += 1
            read += more
            chosen = F.array(*[F.struct(F.lit(seg).alias("seg"), F.lit(block).alias("block")) for _, _, seg, block in order[:taken]])
            tops = own("postings", sorted({x[2] for x in order[:taken]})).where(F.col("block").isin(sorted({x[3] for x in order[:taken]})) & F.array_contains(chosen, F.struct("seg", "block")))
            used = sorted({x[2] for x in order[:taken]})
            tops = self.table("rows", used).join(tops.select("seg", _part("key").alias("part"), "key", F.size("positions").alias("f")), ["seg", "part", "key"]).select("id", "f", "len")
            tops = tops if few is None else tops.unionByName(few)
            tops = tops.select("id", weight(F.col("f"), F.col("len"), average).alias("weight"))
            found = tops if allowed is None else allowed.select("id").join(F.broadcast(tops) if read <= SMALL else tops, "id")
            found = found.orderBy(F.col("weight").desc(), "id").limit(limit)
            if taken < len(order):
                held = [r["weight"] for r in found.select("weight").collect()]  # ``limit`` numbers at most
                least = min(held) if len(held) == limit else float("-inf")
        return found, n, read


# --------------------------------------------------------------------- writing


@dataclass
class Source:
    """Rows to index: ``cells`` are (id, cells: an array of ``cell``, one of each
    column), ``texts`` (text) holds every text of theirs, and may hold others."""

    cells: DataFrame
    texts: DataFrame

    def of(self, ids: DataFrame) -> Source:
        """The rows of some ids (a column id)."""
        return Source(self.cells.join(ids, "id", "left_semi"), self.texts)


def cell(text: Column) -> Column:
    """What rows hold of a text: its key, and how many words it has. A null text is the empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(_key(text).alias("key"), F.size(tokens(text)).alias("n"))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _source(rows: DataFrame | Source, columns: list[str], id_col: str) -> Source:
    if isinstance(rows, Source):
        return rows
    texts = rows.select(F.explode(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("text"))
    return Source(rows.select(F.col(id_col).alias("id"), F.array(*[cell(F.col(c)) for c in columns]).alias("cells")), texts)


def _rows(source: Source) -> DataFrame:
    """``(id, column, key, len)`` of every cell."""
    length = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    rows = source.cells.select("id", length.alias("len"), F.posexplode("cells").alias("column", "cell"))
    return rows.select("id", "column", F.col("cell.key").alias("key"), "len")


def _texts(source: Source, many: DataFrame, few: bool, splits: int) -> DataFrame:
    """``(key, said, n)`` of the texts of ``many`` (key, ...), each once, in so many parts."""
    texts = source.texts.select(_key("text").alias("key"), "text")
    texts = texts.join(F.broadcast(many.select("key")), "key", "left_semi") if few else texts
    words = texts.repartition(splits, "key").groupBy("key").agg(F.first("text").alias("text")).select("key", tokens(F.col("text")).alias("words"))
    return words.select("key", F.array_join("words", " ").alias("said"), F.size("words").alias("n"))


def places(said: Column) -> Column:
    """``array<struct<term, positions>>`` of words with spaces between, by term."""
    words = F.filter(F.split(said, " "), lambda w: w != "")
    told = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("i"))))

    def grouped(told: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(told) - 1), lambda i: (i == 0) | (F.get(told, i)["term"] != F.get(told, i - 1)["term"]))
        one = lambda at: lambda a, j: F.struct(F.get(told, a)["term"].alias("term"), F.transform(F.sequence(a, F.coalesce(F.get(at, j + 1), F.size(told)) - 1), lambda k: F.get(told, k)["i"]).alias("positions"))
        return bind(at, lambda at: F.transform(at, one(at)))

    return bind(told, lambda told: F.when(F.size(told) > 0, grouped(told)))


def _about(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/{FORMAT}/about")
    except AnalysisException:
        return None


def _generation(spark: SparkSession, folder: str, row) -> TextIndex:
    return TextIndex(spark, f"{folder}/{FORMAT}", list(row["columns"]), row["n"], row["words"], row["kind"], row["generation"], row["sign"], [tuple(x) for x in row["segments"]], [tuple(x) for x in row["gone"]])


def current(spark: SparkSession, folder: str, sign: str | None = None) -> TextIndex | None:
    """The newest generation, or the newest of a source's ``sign``."""
    about = _about(spark, folder)
    if about is None:
        return None
    found = (about if sign is None else about.where(F.col("sign") == sign)).orderBy(F.col("generation").desc()).first()
    return _generation(spark, folder, found) if found else None


def _next(spark: SparkSession, folder: str) -> str:
    """A name that sorts behind those of all generations and segments so far."""
    about = _about(spark, folder)
    last = None if about is None else about.agg(F.max("generation")).first()[0]
    return f"{int(last.split('-')[0]) + 1 if last else 0:010d}-{uuid.uuid4().hex[:12]}"


def _publish(index: TextIndex, folder: str, name: str, sign: str, segments: list, gone: list) -> TextIndex:
    """Write a generation's row of ``about``. Lists of gone rows older than every segment have no effect and are left out."""
    gone = [g for g in gone if any(x < g[0] for x, *_ in segments)]
    lost = index.table("gone", [g for g, _ in gone]).where(F.col("of").isin([x for x, *_ in segments])).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first() if gone else (0, 0)
    n, words = sum(x[1] for x in segments) - lost[0], sum(x[2] for x in segments) - lost[1]
    made = TextIndex(index.spark, index.path, index.columns, n, words, index.kind, name, sign, segments, gone)
    about = index.spark.createDataFrame([(name, sign, index.columns, segments, gone, n, words, index.kind)], "generation string, sign string, columns array<string>, segments array<struct<name:string,n:long,words:long>>, gone array<struct<name:string,n:long>>, n long, words long, kind string")
    about.coalesce(1).write.mode("append").parquet(f"{folder}/{FORMAT}/about")
    return made


def _let_go(spark: SparkSession) -> None:
    """Spark removes the exchanges of finished steps when the driver collects its garbage; a large index should not wait for that."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def _file_by_file(spark: SparkSession, rows: DataFrame) -> Iterator[None]:
    """Tasks that read ``rows`` meanwhile take about one file each."""
    largest = rows.agg(F.max("_metadata.file_size")).first()[0] or 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(largest))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _segment(index: TextIndex, name: str, rows: DataFrame, source: Source | list[str]) -> tuple[str, int, int]:
    """Write the tables of one segment out of rows (id, column, key, len), and
    their texts: a source's, or those of other segments."""

    def put(table: str, rows: DataFrame, *by: str) -> None:
        (rows.write.partitionBy(*by) if by else rows.write).mode("append").option("compression", "zstd").parquet(f"{index.path}/{table}/seg={name}")

    def own(table: str) -> DataFrame:
        return TextIndex(index.spark, index.path, index.columns, 0, 0, index.kind).table(table, [name])

    put("rows", rows.select("id", "column", "key", "len").withColumn("part", _part("key")).repartition("part").sortWithinPartitions("part", "key"), "part")
    n, words = own("rows").where(F.col("column") == 0).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    average = max(words, 1) / max(n, 1)
    col = F.when(F.min("column") == F.max("column"), F.min("column")).otherwise(-1)
    many = own("rows").groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("len").alias("len"), col.alias("col"))
    most = many.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]  # a text has no more words than its rows
    splits = 1 + max(most // SPLIT, min(most // SHARE, index.spark.sparkContext.defaultParallelism))
    if isinstance(source, Source):
        texts = _texts(source, many, n * len(index.columns) <= SMALL, splits)
    else:
        texts = index.table("texts", source)
        texts = texts.repartition(splits, "key").groupBy("key").agg(F.first("said").alias("said"), F.first("n").alias("n")) if len(source) > 1 else texts
    put("texts", texts.select("key", "said", "n").join(many.repartition(splits, "key"), "key"))
    if most > SPLIT:
        _let_go(index.spark)
    held = own("texts").select("key", "m", "len", "col", F.inline(places(F.col("said"))))
    held = held.select(_bucket("term").alias("bucket"), "term", block_of(F.size("positions"), F.col("len"), average).alias("block"), "key", "m", "col", "positions")
    with _file_by_file(index.spark, own("texts")):
        put("postings", held.sortWithinPartitions("bucket", "term", "block"), "bucket")
    # how many rows hold each term, out of the rows of each text
    held = own("postings")
    one = (F.min("col") == F.max("col")) & (F.min("col") >= 0)
    terms = held.groupBy("bucket", "term").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), one.alias("one"))
    terms = terms.select("bucket", "term", "n", "k", F.when(F.col("one"), F.col("n") >= FREQUENT).alias("often"))
    put("terms", terms.repartition("bucket").sortWithinPartitions("bucket", "term"), "bucket")
    # only terms of several columns are looked at row by row
    several = own("terms").where("often is null").select("bucket", "term")
    some = several.count()
    if some:
        cells = held.join(F.broadcast(several) if some <= SMALL else several, ["bucket", "term"], "left_semi").select("bucket", "term", "key").join(own("rows").select("key", "id"), "key")
        twice = cells.groupBy("bucket", "term", "id").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0").groupBy("bucket", "term").agg((-F.sum("more")).alias("n"))
        put("terms", twice.select("bucket", "term", "n", F.lit(0).cast("long").alias("k"), F.lit(None).cast("boolean").alias("often")).coalesce(1), "bucket")
    often = own("terms").where("often").select("bucket", "term")
    rounds = min(1 + often.count() // MANY, BUCKETS)
    for turn in range(rounds):
        mine = F.col("bucket") % rounds == turn
        blocks = held.where(mine).join(F.broadcast(often.where(mine)), ["bucket", "term"]).groupBy("bucket", "term", "block").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
        blocks = blocks.select("bucket", "term", "block", _most(F.col("block")).alias("w"), "n", "k")
        put("tops", blocks.repartition("bucket").sortWithinPartitions("bucket", "term", "block"), "bucket")
        if most > SPLIT:
            _let_go(index.spark)
    return name, n, words


def build(rows: DataFrame | Source, columns: list[str], folder: str, sign: str = "", id_col: str = "id") -> TextIndex:
    """A generation of one segment, out of the source alone."""
    source = _source(rows, columns, id_col)
    spark = source.cells.sparkSession
    index = TextIndex(spark, f"{folder}/{FORMAT}", columns, 0, 0, source.cells.schema["id"].dataType.simpleString())
    name = _next(spark, folder)
    return _publish(index, folder, name, sign, [_segment(index, name, _rows(source), source)], [])


def change(index: TextIndex, folder: str, sign: str, *, rows: DataFrame | Source | None = None, ids: DataFrame | None = None, id_col: str = "id") -> TextIndex:
    """A generation with ``rows`` put in, those of known ids replaced, and rows of
    ``ids`` (a column id) deleted. What is written has the size of the change."""
    name = _next(index.spark, folder)
    source = None if rows is None else _source(rows, index.columns, id_col)
    parts = [x.select("id") for x in (source and source.cells, ids) if x is not None]
    changed = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).distinct()
    old = index.table("rows").join(changed, "id", "left_semi").groupBy(F.col("seg").alias("of"), "id").agg(F.first("len").alias("len"), F.collect_list("key").alias("keys"))
    old.write.parquet(f"{index.path}/gone/seg={name}")
    lost = index.table("gone", [name]).count()
    segments = list(index.segments)
    if source is not None:
        segments.append(_segment(index, name, _rows(source), source))
    return merged(_publish(index, folder, name, sign, segments, [*index.gone, *([(name, lost)] if lost else [])]), folder)


def merged(index: TextIndex, folder: str) -> TextIndex:
    """The generation with segments of like size (by the power of ``FANOUT``) merged where there are ``FANOUT`` of them."""
    tiers: dict[int, list[tuple[str, int, int]]] = {}
    for x in index.segments:
        tier = 0
        while x[1] >= FANOUT ** (tier + 1):
            tier += 1
        tiers.setdefault(tier, []).append(x)
    for some in tiers.values():
        if len(some) >= FANOUT:
            return merged(compact(index, folder, [x for x, *_ in some]), folder)
    return index


def compact(index: TextIndex, folder: str, names: list[str] | None = None) -> TextIndex:
    """A generation whose segments ``names`` (all, if None) are one; rows that are gone are left behind. No text is split into words again."""
    names = [x for x, *_ in index.segments] if names is None else names
    name = _next(index.spark, folder)
    made = _segment(index, name, index.table("rows", names), names)
    kept = [x for x in index.segments if x[0] not in names]
    return _publish(index, folder, name, index.sign, [*kept, made], index.gone)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove segments that none of the newest ``keep`` generations names; returns their names."""
    about = _about(spark, folder)
    kept = set()
    for row in about.orderBy(F.col("generation").desc()).limit(keep).collect():
        kept |= {x["name"] for x in row["segments"]} | {x["name"] for x in row["gone"]}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{FORMAT}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    removed = set()
    for table in SHAPES:
        for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{FORMAT}/{table}/seg=*")) or []:
            name = found.getPath().getName().removeprefix("seg=")
            if name not in kept:
                files.delete(found.getPath(), True)
                removed.add(name)
    return sorted(removed)


# -------------------------------------------------------------------- checking


def differences(index: TextIndex, rows: DataFrame | Source, id_col: str = "id") -> DataFrame:
    """``(id, problem)``: rows that the index lacks (missing), knows with another text (stale) or should not know (extra)."""
    own = lambda rows, name: rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("column", "key"))).alias(name))
    here, there = own(_rows(_source(rows, index.columns, id_col)), "here"), own(index.table("rows"), "there")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").when(F.col("there") != F.col("here"), "stale")
    return here.join(there, "id", "full_outer").select("id", problem.alias("problem")).where("problem is not null")


def there(index: TextIndex) -> bool:
    """Whether a generation's tables are there and list its rows; looks at folders and footers only."""
    names = [x for x, *_ in index.segments]
    try:
        for table in ("texts", "postings", "terms", "tops"):
            index.table(table, names)
        listed = index.spark.read.option("basePath", f"{index.path}/rows").parquet(*[f"{index.path}/rows/seg={x}" for x in names]).count()
        return listed == sum(n for _, n, _ in index.segments) * len(index.columns)
    except Exception:  # noqa: BLE001  a table that cannot be read
        return False


def damaged(index: TextIndex) -> bool:
    """Whether the tables of a generation do not agree: a table is gone, or words lack postings."""
    try:
        words, spaces = index.table("texts").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter(F.split("said", " "), lambda w: w != ""))), F.lit(0))).first()
        placed, held = index.table("postings").agg(F.coalesce(F.sum(F.size("positions")), F.lit(0)), F.count(F.lit(1))).first()
        counted, framed = index.table("terms").agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("often"), F.col("k"))), F.lit(0))).first()
        blocks = index.table("tops").agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        n = index.table("rows").where(F.col("column") == 0).count()
    except Exception:  # noqa: BLE001  a file or table that cannot be read
        return True
    return not words == spaces == placed or held != counted or framed != blocks or n != index.rows


def ensure(rows: DataFrame | Source, columns: list[str], folder: str, sign: str, id_col: str = "id") -> TextIndex:
    """The generation of the source as it is now: the stored one, else the newest
    one changed where it differs, else a first one."""
    found = current((rows.cells if isinstance(rows, Source) else rows).sparkSession, folder, sign)
    if found is not None and found.columns == columns and there(found):
        return found
    return repair(rows, columns, folder, sign, id_col)


def repair(rows: DataFrame | Source, columns: list[str], folder: str, sign: str = "", id_col: str = "id") -> TextIndex:
    """A generation that agrees with the source: the newest one with the rows that
    differ changed, if it is whole, else one from the source alone."""
    source = _source(rows, columns, id_col)
    old = current(source.cells.sparkSession, folder)
    if old is None or old.columns != columns or not old.segments or damaged(old):
        return build(source, columns, folder, sign)
    wrong = differences(old, source)
    return change(old, folder, sign, rows=source.of(wrong.where("problem <> 'extra'").select("id")), ids=wrong.where("problem = 'extra'").select("id"))
